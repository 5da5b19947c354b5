"""Dispatch rows as they arrive → final 15-minute energy, with open quarter hours held in keyed state.

A row's length is the time to the resource's next run, so a quarter hour is final only when the watermark has passed its end by
the farthest next run. Until then its rows wait in the state of their time slice and lot. Slices are those of the batch plan; a
lot is a share of the (resource, day) pairs, so that a resource with most of the rows is spread over as many keys as slices are
open, and a slice with a few rows from each of many resources is settled in LOTS calls, not one for each resource. A slice's
state goes when it is over. A key's state holds its lot's rows of the watermark's delay, one quarter hour and the farthest next run,
at most of one slice.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.settlement import INTERVAL_US, MINUTE_US, slice_width, time_slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUT = "resource_name string, day string, start_us long, gen_mwh double, hsl_mwh double, curtailed_mwh double, hours double"
LOTS = 16  # keys of a time slice; fixed for the life of a checkpoint
MW = ["tno", "bp", "hsl"]  # in the order in which the batch plan sorts rows of one instant


def _ordered(group, us, after, mw):
    """Rows by group and instant; of one instant a slice's own rows first, then by figures, null first: the order of the batch plan."""
    keys = [np.where(np.isnan(m), -np.inf, m) for m in mw]
    order = np.lexsort((*reversed(keys), after, us, group))
    return group[order], us[order], after[order], mw[:, order]


def _energy(group, us, after, mw, reach: int, default: float) -> pd.DataFrame:
    """(group, start_us, figures) of every quarter hour that has a row of the slice itself."""
    gap = np.append(np.where(group[1:] == group[:-1], us[1:] - us[:-1], 0), 0)
    hours = np.where((gap > 0) & (gap <= reach), gap / (60.0 * MINUTE_US), default)
    tno, bp, hsl = mw
    hsl = np.maximum(np.nan_to_num(hsl), 0.0)
    cut = np.maximum(hsl - np.where(np.isnan(bp), hsl, bp), 0.0)
    rows = pd.DataFrame({"group": group, "start_us": us // INTERVAL_US * INTERVAL_US, "gen_mwh": np.maximum(np.nan_to_num(tno), 0.0) * hours,
                         "hsl_mwh": hsl * hours, "curtailed_mwh": cut * hours, "hours": hours})
    return rows[~after].groupby(["group", "start_us"], as_index=False).sum()


def live_energy(telemetry: DataFrame, cfg: dict, late: str = "2 hours", lots: int = LOTS) -> DataFrame:
    """Streaming telemetry (resource_name, operating_day, utc, tno, bp, hsl) → each quarter hour once, when it is final, with
    the columns of `interval_energy`; append mode.

    Equal to the batch on all rows that arrive no later than the watermark, in whatever order. Rows behind the watermark are
    left out here (`late_rows` counts them; `settle_days` takes them in). Rows without an instant or a day are left out, null
    figures stay unknown, repeated rows count as the batch counts them.
    """
    m = cfg["market"]
    reach, default, width = m["max_interval_minutes"] * MINUTE_US, m["default_minutes"] / 60.0, slice_width(cfg)
    settled = lambda start: start + INTERVAL_US + reach

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cell = key[0]
        mark = state.getCurrentWatermarkMs() * 1000
        names, days, held = state.get if state.exists else ([], [], b"")
        parts = [np.frombuffer(bytes(held)).reshape(6, -1)]
        whose = [np.array([names, days], object).reshape(2, -1)[:, parts[0][0].astype(int)]]
        if not state.hasTimedOut:
            for f in frames:
                first = f["us"].to_numpy(np.int64) - cell * width  # within a slice, so doubles hold it exactly
                parts.append(np.vstack([np.zeros(len(f)), first, f["_after"].to_numpy(float), *(f[c].to_numpy(float) for c in MW)]))
                whose.append(np.stack([f[c].astype(object).to_numpy() for c in ("resource_name", "day")]))
        rows, (name, day) = np.hstack(parts), np.hstack(whose)
        (name, names), (day, days) = (pd.factorize(x, use_na_sentinel=False) for x in (name, day))
        group, us, after, mw = _ordered(name * len(days) + day, rows[1].astype(np.int64) + cell * width, rows[2] > 0, rows[3:])
        start = us // INTERVAL_US * INTERVAL_US
        wait = settled(start) > mark
        if len(us) and not wait.all():
            done = _energy(group, us, after, mw, reach, default)
            done = done[settled(done["start_us"]) <= mark]
            if len(done):
                yield done.assign(resource_name=names[done["group"] // len(days)], day=days[done["group"] % len(days)])[
                    ["resource_name", "day", "start_us", "gen_mwh", "hsl_mwh", "curtailed_mwh", "hours"]]
        over = (cell + 1) * width
        if over <= mark and not (wait & ~after).any():
            state.remove()
            return
        open_until = settled(start[wait & ~after])
        wake = min(open_until.min() if len(open_until) else over, over if over > mark else np.iinfo(np.int64).max)
        kept, code = np.unique(group[wait], return_inverse=True)
        label = lambda values, at: [None if pd.isna(v) else v for v in values[at]]
        state.update((label(names, kept // max(1, len(days))), label(days, kept % max(1, len(days))),
                      np.vstack([code, us[wait] - cell * width, after[wait], mw[:, wait]]).astype(float).tobytes()))
        state.setTimeoutTimestamp(int(-(-wake // 1000)))

    kind = dict(telemetry.dtypes)["operating_day"]
    rows = telemetry.select("resource_name", "operating_day", "utc", *MW).where("utc is not null and operating_day is not null").withWatermark("utc", late)
    cut = time_slices(rows, cfg).select("utc", "resource_name", F.col("operating_day").cast("string").alias("day"), "_cell", "_after",
                                        F.pmod(F.xxhash64("resource_name", "operating_day"), F.lit(lots)).alias("_lot"), F.unix_micros("utc").alias("us"), *[F.col(c).cast("double").alias(c) for c in MW])
    done = cut.groupBy("_cell", "_lot").applyInPandasWithState(settle, OUT, "names array<string>, days array<string>, rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    return done.select("resource_name", F.col("day").cast(kind).alias("operating_day"), F.timestamp_micros("start_us").alias("interval_start"),
                       "gen_mwh", "hsl_mwh", "curtailed_mwh", "hours")


def late_rows(query) -> int:
    """Rows that came behind the watermark, over the progress a query keeps; one just behind a slice's start counts in both its slices."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
