"""Quarter hours from keyed state equal those of one batch, whatever the order of arrivals within the watermark."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitesift.config import config
from sitesift.operators.settlement import interval_energy
from sitesift.streaming.live_settlement import late_rows, live_energy

SCHEMA = "resource_name string, operating_day date, utc timestamp, tno double, bp double, hsl double"
NOON = dt.datetime(2026, 7, 15, 12)


def rows_of(n, seed):
    rng = random.Random(seed)
    at = [NOON + dt.timedelta(seconds=rng.randrange(0, 6 * 3600, 150)) for _ in range(n)]
    mw = lambda: rng.choice([None, -5.0, 0.0, 40.0, 80.5])
    return [(rng.choice(["S", "S", "S", "T"]), t.date(), t, mw(), mw(), mw()) for t in at]


def stream(spark, tmp_path, deliveries, cfg, late):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    dropped = 0
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        live = live_energy(spark.readStream.schema(SCHEMA).parquet(src), cfg, late)
        q = live.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        dropped += late_rows(q)
    return spark.read.parquet(out), dropped


def figures(df):
    cols = [F.round(c, 9) for c in ("gen_mwh", "hsl_mwh", "curtailed_mwh", "hours")]
    return sorted(tuple(r) for r in df.select("resource_name", "operating_day", "interval_start", *cols).collect())


@pytest.mark.parametrize("slice_minutes", [15, 60])
def test_shuffled_arrivals_equal_the_batch(spark, tmp_path, slice_minutes):
    cfg = config(market={"slice_minutes": slice_minutes})
    rows = rows_of(300, slice_minutes)
    shifted = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=random.Random(str(r[2])).randrange(50)))
    flush = [("Z", NOON.date(), NOON + dt.timedelta(hours=20), 1.0, 1.0, 1.0)]
    got, dropped = stream(spark, tmp_path, [shifted[:120], shifted[120:210], shifted[210:], flush], cfg, "1 hour")
    assert dropped == 0
    assert figures(got) == figures(interval_energy(spark.createDataFrame(rows, SCHEMA), cfg))


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    cfg = config()
    at = lambda minutes, mw=60.0: ("S", NOON.date(), NOON + dt.timedelta(minutes=minutes), mw, mw, mw)
    on_time = [at(m) for m in range(0, 60, 5)]
    got, dropped = stream(spark, tmp_path, [on_time, [at(600)], [at(31), at(610), (None, None, None, None, None, None)]], cfg, "30 minutes")
    assert dropped == 1
    assert figures(got) == figures(interval_energy(spark.createDataFrame(on_time, SCHEMA), cfg))


def test_many_resources_share_the_keys_of_a_slice(spark, tmp_path):
    cfg = config()
    rows = [(f"R{k % 150}" if k % 150 else None, NOON.date(), NOON + dt.timedelta(minutes=k % 170), 5.0 + k, None, 50.0) for k in range(450)]
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(src)
    live = live_energy(spark.readStream.schema(SCHEMA).parquet(src), cfg, "1 hour", lots=4)
    q = live.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 2 * 4  # the slice and the one before
    spark.createDataFrame([("Z", NOON.date(), NOON + dt.timedelta(hours=20), 1.0, 1.0, 1.0)], SCHEMA).write.mode("append").parquet(src)
    live.writeStream.option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination(120)
    text = lambda df: sorted((str(r[0]), *r[1:]) for r in map(tuple, df.select("resource_name", "operating_day", "interval_start", *[F.round(c, 9) for c in ("gen_mwh", "hsl_mwh", "curtailed_mwh", "hours")]).collect()))
    assert text(spark.read.parquet(out)) == text(interval_energy(spark.createDataFrame(rows, SCHEMA), cfg))
