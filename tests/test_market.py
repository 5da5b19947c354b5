"""Hand-computed settlement cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitesift.config import config
from sitesift.operators import settlement as st

RAW = "sced_time_stamp string, repeated_hour_flag string, resource_name string, resource_type string, telemetered_net_output double, base_point double, hsl double"


def runs(spark, resource="S", tno=80.0, bp=80.0, hsl=100.0, rtype="PVGR", stamps=None, flag="N"):
    stamps = stamps or [f"07/15/2026 12:{m:02d}:00" for m in range(0, 60, 5)]
    return spark.createDataFrame([(s, flag, resource, rtype, tno, bp, hsl) for s in stamps], RAW)


def settle(raw, cfg):
    return st.interval_energy(st.pv_telemetry(raw, cfg), cfg)


@pytest.mark.parametrize("slice_minutes", [15, 180])
def test_energy(spark, slice_minutes):
    cfg = config(market={"slice_minutes": slice_minutes})
    rows = settle(runs(spark), cfg).orderBy("interval_start").collect()
    assert len(rows) == 4 and rows[0].interval_start == dt.datetime(2026, 7, 15, 17, 0)
    tot = [round(sum(r[c] for r in rows), 9) for c in ("hours", "gen_mwh", "hsl_mwh", "curtailed_mwh")]
    assert tot == [1.0, 80.0, 100.0, 20.0]


def test_other_types_gaps_and_clock_change(spark):
    cfg = config()
    r = settle(runs(spark, rtype="WIND").union(runs(spark, "B", 100.0, 120.0)), cfg)
    assert {x.resource_name for x in r.collect()} == {"B"} and r.agg(F.sum("curtailed_mwh")).first()[0] == 0
    gap = settle(runs(spark, stamps=["07/15/2026 12:00:00", "07/15/2026 14:00:00"]), cfg)
    assert abs(gap.agg(F.sum("hours")).first()[0] - 10 / 60) < 1e-9
    two = settle(runs(spark, stamps=["11/01/2026 01:00:00"]).union(runs(spark, stamps=["11/01/2026 01:00:00"], flag="Y")), cfg).orderBy("interval_start").collect()
    assert two[1].interval_start - two[0].interval_start == dt.timedelta(hours=1)


def prices(spark):
    at = [dt.datetime(2026, 7, 15, 17, m) for m in (0, 15, 30, 45)]
    return spark.createDataFrame([(t, loc, p) for loc, p in (("HB_HUBAVG", 50.0), ("NODE_A", 25.0), ("NODE_B", 40.0)) for t in at], "interval_start timestamp, location string, spp double")


def xw(spark, rows):
    return spark.createDataFrame([(*r, i, "CR") for i, r in enumerate(rows)], "eia_plant_id long, ercot_resource_name string, ercot_settlement_point string, ac_mw_eia double, ordinal int, verified_by string")


def test_summary(spark):
    cfg = config(market={"min_month_coverage": 0.0, "min_gen_mwh_for_capture": 10.0})
    x = xw(spark, [(1, "S", "NODE_A", 100.0), (2, None, None, 50.0), (3, "MISSING", "NODE_A", 50.0), (4, "S", None, 100.0)])
    _m, s = st.market_metrics(settle(runs(spark), cfg), prices(spark), x, cfg)
    out = {r.eia_id: r for r in s.collect()}
    assert [out[i].metrics_status for i in (1, 2, 3, 4)] == ["ok", "no_ercot_resource", "no_sced_data", "no_settlement_point"]
    a = out[1]
    assert [round(v, 9) for v in (a.capture_rate, a.shape_capture, a.basis_ratio, a.curtailment_pct, a.sced_net_cf)] == [0.5, 1.0, 0.5, 0.2, 0.8]
    assert a.ercot_resource_shared and out[4].ercot_resource_shared and round(out[4].curtailment_pct, 9) == 0.2 and out[2].sced_coverage == "none"


def test_two_units_weight_prices(spark):
    cfg = config()
    s15 = settle(runs(spark, "U1").union(runs(spark, "U2", 40.0, 40.0)), cfg)
    m, _s = st.market_metrics(s15, prices(spark), xw(spark, [(1, "U1", "NODE_A", 100.0), (1, "U2", "NODE_B", 100.0)]), cfg)
    r = m.first()
    assert abs(r.gen_mwh - 120) < 1e-9 and abs(r.node_gen_wtd_spp - (80 * 25 + 40 * 40) / 120) < 1e-9 and r.n_units == 2
