"""Hand-computed plant master cases."""

from pyspark.sql import functions as F

from sitesift.config import config
from sitesift.functions.bands import derived_line_mw, tier_of
from sitesift.operators import rollup, rules

GEN = ("eia_id long, plant_name string, operator string, state string, county string, ba_code string, nameplate_mw double, dc_mw double, "
       "op_month int, op_year int, energy_source string, prime_mover string, lat double, lon double, ordinal int")


def _gen(spark):
    row = lambda i, n, mw, y, m=6, dc=None, ba="ERCO", st="TX", src="SUN", pm="PV", o=0: (i, n, "Op", st, "Pecos", ba, mw, dc, m, y, src, pm, 31.0, -103.0, o)
    return spark.createDataFrame([
        row(1, "Alpha", 50.0, 2017, 6, 65.0, o=1), row(1, "Alpha", 30.0, 2018, 3, 39.0, o=2), row(1, "Alpha", 20.0, 2019, 1, None, src="MWH", pm="BA", o=3),
        row(2, "Bravo", 150.0, 2016, 9), row(3, "Charlie", 8.0, 2018), row(4, "Delta", 60.0, 2023, 2), row(5, "Echo", 30.0, 2019), row(6, "Foxtrot", 40.0, 2020),
        row(7, "Golf", 20.0, 2021, ba="EPE"), row(8, "Hotel", 100.0, 2015, 1, 130.0), row(9, "India", 200.0, 2019, st="NM")], GEN)


def _poly(spark):
    acre = 4046.8564224
    rows = [("1", 640, 80, 104), ("2", 1200, 150, 195), ("3", 70, 8, 10), ("4", 480, 60, 78), ("5", 100, 30, 39), ("7", 160, 20, 26), ("8", 800, 100, 130), ("99", 300, 40, 52), (None, 90, 12, 15)]
    return spark.createDataFrame([(i, "TX", "Pecos County", a * acre, a * acre, float(ac), float(dc), 2017, "single-axis", "c") for i, a, ac, dc in rows],
                                 "eia_id string, p_state string, p_county string, p_area double, area_calc_m2 double, p_cap_ac double, p_cap_dc double, p_year int, p_axis string, p_tech_pri string")


def test_plant_master(spark):
    cfg = config()
    plants, poly = rollup.plant_rollup(_gen(spark), cfg), rollup.polygon_rollup(_poly(spark), cfg)
    out = {r.eia_id: r for r in rules.apply_filters(rollup.plant_left_join(plants, poly), cfg, "2026-09-30").collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6, 7, 8}
    a = out[1]
    assert a.ac_mw == 80 and a.dc_mw == 104 and abs(a.ilr - 1.3) < 1e-9 and a.cod_multi_phase and a.has_colocated_storage and a.filter_status == "pass" and a.tier == "T1a"
    assert out[2].dc_mw_source == "uspvdb" and out[2].dc_mw == 195 and out[2].tier == "T1b" and out[2].sb6_review_required and abs(out[2].planned_load_mw - 112.125) < 1e-9
    assert (out[3].filter_status, out[3].filter_reasons) == ("fail", "ac_mw<10")
    assert out[4].filter_reasons == "cod>2022-12-31" and out[4].itc_recapture_open
    assert (out[5].filter_status, out[5].filter_reasons) == ("review", "array_acres_per_mw<5")
    assert out[6].filter_reasons == "no_uspvdb_polygon" and out[7].non_ercot_texas and out[7].filter_status == "pass"
    assert abs(out[8].planned_load_mw - 74.75) < 1e-9 and not out[8].sb6_review_required
    assert [r.eia_id for r in rollup.orphans(poly, plants).collect()] == [99]
    assert rollup.rows_without_id(_poly(spark), cfg).first()[0] == 1


def test_tier_edges(spark):
    mw = [9.99, 10.0, 24.99, 25.0, 74.99, 75.0, 100.33, 100.34]
    df = spark.createDataFrame([(v,) for v in mw], "mw double").select("mw", tier_of(F.col("mw"), config()).alias("t"))
    assert [r.t for r in df.orderBy("mw").collect()] == [None, "T3", "T3", "T2", "T2", "T1a", "T1a", "T1b"]
    assert abs(derived_line_mw(config()) - 100.33) < 0.01


def test_parcel_basis(spark):
    cfg = config()
    base = rollup.plant_left_join(rollup.plant_rollup(_gen(spark), cfg), rollup.polygon_rollup(_poly(spark), cfg)).filter("eia_id = 5")
    add = lambda apm, conf: base.withColumns({"parcel_status": F.lit("ok"), "parcels_confidence": F.lit(conf), "parcel_acres_host": F.lit(apm * 30), "acres_per_mw_parcel": F.lit(apm)})
    got = [rules.apply_filters(add(a, c), cfg, "2026-09-30").first().filter_status for a, c in ((3.0, "high"), (8.0, "high"), (8.0, "low"))]
    assert got == ["fail", "pass", "review"]
