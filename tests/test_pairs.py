"""Pairs of a county: made and scored without shuffling them, first ten without sorting them all, holders looked up by unit."""

import itertools
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from sitesift.config import config
from sitesift.operators import matching as mt
from sitesift.plans import load, q_match

C = config()["crosswalk"]


def above_pairs(df) -> str:
    """The plan over the join on the county."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [county_n" in plan
    return plan.split("SortMergeJoin [county_n")[0]


def test_pairs_of_a_crowded_county_are_scored_once_each(spark, monkeypatch):
    monkeypatch.setattr(mt, "COUNTY_PART", 3)
    monkeypatch.setattr(mt, "NAMESAKES", 2)
    mine = [(i, "hale" if i % 4 else "", ["blue mesa", "blue mesa 2", "", "granite"][i % 3]) for i in range(17)] + [(None, "hale", "blue mesa"), (None, "hale", "blue mesa"), (3, "hale", "blue mesa")]
    theirs = [(f"U{k}", ["hale", "", "kent"][k % 3], ["blue mesa", "mesa granite", ""][k % 2], f"bm {k}") for k in range(11)]
    got = mt.scored_pairs(spark.createDataFrame(mine, "eia_id long, county_n string, plant_n string"), spark.createDataFrame(theirs, "unit_code string, county_n string, name_n string, code_n string"))
    want = [(str(i), u, max(mt.token_set_score(p, n), mt.token_set_score(p, k))) for (i, c, p), (u, d, n, k) in itertools.product(mine, theirs) if c == d]
    assert sorted((str(r.eia_id), r.unit_code, r.name_score) for r in got.collect()) == sorted(want)
    assert "Exchange" not in above_pairs(got)


def test_first_ten_before_the_sort(spark):
    pick = random.Random(5).choice
    rows = [(pick([1, 2, 2**60, 2**60 + 1, None]), pick([1, 2, None]), pick([80.0, 90.0, float("nan"), None, 70.0]), 100.0, pick([100.0, 90.5, None, float("nan"), 3.0]), pick([None, *range(9)]), f"u{k}", None, 2000, True, True) for k in range(3000)]
    cands = spark.createDataFrame(rows, "eia_id long, tier int, name_score double, ac_mw double, mw double, ord int, unit_code string, unit_name string, year int, phase_ok boolean, year_ok boolean").coalesce(1)
    ten = mt.top_candidates(cands, C)
    cands.createOrReplaceTempView("first_ten_cands")
    plain = spark.sql("""SELECT eia_id, tier, unit_code, place FROM (SELECT *, row_number() OVER (PARTITION BY eia_id, tier ORDER BY -name_score NULLS FIRST, coalesce(abs(mw - ac_mw), double('inf')), ord NULLS FIRST, unit_code) AS place FROM first_ten_cands) WHERE place <= 10""")
    key = lambda r: (str(r.eia_id), str(r.tier), r.place, r.unit_code)
    assert sorted(map(key, ten.collect())) == sorted(map(key, plain.collect()))
    assert cands.filter(mt._can_lead(10)).count() < 1500  # many ties


def test_holder_by_unit(spark):
    t = {"match_plants": spark.createDataFrame([(1, "Blue Mesa", "Hale", 50.0), (2, "Quail", "Hale", 70.0), (3, "Lone", "Kent", 9.0)], "eia_id long, plant_name string, county string, ac_mw double").selectExpr("*", "date'2018-01-01' AS cod_first", "date'2018-01-01' AS cod_last"),
         "market_rows": spark.createDataFrame([("A", "x", "HALE", "50", "in 2018", 1), ("B", "y", "HALE", "n/a", "in 2018", 2), (None, "z", "HALE", "1", "in 2018", 3), ("D", "z", "GRAY", "1", "in 2018", 4)], "unit_code string, unit_name string, county string, installed_mw string, in_service_year string, ordinal long"),
         "old_matches": spark.createDataFrame([("9", "Late", "A"), ("8", "First", "A"), ("7", "None", None)], "eia_plant_id string, eia_plant_name string, ercot_resource_name string")}
    got = q_match.held(t)
    assert sorted((r.eia_id, str(r.unit_code), r.held_by) for r in got.collect()) == [(i, u, h) for i in (1, 2) for u, h in (("A", "First"), ("B", None), ("None", None))]
    assert "Join" not in above_pairs(got) and "Exchange" not in above_pairs(got)


def test_free_unit_sets_look_beyond_the_county(spark, tmp_path):
    """Names that are alike bring units of other counties; the query and its SQL agree on sets of up to five units."""
    rows = [(k, ["blue ring", "blue ring bolt", "old plate"][k % 3], f"Brand#{k % 5}", "SMALL", 1 + k % 3, 200.0 * (1 if k % 4 else 4) + 3.7 * k) for k in range(18)]
    cols = list(zip(*rows, strict=True))
    pq.write_table(pa.table({n: pa.array(list(v), t) for n, v, t in zip(("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"), cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64()), strict=True)}), tmp_path / "part.parquet")
    pq.write_table(pa.table({"c_custkey": pa.array([1], pa.int64()), "c_name": ["x"], "c_nationkey": pa.array([1], pa.int32()), "c_acctbal": [1.0], "c_mktsegment": ["y"]}), tmp_path / "customer.parquet")
    got = sorted(tuple(r) for r in load().QUERIES["free_unit_sets"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    assert got == sorted(con.execute(load().oracle()["free_unit_sets"]).fetchall())
    county = {f"{n[:3].upper()}{k}_UNIT{size % 3}": (brand, size) for k, n, brand, _t, size, _p in rows}
    home = {k: (brand, size) for k, _n, brand, _t, size, _p in rows}
    assert any(county[u] != home[i] for i, _place, _n, _mw, codes in got for u in codes.split("+"))
    assert max(r[2] for r in got) >= 3
