"""Figures within a radius from tiles equal those over all pairs, and no pair becomes a row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitesift.config import config
from sitesift.operators import layers as ly
from sitesift.operators import proximity as px


@pytest.mark.parametrize("split", [20_000, 7])
def test_totals_of_tiles_equal_those_of_all_pairs(spark, split):
    rng = random.Random(split)
    sites = [(k, rng.uniform(-300, 300), rng.uniform(-300, 300)) for k in range(20)] + [(None, 5.0, 5.0), (99, 9e5, 0.0)]
    feats = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 7.5]), float(rng.randrange(-400, 400)), float(rng.randrange(-400, 400))) for _ in range(150)]
    feats += [("a", 3.0, sites[0][1] + 100.0, sites[0][2])] * 2
    want = {}
    for key, x, y in sites:
        for label, v, fx, fy in feats:
            if math.sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) <= 100.0:
                n, most = want.get((key, label), (0, None))
                want[key, label] = n + 1, v if most is None else most if v is None else max(v, most)
    s = spark.createDataFrame(sites, "eia_id long, x double, y double")
    f = spark.createDataFrame(feats, "label string, v double, x1 double, y1 double").withColumn("x2", F.col("x1")).withColumn("y2", F.col("y1"))
    got = px.within_totals(s, f, 100.0, ["label"], ["v"], split=split).collect()
    assert {(r.eia_id, r.label): (r.n, r.v) for r in got} == want and len(got) == len(want)


def coverage(spark, twice):
    rng = random.Random(3)
    spots = [(k, 30 + rng.uniform(0, 0.6), -100 + rng.uniform(0, 0.6)) for k in range(12)]
    ids = spark.createDataFrame([(*s, False) for s in spots], "eia_id long, lat double, lon double, geometry_is_point boolean")
    centres = spark.createDataFrame([(f"c{k}", 30 + rng.uniform(0, 0.6), -100 + rng.uniform(0, 0.6)) for k in range(40)], "h3 string, lat double, lon double")
    rows = [(f"c{rng.randrange(40)}", f"p{rng.randrange(6)}", rng.choice(["x", "y", "z", "w", None]), 1, rng.choice([None, 10.0, 20.0]), 5.0, rng.random() < 0.2) for _ in range(150)]
    cells = spark.createDataFrame(rows, "h3 string, provider_id string, brand string, locations long, max_down double, max_up double, business boolean")
    met, plain = [], px.within_features
    px.within_features = lambda *a, **k: met.append(1) or plain(*a, **k)
    try:
        sites = px.site_points(ids)
        out = ly.coverage(ids, sites.union(sites.filter("eia_id = -1")) if not twice else sites.union(sites.limit(0)).union(spark.createDataFrame([(-1, 0.0, 0.0)] * 2, sites.schema)), cells, centres, config(), "s", None, "d")
        return sorted(map(str, out.collect())), len(met)
    finally:
        px.within_features = plain


def test_coverage_makes_no_pairs_and_agrees_with_them(spark):
    tiles, none = coverage(spark, False)
    pairs, some = coverage(spark, True)
    assert none == 0 and some == 1 and tiles == pairs
