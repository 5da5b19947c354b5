"""Counts within a radius by whole cells, and radii settled one after the other, against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitesift.config import config
from sitesift.operators import layers as ly, proximity as px

FEATURE = "feature_id int, label string, v double, x1 double, y1 double, x2 double, y2 double"


def ground(spark, n=700, seed=5):
    """Labels with nulls, places shared by many, features just on the radius, a site there twice and one with a null key."""
    rng = random.Random(seed)
    spot = lambda: (rng.uniform(-4e3, 4e3), rng.uniform(-4e3, 4e3))
    spots = [spot() for _ in range(n)] + [(250.0, 250.0)] * 40 + [(1000.0, 0.0), (0.0, -1000.0), (600.0, 800.0)]
    feats = [(i, rng.choice(["a", "b", "c", None]), rng.uniform(0, 9), x, y, x, y) for i, (x, y) in enumerate(spots)]
    sites = [(i, *spot()) for i in range(40)] + [(40, 0.0, 0.0), (40, 0.0, 0.0), (None, 9.0, 9.0), (41, 9e5, 9e5)]
    return sites, feats, spark.createDataFrame(sites, "eia_id int, x double, y double"), spark.createDataFrame(feats, FEATURE)


@pytest.mark.parametrize("fine", [1, 5, 12])
def test_counts_are_those_of_the_pairs(spark, fine):
    sites, feats, s, f = ground(spark)
    want = Counter((i, g) for i, x, y in sites for _, g, _, a, b, _, _ in feats if math.sqrt((a - x) ** 2 + (b - y) ** 2) <= 1000)
    got = px.within_counts(s, f, 1000, ["label"], fine=fine, split=9)
    assert {(r.eia_id, r.label): r.n for r in got.collect()} == want


def test_whole_cells_make_no_pairs(spark):
    """A crowd in the middle of the circle comes as one number: only the edge is compared."""
    site = spark.createDataFrame([(1, 0.0, 0.0)], "eia_id int, x double, y double")
    f = spark.range(3000).select(F.col("id").alias("feature_id"), (F.col("id") % 50).cast("double").alias("x1"), (F.col("id") % 60).cast("double").alias("y1"))
    f = f.withColumns({"x2": F.col("x1"), "y2": F.col("y1")})
    met, plain = [], px.met_in_cells
    try:
        px.met_in_cells = lambda *a: met.append(plain(*a)) or met[-1]
        assert px.within_counts(site, f, 1000.0).first().n == 3000 and met[0].count() == 0
    finally:
        px.met_in_cells = plain


def test_radius_ladder(spark):
    sites, feats, s, f = ground(spark)
    radii, want = [0.3, 0.6, 1.0], {}
    for key in {i for i, _, _ in sites}:
        d = [math.sqrt((a - x) ** 2 + (b - y) ** 2) / 1000 for i, x, y in sites if i == key for *_, a, b, _, _ in feats]
        n = [sum(v <= r for v in d) for r in radii]
        if n[2]:
            want[key] = (next((r for r, k in zip(radii, n) if k >= 20), None), n[2])
    got = px.adaptive_radius(px.radius_counts(s, f, radii, 1000.0), radii, 20)
    assert {r.eia_id: (r.radius_mi, r.n_far) for r in got.collect()} == want


def test_a_settled_site_is_not_paired_with_wider_circles(spark):
    sites, feats, s, f = ground(spark)
    cfg = config()
    cfg["units"]["m_per_mi"] = 1000.0
    c, want = cfg["layers"]["wells"] | {"search_radii_mi": [0.3, 0.6, 1.0]}, {}
    for key in {i for i, _, _ in sites} - {None}:
        d = [(math.sqrt((a - x) ** 2 + (b - y) ** 2) / 1000, v) for i, x, y in sites if i == key for _, _, v, a, b, _, _ in feats]
        held = [[v for e, v in d if e <= r] for r in c["search_radii_mi"]]
        k = next((k for k, h in enumerate(held) if len(h) >= 20), None)
        if held[2]:
            want[key] = (c["search_radii_mi"][k], len(held[k]), round(max(held[k]), 9)) if k is not None else (None, len(held[2]), None)
    asked, plain = [], px.within_features
    try:
        px.within_features = lambda left, *a: asked.append(left.select("eia_id").distinct().count()) or plain(left, *a)
        got = ly._first_radius(s, f, "feature_id", 20, c, cfg, {"top": F.round(F.max("v"), 9)}).collect()
    finally:
        px.within_features = plain
    assert {r.eia_id: (r.radius_mi, r.n, r.top) for r in got if r.eia_id is not None} == want
    settled = [sum(w[0] == r for w in want.values()) for r in c["search_radii_mi"]]
    assert all(settled[:2]) and asked[1] <= asked[0] - settled[0] and asked[2] <= asked[1] - settled[1]


def test_cells_of_sites_are_not_broadcast(spark):
    """A small file of sites becomes many rows, one for each cell: no inner join may send them through the driver."""
    c = spark.createDataFrame([(k, 1000.0 * k, 0.0) for k in range(5)], "eia_id long, x double, y double")
    f = spark.createDataFrame([(k, 900.0 * k, 10.0, 900.0 * k, 10.0) for k in range(9)], "feature_id long, x1 double, y1 double, x2 double, y2 double")
    for df in (px.within_counts(c, f, 5000.0), px.within_pairs(c, f, 5000.0, "feature_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not [row for row in plan.splitlines() if "BroadcastHashJoin" in row and "Inner" in row]
    got = {r.eia_id: r.n for r in px.within_counts(c, f, 5000.0).collect()}
    assert got == {k: sum((1000.0 * k - 900.0 * j) ** 2 + 100 <= 25e6 for j in range(9)) for k in range(5)}
