"""A cell with a third of all features is split by its count; the pairs are those of a plain loop."""

import math
import random

from pyspark.sql import functions as F

from sitesift.operators import proximity as px

SITE, FEATURE = "eia_id int, x double, y double", "feature_id int, x1 double, y1 double, x2 double, y2 double"


def town(spark, n=900, seed=3):
    """A third of the features in one cell of a kilometre, two places shared by many, the rest far and wide."""
    rng = random.Random(seed)
    far = lambda: (rng.uniform(-9e3, 9e3), rng.uniform(-9e3, 9e3))
    spots = [(rng.uniform(10, 990), rng.uniform(10, 990)) for _ in range(n // 3)] + [(500.0, 500.0)] * (n // 10) + [(-3500.0, 2500.0)] * (n // 10)
    spots += [far() for _ in range(n - len(spots))]
    feats = [(i, x, y, x, y) for i, (x, y) in enumerate(spots)]
    sites = [(i, *far()) for i in range(40)] + [(40 + i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(20)] + [(60, 500.0, 500.0), (60, 900.0, 900.0)]
    return sites, feats, spark.createDataFrame(sites, SITE), spark.createDataFrame(feats, FEATURE)


def test_split_cells_give_the_pairs_of_a_plain_loop(spark):
    sites, feats, s, f = town(spark)
    want = sorted((i, j, round(math.dist((x, y), (a, b)), 6)) for i, x, y in sites for j, a, b, _, _ in feats if math.dist((x, y), (a, b)) <= 1000)
    for split in (7, 50, 10_000):
        got = sorted((r.eia_id, r.feature_id, round(r.d, 6)) for r in px.within_pairs(s, f, 1000, "feature_id", split=split).collect())
        assert got == want


def test_nearest_over_split_cells(spark):
    sites, feats, s, f = town(spark)
    best = {}
    for i, x, y in sites:
        for j, a, b, _, _ in feats:
            d = math.dist((x, y), (a, b))
            if d <= 1000:
                best[i] = min(best.get(i, (d, j)), (d, j))
    for split in (3, 10_000):
        got = {r.eia_id: (r.d, r.feature_id) for r in px.nearest_features(s, f, 1000, "feature_id", [], split=split).collect()}
        assert got.keys() == best.keys() and all(got[k][1] == best[k][1] and abs(got[k][0] - best[k][0]) < 1e-6 for k in best)


def test_parts_follow_the_count_and_other_sites_stay_single(spark):
    _, feats, s, f = town(spark)
    cells = px._feature_cells(f, 1000.0)
    held = {(r._cx, r._cy): r.n for r in cells.groupBy("_cx", "_cy").agg(F.count("*").alias("n")).collect()}
    parts = {(r._cx, r._cy): r._parts for r in px.crowded_cells(cells, 50).collect()}
    assert parts == {c: math.ceil(n / 50) for c, n in held.items() if n > 50} and parts[(0, 0)] >= len(feats) / 3 / 50
    here = s.select("*", F.floor(F.col("x") / 1000).alias("_cx"), F.floor(F.col("y") / 1000).alias("_cy"))
    met = px.met_in_cells(here, cells.drop("_bx", "_by"), "feature_id", 50)
    used = {(r._cx, r._cy): r.n for r in met.groupBy("_cx", "_cy").agg(F.countDistinct("_part").alias("n")).collect()}
    assert used[(0, 0)] == parts[(0, 0)] and all(n == 1 for c, n in used.items() if c not in parts)


def test_no_features_and_no_sites(spark):
    _, _, s, f = town(spark, 30)
    none_s, none_f = s.limit(0), f.limit(0)
    assert px.within_pairs(none_s, f, 1000, "feature_id").count() == 0 and px.within_pairs(s, none_f, 1000, "feature_id").count() == 0
    assert px.nearest_features(s, none_f, 1000, "feature_id", []).count() == 0
