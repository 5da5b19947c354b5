"""Area kernel, distances, quantiles and name scores against closed forms and brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sitesift.functions import geo
from sitesift.operators import overlay as ov
from sitesift.operators import proximity as px
from sitesift.operators.matching import token_set_score
from sitesift.operators.quantiles import group_quantiles

SQ = np.array([[0, 0], [1000, 0], [1000, 1000], [0, 1000]], float)


def test_union_area():
    assert abs(ov.clipped_union_area(SQ, [SQ * 0.5, SQ * 0.5]) - 250_000) < 1e-6
    tri = np.array([[0, 0], [1000, 0], [0, 1000]], float)
    assert abs(ov.clipped_union_area(SQ, [tri]) - 500_000) < 1e-6
    a = np.linspace(0, 2 * math.pi, 64, endpoint=False)
    disc = np.column_stack([500 + 300 * np.cos(a), 500 + 300 * np.sin(a)])
    whole = ov.clipped_union_area(SQ, [disc])
    assert abs(whole / (math.pi * 300 ** 2) - 1) < 0.01
    parts = sum(ov.clipped_union_area(SQ, [disc], (x, y, x + 250, y + 250)) for x in range(0, 1000, 250) for y in range(0, 1000, 250))
    assert abs(parts - whole) < 1e-3


def test_lines_nearest_equals_brute_force(spark):
    rnd = random.Random(3)
    sites = [(i, rnd.uniform(0, 40000), rnd.uniform(0, 40000)) for i in range(40)]
    lines = [(i, *[rnd.uniform(0, 40000) for _ in range(4)]) for i in range(60)]
    s = spark.createDataFrame(sites, "eia_id long, x double, y double")
    box = s.select("eia_id", geo.box_ring(F.col("x") - 300, F.col("y") - 300, F.col("x") + 300, F.col("y") + 300).alias("ring"))
    f = spark.createDataFrame(lines, "feature_id long, a double, b double, c double, d double")
    f = px.line_segments(f.select("feature_id", F.array(geo.point(F.col("a"), F.col("b")), geo.point(F.col("c"), F.col("d"))).alias("l")), "l", 3000.0)

    def dist(x, y, ln):   # box to segment by dense sampling
        t = np.linspace(0, 1, 4001)
        px_, py_ = ln[1] + t * (ln[3] - ln[1]), ln[2] + t * (ln[4] - ln[2])
        return float(np.min(np.hypot(np.maximum(np.abs(px_ - x) - 300, 0), np.maximum(np.abs(py_ - y) - 300, 0))))
    got = {r.eia_id: r for r in px.nearest_features(box, f, 8000.0, "feature_id", [], points_only=False).collect()}
    for i, x, y in sites:
        best = min(dist(x, y, ln) for ln in lines)
        if best <= 7900:
            assert abs(got[i].d - best) < 12
        elif best > 8100:
            assert i not in got


def test_quantiles_do_not_depend_on_the_bucket(spark):
    rnd = random.Random(1)
    v = [(i % 3, round(rnd.gauss(0, 5), 2)) for i in range(900)]
    df = spark.createDataFrame(v, "g int, v double")
    for step in (0.1, 1000.0):
        for r in group_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.996}, step).collect():
            x = [b for a, b in v if a == r.g]
            assert abs(r.a - np.quantile(x, 0.25)) < 1e-9 and abs(r.b - np.quantile(x, 0.996)) < 1e-9


def test_name_scores():
    assert token_set_score("taygete 2", "taygete slr unit2") > 60
    assert token_set_score("alpha", "alpha u1") == 100 and token_set_score("", "x") == 0
    assert abs(token_set_score("abcd", "abce") - 75) < 1e-9
    assert token_set_score("prospero", "zzz", 85) == 0
