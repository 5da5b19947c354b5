"""The area kernel on rings of any shape, against analytic areas and a plain scan of points."""

import math
import time

import numpy as np
import pytest

from sitesift.operators import overlay as ov


def circle(x, y, r, n):
    a = np.linspace(0, 2 * math.pi, n, endpoint=False)
    return np.column_stack([x + r * np.cos(a), y + r * np.sin(a)])


def inside(ring, px, py):
    odd = np.zeros(px.shape, bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if y1 != y2:
            odd ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return odd


def test_long_rings_cost_what_lies_in_the_window():
    """Twenty thousand vertices over a wide area, a small site: only what crosses the site's box is worked on."""
    site = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    zone = circle(-50, 1, 51, 20_000)
    start = time.time()
    got = ov.clipped_union_area(site, [zone] * 5)
    assert time.time() - start < 2
    y = np.linspace(-1, 1, 200_001)
    want = np.trapezoid(np.clip(-50 + np.sqrt(51**2 - y**2), 0, 2), y)
    assert abs(got - want) < 1e-5


def test_whole_circle():
    assert abs(ov.clipped_union_area(circle(0, 0, 3, 20_000), [circle(0, 0, 1, 20_000)]) - math.pi) < 1e-5


@pytest.mark.parametrize("seed", range(6))
def test_stars_against_points(seed):
    """Self-crossing and overlapping rings, with and without a tile, against a fine grid of points."""
    rng = np.random.default_rng(seed)
    star = lambda: circle(*rng.uniform(3, 7, 2), 1, n := int(rng.integers(3, 25))) + rng.normal(0, 1.2, (n, 2))
    clip, zones = star(), [star() for _ in range(rng.integers(1, 5))]
    tile = None if seed % 2 else (3.0, 3.0, 6.0, 6.5)
    g = (np.arange(1500) + 0.5) / 1500 * 14 - 2
    px, py = np.meshgrid(g, g)
    want = inside(clip, px, py) & np.any([inside(z, px, py) for z in zones], axis=0)
    if tile:
        want &= (px >= tile[0]) & (px <= tile[2]) & (py >= tile[1]) & (py <= tile[3])
    got = ov.clipped_union_area(clip, zones, tile)
    assert abs(got - want.sum() * (14 / 1500) ** 2) < 0.03


def test_nothing_in_common():
    a = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    assert ov.clipped_union_area(a, []) == ov.clipped_union_area(a, [a + 5]) == ov.clipped_union_area(a, [a], (3, 3, 4, 4)) == 0.0
    assert abs(ov.clipped_union_area(a, [a + [0.5, 0], a + [0.25, 0.5]]) - (0.5 + 0.25 * 0.5)) < 1e-12


@pytest.mark.parametrize("seed", range(6))
def test_shapes_with_holes_and_parts_against_points(seed):
    """Stars with holes and further parts, several of them on both sides: even-odd inside a shape, union among shapes."""
    rng = np.random.default_rng(100 + seed)
    star = lambda size=1.2: circle(*rng.uniform(3, 7, 2), 1, n := int(rng.integers(3, 20))) + rng.normal(0, size, (n, 2))
    shape = lambda: [star() for _ in range(rng.integers(1, 4))]
    clips, zones = [shape() for _ in range(rng.integers(1, 4))], [shape() for _ in range(rng.integers(1, 4))]
    tile = None if seed % 2 else (3.0, 3.0, 6.0, 6.5)
    g = (np.arange(1500) + 0.5) / 1500 * 14 - 2
    px, py = np.meshgrid(g, g)
    held = lambda shapes: np.any([np.logical_xor.reduce([inside(r, px, py) for r in s]) for s in shapes], axis=0)
    want = held(clips) & held(zones)
    if tile:
        want &= (px >= tile[0]) & (px <= tile[2]) & (py >= tile[1]) & (py <= tile[3])
    assert abs(ov.shared_area(clips, zones, tile) - want.sum() * (14 / 1500) ** 2) < 0.03


def test_a_hole_is_outside_and_overlaps_count_once():
    box = lambda x, y, a, b: np.array([[x, y], [a, y], [a, b], [x, b]], float)
    ring = [box(0, 0, 10, 10), box(2, 2, 8, 8)]
    assert ov.shared_area([ring], [box(3, 3, 7, 7)]) == 0.0 and abs(ov.shared_area([ring], [box(0, 0, 10, 5)]) - 32) < 1e-9
    assert abs(ov.shared_area([box(0, 0, 4, 4), box(2, 0, 6, 4)], [box(-9, -9, 9, 9)]) - 24) < 1e-9
    island = [*ring, box(4, 4, 6, 6)]
    assert abs(ov.shared_area([island], [island]) - 68) < 1e-9 and ov.shared_area([], [island]) == ov.shared_area([island], []) == 0.0


def test_a_site_in_a_hole_is_apart(spark):
    from pyspark.sql import functions as F
    from sitesift.functions import geo
    b = lambda *v: geo.box_ring(*[F.lit(float(x)) for x in v])
    ring = F.array(b(0, 0, 10, 10), b(2, 2, 8, 8))
    row = spark.range(1).select(*[geo.shape_shape_d2(ring, F.array(x)).alias(n) for n, x in (("hole", b(4, 4, 6, 6)), ("edge", b(4, 4, 8, 6)), ("over", b(4, 4, 9, 6)), ("away", b(13, 0, 14, 4)), ("round", b(-1, -1, 11, 11)), ("wall", b(0.5, 0.5, 1, 1)))]).first()
    assert row.asDict() == {"hole": 4.0, "edge": 0.0, "over": 0.0, "away": 9.0, "round": 0.0, "wall": 0.0}


def test_simplified_rings():
    from sitesift.operators.outlines import simplified
    square = np.array([[0, 0], [1, 0], [2, 0], [2, 1.00001], [2, 2], [1, 2.04], [0, 2], [0, 1]], float)
    assert simplified(square, 0.001).tolist() == [[0, 0], [2, 0], [2, 2], [1, 2.04], [0, 2]]
    assert simplified(square, 0.1).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2]]
    thin = np.array([[0, 0], [1, 0], [2, 0], [1, 1e-9]], float)
    assert simplified(thin, 0.1).tolist() == thin.tolist() and len(simplified(square[:3], 9)) == 3 and len(simplified(np.empty((0, 2)), 1)) == 0
    rng = np.random.default_rng(4)
    ring = circle(0, 0, 1, 50_000) + rng.normal(0, 1e-5, (50_000, 2))
    got = simplified(ring, 1e-3)
    assert 20 < len(got) < 400
    a, b = got, np.roll(got, -1, axis=0)
    d = b - a
    for p in ring[::500]:
        t = np.clip(((p - a) * d).sum(1) / (d * d).sum(1), 0, 1)
        assert np.sqrt((((a + t[:, None] * d) - p) ** 2).sum(1).min()) <= 1e-3 + 1e-12


def test_outlines_with_holes_parts_and_nothing(spark):
    from sitesift.operators.outlines import map_outlines
    ring = lambda *ps: [dict(x=float(x), y=float(y)) for x, y in ps]
    box = ring((0, 0), (4, 0), (4, 4), (0, 4))
    rows = [(1, 0, [box, ring((1, 1), (2, 1), (2, 2))]), (2, 1, [box]), (2, 0, [ring((9, 9), (8, 9), (8, 8))]), (3, 0, []), (4, 0, None)]
    got = {r.eia_id: r.geojson for r in map_outlines(spark.createDataFrame(rows, "eia_id long, part int, rings array<array<struct<x:double,y:double>>>")).collect()}
    four = "[[0.0,0.0],[4.0,0.0],[4.0,4.0],[0.0,4.0],[0.0,0.0]]"
    assert got == {1: '{"type":"Polygon","coordinates":[' + four + ',[[1.0,1.0],[2.0,1.0],[2.0,2.0],[1.0,1.0]]]}',
                   2: '{"type":"MultiPolygon","coordinates":[[[[9.0,9.0],[8.0,9.0],[8.0,8.0],[9.0,9.0]]],[' + four + "]]}"}
