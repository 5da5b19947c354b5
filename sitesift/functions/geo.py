"""Plane and sphere geometry as Column arithmetic: projection, rings, segments, distances."""

import math

from pyspark.sql import Column, functions as F

# The GRS80 ellipsoid and the parameters of the continental equal-area conic projection (metres).
_A, _INV_F = 6378137.0, 298.257222101
_PHI1, _PHI2, _PHI0, _LON0 = 29.5, 45.5, 23.0, -96.0

_E2 = 2 / _INV_F - 1 / _INV_F ** 2
_E = math.sqrt(_E2)


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


_P1, _P2, _P0 = (math.radians(v) for v in (_PHI1, _PHI2, _PHI0))
N = (_m(_P1) ** 2 - _m(_P2) ** 2) / (_q(_P2) - _q(_P1))
C = _m(_P1) ** 2 + N * _q(_P1)
RHO0 = _A * math.sqrt(C - N * _q(_P0)) / N


def albers_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees → projected metres (Snyder 1987, ellipsoidal Albers)."""
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = _A * F.sqrt(C - N * q) / N
    theta = N * F.radians(lon - _LON0)
    return rho * F.sin(theta), RHO0 - rho * F.cos(theta)


def albers_lonlat(x: Column, y: Column, rounds: int = 5) -> tuple[Column, Column]:
    """Projected metres → degrees; the latitude iteration converges far below a millimetre in five rounds."""
    rho = F.sqrt(x * x + (RHO0 - y) * (RHO0 - y))
    q = (C - (rho * N / _A) * (rho * N / _A)) / N

    def step(phi, _i):
        s = F.sin(phi)
        k = 1 - _E2 * s * s
        return phi + k * k / (2 * F.cos(phi)) * (q / (1 - _E2) - s / k + F.ln((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    # a fold, so that the expression grows with one round and not with all of them multiplied
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.asin(q / 2), step)
    return F.degrees(F.atan2(x, RHO0 - y) / N) + _LON0, F.degrees(phi)


def great_circle_mi(lat1: Column, lon1: Column, lat2: Column, lon2: Column, earth_mi: float) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * earth_mi * F.asin(F.sqrt(a))


def grid_snap(v: Column, step: float) -> Column:
    """Nearest multiple of step, halves to even."""
    return F.bround(F.bround(v / step, 0) * step, 4)


# ---- rings: array<struct<x double, y double>>, closing point not repeated ------------------------------------------------
RING = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def disc_ring(x: Column, y: Column, radius: float, corners: int = 64) -> Column:
    step = 2 * math.pi / corners
    return F.transform(F.sequence(F.lit(0), F.lit(corners - 1)),
                       lambda i: F.struct((x + radius * F.cos(i * step)).alias("x"), (y + radius * F.sin(i * step)).alias("y")))


def edges(ring: Column) -> Column:
    """Consecutive point pairs, the last joined to the first; one point gives one edge of no length."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: F.struct(ring[i].alias("a"), ring[(i + 1) % n].alias("b")))


def ring_area(ring: Column) -> Column:
    """Shoelace area, independent of the winding."""
    twice = F.aggregate(edges(ring), F.lit(0.0),
                        lambda acc, e: acc + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    return F.abs(twice) / 2


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def ring_holds(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test."""
    def crosses(e):
        a, b = e["a"], e["b"]
        return (((a["y"] > y) != (b["y"] > y))
                & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"]))
    hits = F.aggregate(edges(ring), F.lit(0), lambda acc, e: acc + F.coalesce(crosses(e), F.lit(False)).cast("int"))
    return hits % 2 == 1


def representative_point(ring: Column) -> Column:
    """A point inside the ring: middle of the widest interior stretch of a scanline that meets no vertex."""
    def bind(value: Column, then) -> Column:
        # evaluate once and name it, so that the parts below do not repeat its whole expression
        return F.transform(F.array(value), then)[0]

    def middle(level: Column) -> Column:
        cut = F.filter(edges(ring), lambda e: (e["a"]["y"] > level) != (e["b"]["y"] > level))
        xs = F.array_sort(F.transform(cut, lambda e: e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * (level - e["a"]["y"])
                                      / (e["b"]["y"] - e["a"]["y"])))
        return bind(xs, lambda v: F.when(F.size(v) >= 2, point(F.array_max(spans(v))["x"], level)).otherwise(ring[0]))

    def spans(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.size(v) / 2).cast("int") - 1),
                           lambda i: F.struct((v[2 * i + 1] - v[2 * i]).alias("w"), ((v[2 * i + 1] + v[2 * i]) / 2).alias("x")))

    def level_of(ys: Column) -> Column:
        mid = (F.array_min(ys) + F.array_max(ys)) / 2
        return (F.array_max(F.filter(ys, lambda v: v <= mid)) + F.array_min(F.filter(ys, lambda v: v > mid))) / 2

    def inside(r: Column) -> Column:
        nonlocal ring
        ring = r
        return bind(bind(F.transform(r, lambda p: p["y"]), level_of), middle)

    return bind(ring, inside)


# ---- distances (squared, metres) ---------------------------------------------------------------------------------------
def point_segment_d2(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(len2 > 0, ((px - ax) * dx + (py - ay) * dy) / len2).otherwise(0.0)))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def _side(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segment_segment_d2(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    meet = ((_side(ax, ay, bx, by, cx, cy) * _side(ax, ay, bx, by, dx, dy) < 0)
            & (_side(cx, cy, dx, dy, ax, ay) * _side(cx, cy, dx, dy, bx, by) < 0))
    ends = F.least(point_segment_d2(ax, ay, cx, cy, dx, dy), point_segment_d2(bx, by, cx, cy, dx, dy),
                   point_segment_d2(cx, cy, ax, ay, bx, by), point_segment_d2(dx, dy, ax, ay, bx, by))
    return F.when(meet, 0.0).otherwise(ends)


def ring_segment_d2(ring: Column, x1, y1, x2, y2) -> Column:
    """Edge-to-edge: 0 when the segment starts inside the ring or touches it."""
    parts = F.transform(edges(ring), lambda e: segment_segment_d2(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], x1, y1, x2, y2))
    return F.when(ring_holds(ring, x1, y1), 0.0).otherwise(F.array_min(parts))


def ring_point_d2(ring: Column, x, y) -> Column:
    parts = F.transform(edges(ring), lambda e: point_segment_d2(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    return F.when(ring_holds(ring, x, y), 0.0).otherwise(F.array_min(parts))


def boundary_d2(a: Column, b: Column) -> Column:
    """Squared distance of the edges of two rings."""
    def to_edge(e):
        return F.array_min(F.transform(edges(b), lambda g: segment_segment_d2(
            e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], g["a"]["x"], g["a"]["y"], g["b"]["x"], g["b"]["y"])))
    return F.array_min(F.transform(edges(a), to_edge))


def ring_ring_d2(a: Column, b: Column) -> Column:
    """Edge-to-edge squared distance of two rings, 0 when one holds the other."""
    overlap = ring_holds(a, b[0]["x"], b[0]["y"]) | ring_holds(b, a[0]["x"], a[0]["y"])
    return F.when(overlap, 0.0).otherwise(boundary_d2(a, b))


# ---- shapes: arrays of rings; a point is inside where it is inside an odd number of them, so rings are parts or holes -------
SHAPE = f"array<{RING}>"


def shape_bounds(shape: Column) -> dict[str, Column]:
    return bounds(F.flatten(shape))


def shape_holds(shape: Column, x: Column, y: Column) -> Column:
    return F.aggregate(shape, F.lit(False), lambda odd, r: odd != ring_holds(r, x, y))


def shape_shape_d2(a: Column, b: Column) -> Column:
    """Edge-to-edge squared distance of two shapes, 0 where they share a point; a shape in another's hole is apart from it."""
    starts_in = lambda p, q: F.exists(q, lambda r: shape_holds(p, r[0]["x"], r[0]["y"]))
    edge = F.array_min(F.flatten(F.transform(a, lambda r: F.transform(b, lambda q: boundary_d2(r, q)))))
    return F.when(starts_in(a, b) | starts_in(b, a), 0.0).otherwise(edge)
