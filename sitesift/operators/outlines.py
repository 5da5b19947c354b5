"""Outlines for a map: rings simplified to a tolerance, as GeoJSON text."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: degrees and decimals of the published outlines
TOLERANCE, DIGITS = 0.00005, 6


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """The ring (closing point not repeated) without points that lie within the tolerance of the line between kept ones, after
    Douglas and Peucker, from its first point and the one farthest from it. A ring that would collapse is left as it is.
    Open pieces stand on a list of their own, so a long ring needs no deep recursion."""
    n = len(ring)
    if n < 4:
        return ring
    line = np.vstack([ring, ring[:1]])
    far = int(((line - line[0]) ** 2).sum(1).argmax())
    keep, todo = {0, far, n}, [(0, far), (far, n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, p = line[b] - line[a], line[a + 1:b] - line[a]
        along = np.clip(p @ d / length, 0, 1) if (length := float(d @ d)) else np.zeros(len(p))
        off = ((p - along[:, None] * d) ** 2).sum(1)
        worst = int(off.argmax())
        if off[worst] > tolerance * tolerance:
            keep.add(a + 1 + worst)
            todo += [(a, a + 1 + worst), (a + 1 + worst, b)]
    kept = sorted(keep)[:-1]
    return ring[kept] if len(kept) >= 3 else ring


def _simplify(xs: pd.Series, ys: pd.Series, tolerance: float, digits: int) -> pd.Series:
    def one(px, py):
        rings = [simplified(np.column_stack([x, y]).astype(float), tolerance) for x, y in zip(px, py, strict=True) if len(x)]
        return [np.round(np.vstack([r, r[:1]]), digits).tolist() for r in rings]
    return pd.Series([None if px is None else one(px, py) for px, py in zip(xs, ys, strict=True)])


def coordinates(shape: Column, tolerance: float = TOLERANCE, digits: int = DIGITS) -> Column:
    """Closed, simplified rings of a shape as [[[x, y], ...], ...]."""
    axis = lambda k: F.transform(shape, lambda r: F.transform(r, lambda p: p[k]))
    return F.pandas_udf(lambda x, y: _simplify(x, y, tolerance, digits), "array<array<array<double>>>")(axis("x"), axis("y"))


def map_outlines(parts: DataFrame, tolerance: float = TOLERANCE, digits: int = DIGITS, key: str = "eia_id") -> DataFrame:
    """parts: key, part, rings (the outer ring and its holes, longitude and latitude) → key, geojson: a polygon, or a
    multipolygon of a plant's parts in their order. Parts without a ring are left out."""
    drawn = parts.filter(F.size("rings") > 0).select(key, "part", coordinates(F.col("rings"), tolerance, digits).alias("c"))
    joint = drawn.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "c"))), lambda s: s["c"]).alias("c"))
    body = F.when(F.size("c") == 1, F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(F.col("c")[0]), F.lit("}")))
    return joint.select(key, body.otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json("c"), F.lit("}"))).alias("geojson"))
