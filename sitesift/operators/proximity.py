"""Nearest and within-radius joins as equi-joins on grid cells.

Sites and features are keyed by the square cells their (grown) boxes cover, so the join hashes instead of comparing every
pair. Features are counted per cell first: the rows of a crowded cell are dealt over as many parts as its count asks for, and
only the sites of that cell are repeated, once for each part. For the nearest feature, copies of one place collapse first and a table of occupied cells tells each site how far
it needs to look, so a dense region costs a handful of cells and not its whole radius.
"""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = 20_000  # features of a cell that one part holds
AT_ONCE = 1 << 20  # distances a task holds at a time
FULLEST = 4_096  # cells that are split at most: any other holds less than a FULLEST-th of all features


# ---- shapes ------------------------------------------------------------------------------------------------------------
def site_points(plants: DataFrame, key: str = "eia_id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Sites known by coordinates: (key, x, y); those without coordinates fall out of spatial work, not of the result."""
    x, y = geo.albers_xy(F.col(lon), F.col(lat))
    return plants.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(key, x.alias("x"), y.alias("y"))


def with_point_fallback(plants: DataFrame, rings: DataFrame, key: str = "eia_id", buffer_m: float | None = None) -> DataFrame:
    """(key, ring, geometry_is_point): the site's rings, one row each, else its point, or a disc of buffer_m around it."""
    x, y = geo.albers_xy(F.col("lon"), F.col("lat"))
    joined = plants.join(rings.select(key, F.col("ring").alias("_ring")), key, "left")
    spot = F.array(geo.point(F.col("_x"), F.col("_y"))) if buffer_m is None else geo.disc_ring(F.col("_x"), F.col("_y"), buffer_m)
    return (joined.withColumn("_x", x).withColumn("_y", y)
            .withColumn("geometry_is_point", F.col("_ring").isNull())
            .withColumn("ring", F.when(F.col("_ring").isNotNull(), F.col("_ring")).when(F.col("_x").isNotNull(), spot))
            .drop("_ring", "_x", "_y"))


def feature_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points in degrees → (..., x1, y1, x2, y2), a segment of no length."""
    x, y = geo.albers_xy(F.col(lon), F.col(lat))
    return (df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
            .withColumn("x1", x).withColumn("y1", y).withColumn("x2", F.col("x1")).withColumn("y2", F.col("y1")))


def line_segments(df: DataFrame, coords: str, max_m: float) -> DataFrame:
    """Lines (array of projected points) → segments no longer than max_m, so each covers few cells. Same point set."""
    pts = F.col(coords)
    legs = F.when(F.size(pts) > 1, F.transform(F.sequence(F.lit(0), F.size(pts) - 2),
                                               lambda i: F.struct(pts[i].alias("a"), pts[i + 1].alias("b"))))
    one = df.withColumn("_e", F.explode(legs)).drop(coords)
    ax, ay, bx, by = F.col("_e.a.x"), F.col("_e.a.y"), F.col("_e.b.x"), F.col("_e.b.y")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)) / max_m).cast("int"))
    cut = one.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda p, q, k: F.when(k == F.col("_n"), q).otherwise(p + (q - p) * k / F.col("_n"))
    i = F.col("_i")
    return (cut.withColumn("x1", at(ax, bx, i)).withColumn("y1", at(ay, by, i))
            .withColumn("x2", at(ax, bx, i + 1)).withColumn("y2", at(ay, by, i + 1)).drop("_e", "_n", "_i"))


# ---- cells -------------------------------------------------------------------------------------------------------------
def _cover(df: DataFrame, xmin, ymin, xmax, ymax, size: float) -> DataFrame:
    """One row per cell of the box: adds _cx, _cy and the box's first cell _bx, _by."""
    lo, hi = (lambda v: F.floor(v / size)), (lambda v: F.floor(v / size))
    return (df.withColumn("_bx", lo(xmin)).withColumn("_by", lo(ymin))
            .withColumn("_cx", F.explode(F.sequence(F.col("_bx"), hi(xmax))))
            .withColumn("_cy", F.explode(F.sequence(F.col("_by"), hi(ymax)))))


def _site_box(sites: DataFrame) -> DataFrame:
    if "ring" in sites.columns:
        return sites.filter("ring is not null").withColumns({f"_{k}": v for k, v in geo.bounds(F.col("ring")).items()})
    return sites.withColumns({"_xmin": F.col("x"), "_xmax": F.col("x"), "_ymin": F.col("y"), "_ymax": F.col("y")})


def crowded_cells(cells: DataFrame, split: int = SPLIT) -> DataFrame:
    """(_cx, _cy, _parts) of the fullest cells with more than `split` rows, FULLEST of them at most. Equal counts go by place,
    so that every use of the table splits the same cells."""
    return (cells.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > split)
            .orderBy(F.desc("_n"), "_cx", "_cy").limit(FULLEST)
            .select("_cx", "_cy", F.ceil(F.col("_n") / split).cast("int").alias("_parts")))


def met_in_cells(sites: DataFrame, feats: DataFrame, fid: str, split: int = SPLIT) -> DataFrame:
    """Sites and features, both with their cells, joined on the cell. Each pair of a cell once; sites are copied in split
    cells alone. The table of split cells is broadcast: it has FULLEST rows at most. Sites are not: the planner takes them for as
    small as their file, though each has become a row for every cell it reaches."""
    crowded = F.broadcast(crowded_cells(feats.select("_cx", "_cy"), split))
    parts = F.coalesce("_parts", F.lit(1))
    s = (sites.join(crowded, ["_cx", "_cy"], "left")
         .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts"))
    f = (feats.join(crowded, ["_cx", "_cy"], "left")
         .withColumn("_part", F.pmod(F.xxhash64(fid, "x1", "y1", "x2", "y2"), parts).cast("int")).drop("_parts"))
    return s.join(f.hint("merge"), ["_cx", "_cy", "_part"])


def _distance(sites: DataFrame, points_only: bool) -> Column:
    """Metres between the joined site and feature columns."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    if "ring" in sites.columns:
        return F.sqrt(geo.ring_point_d2(F.col("ring"), x1, y1) if points_only
                      else geo.ring_segment_d2(F.col("ring"), x1, y1, x2, y2))
    x, y = F.col("x"), F.col("y")
    return F.sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)) if points_only else F.sqrt(geo.point_segment_d2(x, y, x1, y1, x2, y2))


def _cell_reach(sites: DataFrame, size: float) -> tuple[Column, Column]:
    """Squared distances of a site and its cell: none of the cell's places is nearer than the first, none farther than the second."""
    ax = F.col("ring")[0]["x"] if "ring" in sites.columns else F.col("x")
    ay = F.col("ring")[0]["y"] if "ring" in sites.columns else F.col("y")
    left, low = F.col("_cx") * size, F.col("_cy") * size
    zero = F.lit(0.0)
    gapx = F.greatest(zero, left - F.col("_xmax"), F.col("_xmin") - (left + size))
    gapy = F.greatest(zero, low - F.col("_ymax"), F.col("_ymin") - (low + size))
    farx, fary = F.greatest(F.abs(left - ax), F.abs(left + size - ax)), F.greatest(F.abs(low - ay), F.abs(low + size - ay))
    return gapx * gapx + gapy * gapy, farx * farx + fary * fary


def _feature_cells(feats: DataFrame, size: float) -> DataFrame:
    return _cover(feats, F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"), size)


def _boxes_within(r: Column) -> Column:
    """Cheap test before the exact one: the boxes of site and segment are no farther apart than r."""
    zero = F.lit(0.0)
    gx = F.greatest(zero, F.least("x1", "x2") - F.col("_xmax"), F.col("_xmin") - F.greatest("x1", "x2"))
    gy = F.greatest(zero, F.least("y1", "y2") - F.col("_ymax"), F.col("_ymin") - F.greatest("y1", "y2"))
    return gx * gx + gy * gy <= r * r


def _once(d: Column, r: Column) -> Column:
    """Rows with d <= r, computing d a single time (a filter on it would be pushed down and computed again)."""
    return F.explode(F.filter(F.array(d), lambda v: v <= r))


def within_pairs(sites: DataFrame, feats: DataFrame, radius_m: float, fid: str, key: str = "eia_id",
                 points_only: bool = True, split: int = SPLIT) -> DataFrame:
    """Every (site, feature segment) at most radius_m apart with its distance `d`, each pair once. A feature cut into
    several segments gives several rows; use within_features to keep its nearest."""
    grown = _site_box(sites)
    r = F.lit(float(radius_m))
    s = (_cover(grown, F.col("_xmin") - r, F.col("_ymin") - r, F.col("_xmax") + r, F.col("_ymax") + r, radius_m)
         .withColumnsRenamed({"_bx": "_sbx", "_by": "_sby"}))
    f = _feature_cells(feats, radius_m)
    first = (F.col("_cx") == F.greatest("_sbx", "_bx")) & (F.col("_cy") == F.greatest("_sby", "_by"))
    keep = [key, *[c for c in feats.columns if c not in ("x1", "y1", "x2", "y2")]]
    near = met_in_cells(s, f, fid, split).filter(first & _boxes_within(r))
    if points_only and "ring" not in sites.columns:  # plain arithmetic: twice costs less than an array around it
        return near.select(*keep, _distance(sites, True).alias("d")).filter(F.col("d") <= r)
    return near.select(*keep, _once(_distance(sites, points_only), r).alias("d"))


def within_features(sites: DataFrame, feats: DataFrame, radius_m: float, fid: str, key: str = "eia_id",
                    points_only: bool = True, site_parts: bool = False) -> DataFrame:
    """within_pairs with one row per site and feature, at the smallest distance of their parts."""
    pairs = within_pairs(sites, feats, radius_m, fid, key, points_only)
    if points_only and not site_parts:
        return pairs
    rest = [c for c in pairs.columns if c not in (key, fid, "d")]
    return pairs.groupBy(key, fid, *rest).agg(F.min("d").alias("d"))


def within_counts(sites: DataFrame, feats: DataFrame, radius_m: float, by=(), key: str = "eia_id", fine: int = 12, split: int = SPLIT,
                  inside=None) -> DataFrame:
    """How many point features lie within radius_m of each site, for each value of the `by` columns: (key, *by, n), the counts
    of within_pairs without its pairs. Cells that lie inside the radius as a whole bring one number, features are compared
    along its edge alone, those of one place and value once. `inside(d)` is the test of a distance, d <= radius_m if not given."""
    by, size, r = list(by), radius_m / fine, F.lit(float(radius_m))
    # written, so that the planner knows their size: where they are small the sites and their counts stay in one place
    places = cut_lineage(_feature_cells(feats, size).groupBy(*by, "_cx", "_cy", "x1", "y1", "x2", "y2").agg(F.count(F.lit(1)).alias("n")), "places")
    totals = cut_lineage(places.groupBy(*by, "_cx", "_cy").agg(F.sum("n").alias("n")), "totals")
    near2, far2 = _cell_reach(sites, size)
    cells = (_cover(_site_box(sites), F.col("_xmin") - r, F.col("_ymin") - r, F.col("_xmax") + r, F.col("_ymax") + r, size)
             .withColumn("_near2", near2).withColumn("_far2", far2).filter(F.col("_near2") <= r * r * (1 + 1e-9)))
    # the margin leaves places a rounding away from the radius to the exact test
    whole = F.col("_far2") <= r * r * (1 - 1e-9)
    full = cells.filter(whole).select(key, "_cx", "_cy").join(totals.hint("merge"), ["_cx", "_cy"]).select(key, *by, "n")  # no broadcast of the sites' cells
    edge = cells.filter(~whole).drop("_near2", "_far2", "_bx", "_by")
    test = inside or (lambda d: d <= r)
    part = met_in_cells(edge, places, "n", split).select(key, *by, "n", _distance(sites, True).alias("d")).filter(test(F.col("d"))).drop("d")
    return full.unionByName(part).groupBy(key, *by).agg(F.sum("n").alias("n"))


def _totals(sites: pd.DataFrame, feats: pd.DataFrame, radius_m: float, key: str, by: list[str], maxima: list[str]) -> pd.DataFrame:
    """One tile's rows of within_totals."""
    group = feats.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(feats), int)
    order = np.argsort(group, kind="stable")
    feats = feats.iloc[order]
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    x, y = feats["x1"].to_numpy(), feats["y1"].to_numpy()
    step, out = max(1, AT_ONCE // len(feats)), []
    labels = {c: feats[c].to_numpy(object)[starts] for c in by}
    for first in range(0, len(sites), step):
        some = sites.iloc[first:first + step]
        dx, dy = some["x"].to_numpy()[:, None] - x, some["y"].to_numpy()[:, None] - y
        held = np.sqrt(dx * dx + dy * dy) <= radius_m
        n = np.add.reduceat(held, starts, axis=1, dtype=np.int64)
        i, j = np.nonzero(n)
        rows = {key: some[key].to_numpy()[i], **{c: v[j] for c, v in labels.items()}, "n": n[i, j]}
        for c in maxima:
            rows[c] = np.maximum.reduceat(np.where(held, feats[c].to_numpy(), -np.inf), starts, axis=1)[i, j]
        out.append(rows)
    return pd.DataFrame({c: pd.Series(np.concatenate([rows[c] for rows in out]), dtype=object if c in labels else None) for c in out[0]})


def within_totals(sites: DataFrame, feats: DataFrame, radius_m: float, by=(), maxima=(), key: str = "eia_id", split: int = SPLIT) -> DataFrame:
    """How many point features lie within radius_m of each site (a point) and the greatest of the `maxima` (numbers, null is
    none) among them, for each value of the `by` columns: (key, *by, n, *maxima), the figures of within_pairs without its pairs.
    Sites are sent to the tiles they reach, features to their own; a tile's task gives totals, no rows of pairs. A tile of more than
    `split` features or sites is dealt to several tasks."""
    by, maxima, r = list(by), list(maxima), F.lit(float(radius_m))
    near2, _ = _cell_reach(sites, radius_m)
    s = (_cover(_site_box(sites), F.col("_xmin") - r, F.col("_ymin") - r, F.col("_xmax") + r, F.col("_ymax") + r, radius_m)
         .filter(near2 <= r * r * (1 + 1e-9)).select(key, "x", "y", "_cx", "_cy"))
    f = feats.select(*by, *[F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(c) for c in maxima], "x1", "y1",
                     F.floor(F.col("x1") / radius_m).alias("_cx"), F.floor(F.col("y1") / radius_m).alias("_cy"))
    sizes = [(s, "_lot", F.xxhash64(key, "x", "y")), (f, "_part", F.xxhash64("x1", "y1", *by))]
    crowded = [F.broadcast(crowded_cells(d.select("_cx", "_cy"), split).withColumnRenamed("_parts", f"{c}s")) for d, c, _ in sizes]
    dealt = []
    for own, (d, _, _) in enumerate(sizes):
        for k, (_, c, place) in enumerate(sizes):
            n = F.coalesce(f"{c}s", F.lit(1))
            d = d.join(crowded[k], ["_cx", "_cy"], "left").withColumn(c, F.pmod(place, n).cast("int") if k == own else F.explode(F.sequence(F.lit(0), n - 1))).drop(f"{c}s")
        dealt.append(d.groupBy("_cx", "_cy", "_lot", "_part"))
    kinds = dict(sites.dtypes) | dict(feats.dtypes)
    out = ", ".join([f"`{c}` {kinds[c]}" for c in (key, *by)] + ["n long"] + [f"`{c}` double" for c in maxima])

    def tile(some: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if some.empty or theirs.empty:
            return pd.DataFrame(columns=[key, *by, "n", *maxima], dtype=object)
        return _totals(some, theirs, float(radius_m), key, by, maxima)

    totals = dealt[0].cogroup(dealt[1]).applyInPandas(tile, out)
    most = [F.max(F.when(F.col(c) > float("-inf"), F.col(c))).alias(c) for c in maxima]
    return totals.groupBy(key, *by).agg(F.sum("n").alias("n"), *most)


def nearest_features(sites: DataFrame, feats: DataFrame, radius_m: float, fid: str, keep, key: str = "eia_id",
                     points_only: bool = True, fine: int = 8, split: int = SPLIT) -> DataFrame:
    """Per site its nearest feature within radius_m (lowest id on ties): key, d, fid and the kept attributes. Sites with
    none are absent here; callers left-join, so 'none within' stays a null distance."""
    attrs = list(dict.fromkeys([fid, *keep]))
    spot = ["x1", "y1", "x2", "y2"]
    places = (feats.groupBy(*spot).agg(F.min_by(F.struct(*attrs), F.col(fid)).alias("_a"))
              .select(*spot, *[F.col(f"_a.{c}").alias(c) for c in attrs]))
    size = radius_m / fine
    r = F.lit(float(radius_m))
    taken = (places.select(F.floor(F.col("x1") / size).alias("_cx"), F.floor(F.col("y1") / size).alias("_cy")).distinct()
             .withColumn("_hit", F.lit(True)))
    s = _cover(_site_box(sites).withColumn("_sid", F.xxhash64(key, "_xmin", "_ymin", "_xmax", "_ymax")),
               F.col("_xmin") - r, F.col("_ymin") - r, F.col("_xmax") + r, F.col("_ymax") + r, size)
    near2, far2 = _cell_reach(sites, size)
    site_cols = [c for c in ("ring", "x", "y") if c in sites.columns]
    cells = s.select(key, "_sid", *site_cols, "_cx", "_cy", near2.alias("_near2"), far2.alias("_far2")).filter(F.col("_near2") <= r * r)
    reach = F.least(F.coalesce(F.min(F.when(F.col("_hit"), F.col("_far2"))).over(Window.partitionBy("_sid")), r * r), r * r)
    # a site's cells number (2 * fine + 1) squared: the window is bounded
    look = (cells.join(taken, ["_cx", "_cy"], "left").withColumn("_reach", reach)
            .filter(F.col("_near2") <= F.col("_reach")).drop("_near2", "_far2", "_reach", "_hit", "_sid"))
    pairs = met_in_cells(look, _feature_cells(places, size), fid, split).select(key, *attrs, _once(_distance(sites, points_only), r).alias("d"))
    best = F.min_by(F.struct("d", *attrs), F.struct("d", fid))
    return (pairs.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.d").alias("d"), *[F.col(f"_b.{c}").alias(c) for c in attrs]))


def nearest_with_radius(ids: DataFrame, near: DataFrame, dist_name: str, renames: dict, m_per_mi: float, key: str = "eia_id") -> DataFrame:
    """All ids with miles and attributes; beyond the radius both are null."""
    cols = [(F.col("d") / m_per_mi).alias(dist_name), *[F.col(a).alias(b) for a, b in renames.items()]]
    return ids.select(key).join(near.select(key, *cols), key, "left")


def radius_counts(sites: DataFrame, feats: DataFrame, radii, m_per_mi: float, key: str = "eia_id") -> DataFrame:
    """(key, _n0, _n1, ...) per site with any point feature within the largest radius (miles): how many each radius holds."""
    far = max(radii)
    each = None
    for i, r in enumerate(radii):
        held = (lambda d, r=r: (d / m_per_mi <= r) & (d <= far * m_per_mi))
        n = within_counts(sites, feats, r * m_per_mi, key=key, inside=held).withColumn("_i", F.lit(i))
        each = n if each is None else each.unionByName(n)
    return each.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("_i") == i, F.col("n"))), F.lit(0)).alias(f"_n{i}") for i in range(len(radii))])


def adaptive_radius(counts: DataFrame, radii, need: int, key: str = "eia_id") -> DataFrame:
    """Per site of radius_counts the first radius (miles) that holds `need` features, else null, and the count at the largest."""
    chain = F.coalesce(*[F.when(F.col(f"_n{i}") >= need, float(r)) for i, r in enumerate(radii)])
    return counts.select(key, chain.alias("radius_mi"), F.col(f"_n{len(radii) - 1}").alias("n_far"))


def neighbourhood_cells(sites: DataFrame, radius_m: float, size: float) -> DataFrame:
    """Distinct cells within reach of any site: a semi-join table for reading a large layer once for all sites."""
    b = _site_box(sites)
    r = F.lit(float(radius_m))
    return (_cover(b, F.col("_xmin") - r, F.col("_ymin") - r, F.col("_xmax") + r, F.col("_ymax") + r, size)
            .select("_cx", "_cy").distinct())


def mask_scan(boxes: DataFrame, sites: DataFrame, radius_m: float, size: float | None = None, fid: str = "feature_id") -> DataFrame:
    """Rows of a boxed layer (xmin..ymax) whose box meets the grown box of any site, each once, in one pass."""
    size = size or radius_m
    cells = neighbourhood_cells(sites, radius_m, size)
    r = F.lit(float(radius_m))
    s = _site_box(sites).select((F.col("_xmin") - r).alias("_x0"), (F.col("_ymin") - r).alias("_y0"),
                                (F.col("_xmax") + r).alias("_x1"), (F.col("_ymax") + r).alias("_y1"))
    s = _cover(s, F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), size)
    f = _cover(boxes.select(fid, "xmin", "ymin", "xmax", "ymax"), F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), size)
    near = f.join(cells, ["_cx", "_cy"], "left_semi")
    meet = ((F.col("xmin") <= F.col("_x1")) & (F.col("xmax") >= F.col("_x0"))
            & (F.col("ymin") <= F.col("_y1")) & (F.col("ymax") >= F.col("_y0")))
    hits = near.join(s.drop("_bx", "_by"), ["_cx", "_cy"]).filter(meet).select(fid).distinct()
    return boxes.join(hits, fid, "left_semi")


def bbox_scan(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose box meets the given one; plain range predicates that reach the Parquet statistics."""
    return df.filter((F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south))


def bbox_filter(df: DataFrame, box, lat: str = "lat", lon: str = "lon", west: bool = False) -> DataFrame:
    """Coordinates inside (west, south, east, north); west=True first reads every longitude as western."""
    if west:
        df = df.withColumn(lon, -F.abs(F.col(lon)))
    return df.filter(F.col(lat).between(box[1], box[3]) & F.col(lon).between(box[0], box[2]))


def plant_boxes(plants: DataFrame, snap: float, half: float) -> DataFrame:
    """Distinct boxes centred on a snap grid, so that sites of one grid cell share one."""
    cy, cx = geo.grid_snap(F.col("lat"), snap), geo.grid_snap(F.col("lon"), snap)
    box = [F.bround(cx - half, 4).alias("west"), F.bround(cy - half, 4).alias("south"), F.bround(cx + half, 4).alias("east"),
           F.bround(cy + half, 4).alias("north")]
    return plants.filter("lat is not null and lon is not null").select(*box).distinct()
