"""Areas shared by polygons, flood shares, host parcels and same-owner expansion.

The exact area kernel is a small numpy helper; Spark brings it one pair, or one site tile with the distinct zones that
cross it. Tiles bound the work of a task: a site under very many zones is spread over its tiles and copies of a zone
collapse before they are joined.
"""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..functions.nulls import is_true, ratio
from ..functions.text import norm_owner, percent_text
from ..session import cut_lineage, spread


# tasks get the kernel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- kernel: rings cut to a window, vertical slabs between their vertices and crossings -------------------------------------
PAIRS = 1 << 20  # edge pairs, or edges in slabs, held at a time


def _next(ring: np.ndarray) -> np.ndarray:
    """Index of the point that follows each one in its ring; rings stand one behind the other."""
    after = np.arange(1, len(ring) + 1)
    ends = np.flatnonzero(np.append(ring[1:] != ring[:-1], True)) if len(ring) else np.empty(0, int)
    after[ends] = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return after


def _cut(points: np.ndarray, ring: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings (points, each with its ring) inside axis-parallel windows, one for each ring, one side after the other. Pieces stay
    joined along the sides, where edges that run there and back enclose nothing."""
    for axis, side, keep in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        bound = window[ring, side]
        inside = keep * (points[:, axis] - bound) >= 0
        if inside.all():
            continue
        after = _next(ring)
        leaves = inside != inside[after]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(leaves, (bound - points[:, axis]) / (points[after, axis] - points[:, axis]), 0.0)
        at = points + t[:, None] * (points[after] - points)
        at[:, axis] = bound
        # each vertex inside stays; each edge that leaves or enters adds the point where it does
        both, use = np.stack([points, at], axis=1).reshape(-1, 2), np.stack([inside, leaves], axis=1).ravel()
        points, ring = both[use], np.repeat(ring, 2)[use]
    return points, ring


def _ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first[row] + 0 .. count[row] - 1) for every row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _parts(count: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows with about PAIRS items each."""
    total = np.cumsum(count)
    cuts = np.searchsorted(total, np.arange(PAIRS, total[-1] if len(total) else 0, PAIRS))
    ends = np.unique(np.concatenate([cuts + 1, [len(count)]]))
    return list(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True))


def _crossings(e: np.ndarray, job: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, job) of every crossing of two edges (x1 <= x2) of one job. Edges are sorted by their left end, so only those that
    overlap in x, and then in y, are compared; copies of an edge once."""
    order = np.lexsort((e[:, 3], e[:, 2], e[:, 1], e[:, 0], job))
    e, job = e[order], job[order]
    new = np.append(True, (job[1:] != job[:-1]) | (e[1:] != e[:-1]).any(axis=1))[:len(e)]
    e, job = e[new], job[new]
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    # left ends at or before each right end, of its job and those ahead
    n = len(e)
    order = np.lexsort((np.repeat([0, 1], n), np.concatenate([e[:, 0], e[:, 2]]), np.concatenate([job, job])))
    upto = np.empty(2 * n, int)
    upto[order] = np.cumsum(order < n)
    count = upto[n:] - np.arange(n) - 1
    found = []
    for p, q in _parts(count):
        i, j = _ragged(np.arange(p, q) + 1, count[p:q])
        i = i + p
        meet = (low[i] <= high[j]) & (low[j] <= high[i])
        i, j = i[meet], j[meet]
        a, b = e[i], e[j]
        d1, d2, g = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2], b[:, :2] - a[:, :2]
        den = d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (g[:, 0] * d2[:, 1] - g[:, 1] * d2[:, 0]) / den
            u = (g[:, 0] * d1[:, 1] - g[:, 1] * d1[:, 0]) / den
        hit = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        found.append((a[hit, 0] + t[hit] * d1[hit, 0], job[i[hit]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0), np.empty(0, int))


def _rings(shape) -> list[np.ndarray]:
    """A shape's rings: parts and holes, even-odd over all of them. A single ring is a shape too."""
    return [np.asarray(shape, float)] if isinstance(shape, np.ndarray) and shape.ndim == 2 else [np.asarray(r, float) for r in shape]


def clipped_union_area(clip: np.ndarray, zones: list, tile=None) -> float:
    """Area of clip ∩ (union of zones), optionally inside tile (x0, y0, x1, y1)."""
    return shared_area([clip], zones, tile)


def shared_area(clips: list, zones: list, tile=None) -> float:
    """Area of (union of clips) ∩ (union of zones), optionally inside tile (x0, y0, x1, y1). Both are lists of shapes."""
    return float(shared_areas([(clips, zones, tile)])[0])


def shared_areas(jobs: list) -> np.ndarray:
    """shared_area of many (clips, zones, tile) at once, in runs of about PAIRS points."""
    out = np.zeros(len(jobs))
    flat = [[(own, _rings(s)) for own, side in ((True, clips), (False, zones)) for s in side] for clips, zones, _ in jobs]
    for p, q in _parts(np.array([sum(len(r) for _, s in job for r in s) for job in flat], int)):
        rings = [(r, k - p, own) for k in range(p, q) for own, s in flat[k] for r in s]
        size = np.array([len(r) for r, _, _ in rings], int)
        if not size.sum():
            continue
        shape = np.repeat(np.arange(sum(len(job) for job in flat[p:q])), [len(s) for job in flat[p:q] for _, s in job])
        window = np.tile([-np.inf, -np.inf, np.inf, np.inf], (q - p, 1))
        tiled = [k - p for k in range(p, q) if jobs[k][2] is not None]
        if tiled:
            window[tiled] = [jobs[k + p][2] for k in tiled]
        out[p:q] = _areas(np.concatenate([r.reshape(-1, 2) for r, _, _ in rings]), np.repeat(np.arange(len(rings)), size), shape, np.array([k for _, k, _ in rings]), np.array([own for *_, own in rings]), window)
    return out


def _areas(points: np.ndarray, ring: np.ndarray, shape: np.ndarray, job: np.ndarray, clip: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Areas of jobs. Points have their ring; rings have their shape, their job and whether they are a clip's; jobs have a window.

    Rings are first cut to the window and the box of the clips, so the work follows what lies there. Between two neighbouring
    vertices or crossings no edges meet: on the middle line of such a slab the boundaries of each shape pair up, and the length
    that is inside any clip and any zone, times the slab's width, is the area."""
    n = len(window)
    own, of = clip[ring], job[ring]
    low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
    np.minimum.at(low, of[own], points[own])
    np.maximum.at(high, of[own], points[own])
    window = np.hstack([np.maximum(window[:, :2], low), np.minimum(window[:, 2:], high)])
    wide = (window[:, 0] < window[:, 2]) & (window[:, 1] < window[:, 3])
    points, ring = points[wide[of]], ring[wide[of]]
    points, ring = _cut(points, ring, window[job])
    use = np.bincount(ring, minlength=len(job))[ring] >= 3
    # jobs with nothing left on one side are done
    left = lambda side: np.bincount(job[ring[use & (clip[ring] == side)]], minlength=n) > 0
    use &= (left(True) & left(False))[job[ring]]
    points, ring = points[use], ring[use]
    if not len(points):
        return np.zeros(n)
    edges, of = np.hstack([points, points[_next(ring)]]), job[ring]
    swap = edges[:, 0] > edges[:, 2]
    edges[swap] = edges[swap][:, [2, 3, 0, 1]]
    cross, cross_of = _crossings(edges, of)
    xs, xs_of = np.concatenate([edges[:, 0], edges[:, 2], cross]), np.concatenate([of, of, cross_of])
    order = np.lexsort((xs, xs_of))
    new = np.append(True, (np.diff(xs[order]) != 0) | (np.diff(xs_of[order]) != 0))
    place = np.empty(len(xs), int)
    place[order] = np.cumsum(new) - 1
    xs, xs_of = xs[order][new], xs_of[order][new]
    sloped = edges[:, 0] < edges[:, 2]  # upright edges bound slabs only
    first, last = place[:len(edges)][sloped], place[len(edges):2 * len(edges)][sloped]
    edges, owner, own = edges[sloped], shape[ring[sloped]], clip[ring[sloped]]
    mid, width, total = (xs[1:] + xs[:-1]) / 2, np.diff(xs), np.zeros(n)
    active = np.cumsum(np.bincount(first, minlength=len(xs)) - np.bincount(last, minlength=len(xs)))[:-1]
    for p, q in _parts(active):
        lo, hi = np.maximum(first, p), np.minimum(last, q)
        use = np.flatnonzero(lo < hi)
        row, slab = _ragged(lo[use], (hi - lo)[use])
        row = use[row]
        e = edges[row]
        y = e[:, 1] + (e[:, 3] - e[:, 1]) * (mid[slab] - e[:, 0]) / (e[:, 2] - e[:, 0])
        order = np.lexsort((y, owner[row], slab))
        y, row, slab = y[order], row[order], slab[order]
        step = 1 - 2 * (np.arange(len(y)) % 2)  # a shape has an even number of edges on each line: in, out, in, ...
        order = np.lexsort((y, slab))
        y, slab, inside = y[order], slab[order], [np.cumsum(np.where(own[row] == side, step, 0)[order]) > 0 for side in (True, False)]
        together = inside[0][:-1] & inside[1][:-1] & (slab[:-1] == slab[1:])
        at = slab[:-1][together]
        total += np.bincount(xs_of[at], weights=np.diff(y)[together] * width[at], minlength=n)
    return total


def _pair_area(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    return pd.Series(shared_areas([([np.column_stack([a, b])], [np.column_stack([c, d])], None) for a, b, c, d in zip(ax, ay, bx, by, strict=True)]), dtype=float)


def overlap_area(a: Column, b: Column) -> Column:
    """Shared area of two rings."""
    xs, ys = (lambda r: F.transform(r, lambda p: p["x"])), (lambda r: F.transform(r, lambda p: p["y"]))
    return F.pandas_udf(_pair_area, "double")(xs(a), ys(a), xs(b), ys(b))


def _nested(shapes: Column, axis: str, depth: int) -> Column:
    """Coordinates of nested arrays of points as nested arrays of numbers."""
    return F.transform(shapes, (lambda p: p[axis]) if depth == 1 else (lambda r: _nested(r, axis, depth - 1)))


def _shape(xs, ys) -> list[np.ndarray]:
    return [np.column_stack([x, y]) for x, y in zip(xs, ys, strict=True)]


def _shapes_area(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    return pd.Series(shared_areas([([_shape(x, y) for x, y in zip(p, q, strict=True)], [_shape(r, s)], None) for p, q, r, s in zip(ax, ay, bx, by, strict=True)]), dtype=float)


def dissolved_overlap(parts: Column, shape: Column) -> Column:
    """Area that the union of an array of shapes shares with a shape."""
    return F.pandas_udf(_shapes_area, "double")(_nested(parts, "x", 3), _nested(parts, "y", 3), _nested(shape, "x", 2), _nested(shape, "y", 2))


def shapes_of(df: DataFrame) -> Column:
    """The shape of a row: its `rings`, or its one `ring`."""
    return F.col("rings") if "rings" in df.columns else F.array("ring")


# ---- candidates ----------------------------------------------------------------------------------------------------------
def _tiles(df: DataFrame, ring: str, size: float, grow: float = 0.0) -> DataFrame:
    """A row for each tile that the box of a ring, or of a shape, touches."""
    b = geo.shape_bounds(F.col(ring)) if dict(df.dtypes)[ring].startswith("array<array") else geo.bounds(F.col(ring))
    g = F.lit(float(grow))
    at = lambda v: F.floor(v / size)
    return (df.withColumn("_x0", at(b["xmin"] - g)).withColumn("_x1", at(b["xmax"] + g))
            .withColumn("_y0", at(b["ymin"] - g)).withColumn("_y1", at(b["ymax"] + g))
            .withColumn("_cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("_cy", F.explode(F.sequence("_y0", "_y1")))
            .drop("_x1", "_y1"))


def box_pairs(left: DataFrame, right: DataFrame, lring: str, rring: str, size: float, grow: float = 0.0) -> DataFrame:
    """Pairs whose boxes (left grown by `grow`) meet, each once, found through shared tiles."""
    # boxes are made once for a row, not for each pair that shares a tile
    boxed = lambda df, c, side: df.withColumns({f"_{side}{k}": v for k, v in (geo.shape_bounds(F.col(c)) if dict(df.dtypes)[c].startswith("array<array") else geo.bounds(F.col(c))).items()})
    l = _tiles(boxed(left, lring, "l"), lring, size, grow).withColumnsRenamed({"_x0": "_lx", "_y0": "_ly"})
    r = _tiles(boxed(right, rring, "r"), rring, size)
    first = (F.col("_cx") == F.greatest("_lx", "_x0")) & (F.col("_cy") == F.greatest("_ly", "_y0"))
    g = F.lit(float(grow))
    meet = ((F.col("_lxmin") - g <= F.col("_rxmax")) & (F.col("_lxmax") + g >= F.col("_rxmin"))
            & (F.col("_lymin") - g <= F.col("_rymax")) & (F.col("_lymax") + g >= F.col("_rymin")))
    return l.join(r, ["_cx", "_cy"]).filter(first & meet).select(*left.columns, *right.columns)


def measured(pairs: DataFrame, by: list[str], name: str, value: Column, keep) -> DataFrame:
    """Pairs whose value passes `keep`, with the value. Pairs are dealt first, since those of few tiles are few bytes and much
    computing; a plain filter would be pushed ahead of that shuffle, and a value of Python be computed twice."""
    return spread(pairs, *by).withColumn(name, F.explode(F.filter(F.array(value), keep)))


# ---- union shares ----------------------------------------------------------------------------------------------------------
def union_areas(sites: DataFrame, zones: DataFrame, flags: list[str], tile_m: float, key: str = "eia_id") -> DataFrame:
    """Per site: key, area_m2 and <flag>_m2, the area covered by the union of the zones of each flag. Rows of one site are
    dissolved: what several of its shapes cover counts once, as does what several zones cover. Shapes are `rings` (parts and
    holes) or one `ring`."""
    s = _tiles(sites.select(key, shapes_of(sites).alias("shape")), "shape", tile_m).drop("_x0", "_y0")
    wanted = s.select(key, "_cx", "_cy").distinct()
    z = _tiles(zones.select(shapes_of(zones).alias("shape"), *flags), "shape", tile_m).drop("_x0", "_y0")
    # zones outside the sites' tiles stay where they are; copies of a zone fall together in its tile, by a hash of the shape
    z = (z.join(wanted.select("_cx", "_cy").distinct(), ["_cx", "_cy"], "left_semi").withColumn("_h", F.xxhash64("shape")).repartition("_cx", "_cy")
         .dropDuplicates(["_cx", "_cy", "_h", *flags]).drop("_h").join(wanted, ["_cx", "_cy"]))
    flat = lambda df, *more: df.select(key, "_cx", "_cy", _nested(F.col("shape"), "x", 2).alias("xs"), _nested(F.col("shape"), "y", 2).alias("ys"), *more)
    cells = [key, "_cx", "_cy"]
    out = ", ".join([f"{key} bigint", "area_m2 double", *[f"{f}_m2 double" for f in flags]])

    # one call per site and tile: the site's shapes once, and the distinct zones that cross the tile
    def one_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x0, y0 = first["_cx"] * tile_m, first["_cy"] * tile_m
        tile = (x0, y0, x0 + tile_m, y0 + tile_m)
        shapes = [_shape(a, b) for a, b in zip(pdf["xs"], pdf["ys"], strict=True)]
        own = pdf["_own"].tolist()
        clips = [c for c, o in zip(shapes, own, strict=True) if o]
        box = np.array([tile[:2], [tile[2], tile[1]], tile[2:], [tile[0], tile[3]]])
        held = [[z for z, h, o in zip(shapes, pdf[f].tolist(), own, strict=True) if h and not o] for f in flags]
        row = {key: first[key]} | dict(zip(["area_m2", *[f"{f}_m2" for f in flags]], shared_areas([(clips, z, tile) for z in [[box], *held]]), strict=True))
        return pd.DataFrame([row])

    both = flat(s, F.lit(True).alias("_own"), *[F.lit(False).alias(f) for f in flags]).unionByName(flat(z, F.lit(False).alias("_own"), *[is_true(F.col(f)).alias(f) for f in flags]))
    parts = spread(both, *cells).groupBy(*cells).applyInPandas(one_tile, out)
    return parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("area_m2", *[f"{f}_m2" for f in flags])])


def zone_flags(zones: DataFrame) -> DataFrame:
    """SFHA, floodway, 0.2 % and zone D flags of flood-hazard polygons, with the cleaned zone label."""
    text = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    sfha = text("sfha_tf") == "T"
    return (zones.withColumn("zone", F.trim(text("fld_zone"))).withColumn("sfha", sfha)
            .withColumn("floodway", text("zone_subty").contains("FLOODWAY"))
            .withColumn("x500", ~sfha & text("zone_subty").startswith("0.2 PCT"))
            .withColumn("zone_d", F.col("zone") == "D"))


def flood_overlay(sites: DataFrame, zones: DataFrame, study_areas: DataFrame, cfg: dict, tile_m: float = 2000.0) -> DataFrame:
    """Shares of each footprint in flood zones, its shapes dissolved. Outside every study area all shares are unknown; mapped
    without zones they are measured zeros."""
    c, acre = cfg["layers"]["flood"], cfg["units"]["m2_per_acre"]
    flags = ["sfha", "floodway", "x500", "zone_d"]
    z = zone_flags(zones)
    no = F.lit(False)
    layers = z.select(shapes_of(z).alias("rings"), *flags, no.alias("mapped")).unionByName(study_areas.select(shapes_of(study_areas).alias("rings"), *[no.alias(f) for f in flags], F.lit(True).alias("mapped")))
    hit = union_areas(sites, layers, [*flags, "mapped"], tile_m).withColumnRenamed("area_m2", "_area")
    named = z.filter("zone != ''").select("zone", shapes_of(z).alias("zshape"))
    touching = measured(box_pairs(sites.select("eia_id", shapes_of(sites).alias("shape")), named, "shape", "zshape", tile_m),
                        ["eia_id", "zone"], "_d2", geo.shape_shape_d2(F.col("shape"), F.col("zshape")), lambda d2: d2 <= 0)
    labels = touching.groupBy("eia_id").agg(F.array_join(F.array_sort(F.collect_set("zone")), ";").alias("flood_zones"))
    out = hit.join(labels, "eia_id", "left")
    ok = is_true(F.col("mapped_m2") > 0)
    known = lambda v: F.when(ok, v)
    share = lambda f: F.coalesce(ratio(F.col(f"{f}_m2"), F.col("_area")), F.lit(0.0))
    return out.select(
        "eia_id", F.when(ok, "ok").otherwise("not_mapped").alias("flood_status"),
        known(F.round(F.least(ratio(F.col("mapped_m2"), F.col("_area")), F.lit(1.0)), 4)).alias("nfhl_mapped_share"),
        known(F.round(share("sfha"), 4)).alias("sfha_share"),
        known(F.round(share("sfha") * F.col("_area") / acre, 1)).alias("sfha_acres"),
        known(F.round(share("floodway"), 4)).alias("floodway_share"), known(F.round(share("x500"), 4)).alias("x500_share"),
        known(F.round(share("zone_d"), 4)).alias("zone_d_share"), known(F.col("flood_zones")).alias("flood_zones"),
        known(share("sfha") >= c["flag_sfha_share"]).alias("flood_flag"))


# ---- parcels -------------------------------------------------------------------------------------------------------------
def parcel_overlaps(arrays: DataFrame, parcels: DataFrame, tile_m: float = 3000.0) -> DataFrame:
    """Overlap area of every array and parcel that meet; an array's shapes are dissolved, so what two of them cover counts once."""
    pairs = box_pairs(arrays.select("eia_id", shapes_of(arrays).alias("ashape")), parcels.withColumnRenamed("ring", "pring"), "ashape", "pring", tile_m)
    rest = [c for c in pairs.columns if c not in ("eia_id", "ashape")]
    # the shapes of one array that meet one parcel: as many as the array has panels' outlines there
    joint = pairs.groupBy("eia_id", *rest).agg(F.collect_set("ashape").alias("_parts"))
    return spread(joint, "eia_id", "parcel_id").withColumn("overlap_m2", dissolved_overlap(F.col("_parts"), F.array("pring"))).drop("_parts")


def host_parcels(overlaps: DataFrame, areas: DataFrame, cfg: dict) -> DataFrame:
    """Parcels that hold the array: overlap of at least the larger of one acre and 2 % of the array, else the largest
    overlap; a geometry published twice counts once (lowest parcel id)."""
    c = cfg["layers"]["parcels"]
    least = F.greatest(F.lit(c["min_overlap_acres"] * cfg["units"]["m2_per_acre"]), c["min_overlap_frac"] * F.col("array_m2"))
    o = overlaps.filter("overlap_m2 > 0").join(areas, "eia_id")
    top = o.groupBy("eia_id").agg(F.max("overlap_m2").alias("_top"), F.max(F.col("overlap_m2") >= least).alias("_any"))
    held = o.join(top, "eia_id").filter(F.when(F.col("_any"), F.col("overlap_m2") >= least).otherwise(F.col("overlap_m2") == F.col("_top")))
    rest = [x for x in held.columns if x not in ("eia_id", "pring", "_top", "_any")]
    pick = F.min_by(F.struct(*rest), F.col("parcel_id"))
    return (held.groupBy("eia_id", "pring").agg(pick.alias("_r"))
            .select("eia_id", "pring", *[F.col(f"_r.{x}").alias(x) for x in rest])
            .withColumn("parcel_m2", geo.ring_area(F.col("pring"))))


def owner_shares(hosts: DataFrame, cfg: dict) -> DataFrame:
    """Acres share per normalised owner of a site's host parcels; unnamed owners stay in the denominator."""
    c = cfg["layers"]["parcels"]
    per = hosts.groupBy("eia_id", norm_owner(F.col("owner"), c["owner_stopwords"]).alias("owner_n")).agg(F.sum("parcel_m2").alias("m2"))
    total = per.groupBy("eia_id").agg(F.sum("m2").alias("total_m2"))
    return per.join(total, "eia_id").withColumn("share", F.col("m2") / F.col("total_m2"))


def main_owners(shares: DataFrame, cfg: dict) -> DataFrame:
    """Largest named owner (name ascending on ties) and any named owner with at least a tenth."""
    named = shares.filter("owner_n != ''")
    best = named.groupBy("eia_id").agg(F.min_by("owner_n", F.struct(-F.col("share"), F.col("owner_n"))).alias("_best"))
    return (named.join(best, "eia_id").filter((F.col("owner_n") == F.col("_best")) | (F.col("share") >= cfg["layers"]["parcels"]["main_owner_share"]))
            .select("eia_id", "owner_n"))


def same_owner_expansion(arrays: DataFrame, hosts: DataFrame, parcels: DataFrame, owners: DataFrame, cfg: dict,
                         tile_m: float = 3000.0) -> DataFrame:
    """Parcels of a main owner reached from the hosts by touching, at most six steps and inside the neighbourhood:
    (eia_id, pring, parcel_id, step). The owner is looked at before any distance. Adjacency is found once, between parcels of one
    site, each pair of geometries once and by hashes; a step is a join on them, its result written so the plan does not grow."""
    c = cfg["layers"]["parcels"]
    owned = parcels.select("parcel_id", norm_owner(F.col("owner"), c["owner_stopwords"]).alias("owner_n"), F.col("ring").alias("pring")).filter("owner_n is not null")
    near = box_pairs(arrays.select("eia_id", F.col("ring").alias("aring")), owned, "aring", "pring", tile_m, c["neighborhood_m"])
    near = cut_lineage(near.join(owners, ["eia_id", "owner_n"], "left_semi").join(hosts.select("eia_id", "parcel_id"), ["eia_id", "parcel_id"], "left_anti"), "owned")
    near = measured(near, ["eia_id", "parcel_id"], "_d2", geo.ring_ring_d2(F.col("aring"), F.col("pring")), lambda d2: d2 <= c["neighborhood_m"] ** 2)
    mine = cut_lineage(near.select("eia_id", "parcel_id", "pring", F.xxhash64("pring").alias("h")).distinct(), "mine")
    frontier = hosts.select("eia_id", F.xxhash64("pring").alias("h"), "pring").distinct()
    nodes = cut_lineage(mine.select("eia_id", "h", "pring").unionByName(frontier).distinct(), "nodes")
    shapes, tol = nodes.select("h", "pring").dropDuplicates(["h"]), c["adjacency_tol_m"]
    box = geo.bounds(F.col("pring"))
    placed = _tiles(nodes.select("eia_id", "h", "pring", *[v.alias(k) for k, v in box.items()]), "pring", tile_m / 3, tol).drop("_x0", "_y0", "pring")
    other = placed.withColumnsRenamed({"h": "hb", **{k: f"{k}_b" for k in box}})
    meet = (F.col("xmin") - tol <= F.col("xmax_b")) & (F.col("xmax") + tol >= F.col("xmin_b")) & (F.col("ymin") - tol <= F.col("ymax_b")) & (F.col("ymax") + tol >= F.col("ymin_b"))
    pairs = placed.join(other, ["eia_id", "_cx", "_cy"]).filter((F.col("h") < F.col("hb")) & meet).select(F.col("h").alias("ha"), "hb").distinct()
    both = pairs.join(shapes.withColumnsRenamed({"h": "ha", "pring": "a"}), "ha").join(shapes.withColumnsRenamed({"h": "hb", "pring": "b"}), "hb")
    one_way = cut_lineage(measured(both, ["ha", "hb"], "_d2", geo.ring_ring_d2(F.col("a"), F.col("b")), lambda d2: d2 <= tol * tol).select("ha", "hb"), "touch")
    same = shapes.select(F.col("h").alias("ha"), F.col("h").alias("hb"))
    touch = one_way.unionByName(one_way.select(F.col("hb").alias("ha"), F.col("ha").alias("hb"))).unionByName(same)
    left, found, frontier = mine, None, frontier.select("eia_id", "h")
    for step in range(1, c["max_expansion_rounds"] + 1):
        reach = frontier.distinct().join(touch, F.col("h") == F.col("ha")).select("eia_id", F.col("hb").alias("h")).distinct()
        new = cut_lineage(left.join(reach, ["eia_id", "h"], "left_semi"))
        if new.isEmpty():
            break
        marked = new.drop("h").withColumn("step", F.lit(step))
        found = marked if found is None else found.unionByName(marked)
        left = left.join(new.select("eia_id", "parcel_id"), ["eia_id", "parcel_id"], "left_anti")
        frontier = new.select("eia_id", "h")
    return found if found is not None else mine.drop("h").filter("false").withColumn("step", F.lit(0))


def host_figures(hosts: DataFrame, cfg: dict) -> DataFrame:
    """Per site with host parcels: acres, values, newest year, sources, ids by falling size, the three largest land uses."""
    acre = cfg["units"]["m2_per_acre"]
    by_size = F.array_sort(F.collect_list(F.struct((-F.col("parcel_m2")).alias("o"), "parcel_id", F.trim(F.col("prop_id")).alias("p"))))
    h = hosts.groupBy("eia_id").agg(
        F.count(F.lit(1)).alias("n_host_parcels"), (F.sum("parcel_m2") / acre).alias("parcel_acres_host"),
        F.sum(F.col("market_value").try_cast("double")).alias("mkt_value_total"), F.sum(F.col("land_value").try_cast("double")).alias("land_value_total"),
        F.max(F.col("year").try_cast("int")).cast("string").alias("parcel_vintage"),
        F.array_join(F.array_sort(F.collect_set("source_file")), ";").alias("parcel_source"),
        F.array_join(F.array_distinct(F.filter(F.transform(by_size, lambda s: s["p"]), lambda v: v != "")), ";").alias("host_parcel_ids"))
    use = hosts.groupBy("eia_id", F.coalesce(F.col("land_use"), F.lit("None")).alias("u")).agg(F.sum("parcel_m2").alias("m"))
    use = use.groupBy("eia_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("o"), "u"))), 1, 3), lambda s: s["u"]), ";").alias("land_use_codes"))
    out = h.join(use, "eia_id", "left")
    return out.withColumns({k: F.when(F.col(k) != "", F.col(k)) for k in ("host_parcel_ids", "parcel_source", "land_use_codes")})


def parcel_metrics(ids: DataFrame, hosts: DataFrame, shares: DataFrame, added: DataFrame, areas: DataFrame, covered: DataFrame,
                   cfg: dict) -> DataFrame:
    """One row per site. covered: sites with any parcel row in their neighbourhood (tells no data from no overlap)."""
    c, acre = cfg["layers"]["parcels"], cfg["units"]["m2_per_acre"]
    named = shares.filter("owner_n != ''").groupBy("eia_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("o"), "owner_n"))).alias("_o"))
    text = F.array_join(F.transform(F.slice("_o", 1, 3), lambda s: F.concat(F.upper(s["owner_n"]), F.lit(" "), percent_text(-s["o"]))), "; ")
    named = named.select("eia_id", text.alias("host_owners"), (-F.col("_o")[0]["o"]).alias("largest_owner_share"))
    more = added.withColumn("m", geo.ring_area(F.col("pring"))).groupBy("eia_id").agg((F.sum("m") / acre).alias("_added"))
    out = ids.select("eia_id", "ac_mw", "geometry_is_point").join(areas, "eia_id", "left")
    for part in (host_figures(hosts, cfg), named, more, covered.select("eia_id").distinct().withColumn("_seen", F.lit(True))):
        out = out.join(part, "eia_id", "left")
    ok, host, arr = F.col("n_host_parcels").isNotNull(), F.col("parcel_acres_host"), F.col("array_m2") / acre
    out = (out.withColumn("parcel_status", F.when(ok, "ok").when(F.col("_seen"), "no_parcel_overlap").otherwise("no_parcel_data"))
           .withColumn("adjacent_same_owner_acres", F.when(ok, F.coalesce("_added", F.lit(0.0))))
           .withColumn("parcel_acres_unified", host + F.col("adjacent_same_owner_acres"))
           .withColumn("array_acres_calc", arr).withColumn("host_cover_share", ratio(arr, host))
           .withColumn("headroom_pct_host", ratio(host - arr, arr))
           .withColumn("headroom_pct_unified", ratio(F.col("parcel_acres_unified") - arr, arr))
           .withColumn("acres_per_mw_parcel", ratio(host, F.col("ac_mw")))
           .withColumn("unified_land_control", F.when(ok, is_true(F.col("largest_owner_share") >= c["unified_min_owner_share"])))
           .withColumn("land_value_per_acre", ratio(F.col("land_value_total"), host))
           .withColumn("parcels_confidence", F.when(ok, F.when(F.col("geometry_is_point"), "low").when(
               (F.col("host_cover_share") < c["medium_cover_below"]) | (F.col("n_host_parcels") > c["medium_parcels_above"]), "medium").otherwise("high"))))
    return (out.withColumn("n_host_parcels", F.coalesce("n_host_parcels", F.lit(0)))
            .withColumn("host_owners", F.when(F.col("host_owners") != "", F.col("host_owners")))
            .drop("land_value_total", "_added", "_seen", "array_m2", "ac_mw", "geometry_is_point"))


def parcels_layer(ids: DataFrame, arrays: DataFrame, parcels: DataFrame, cfg: dict, tile_m: float = 3000.0) -> DataFrame:
    """Whole parcel layer. Overlaps and hosts feed several results, so they are cut to shared storage once."""
    c = cfg["layers"]["parcels"]
    areas = arrays.groupBy("eia_id").agg(F.sum(geo.ring_area(F.col("ring"))).alias("array_m2"))
    hosts = cut_lineage(host_parcels(parcel_overlaps(arrays, parcels, tile_m), areas, cfg))
    shares = owner_shares(hosts, cfg)
    added = same_owner_expansion(arrays, hosts, parcels, main_owners(shares, cfg), cfg, tile_m)
    covered = box_pairs(arrays.select("eia_id", F.col("ring").alias("aring")), parcels.select(F.col("ring").alias("pring")).distinct(),
                        "aring", "pring", tile_m, c["neighborhood_m"]).select("eia_id").distinct()
    return parcel_metrics(ids, hosts, shares, added, areas, covered, cfg)
