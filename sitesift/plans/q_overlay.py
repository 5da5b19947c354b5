"""Polygon overlay: shared areas, flood shares, host parcels, same-owner expansion."""

from pyspark.sql import functions as F

from ..config import config
from ..functions import geo, text
from ..operators import outlines, overlay as ov
from .registry import query, view

CFG = config()
R = lambda c, d=4: F.round(F.col(c), d).alias(c)
ACRE = 4046.8564224
# everything is an axis-parallel box, so the checking engine can do the same areas with rectangle arithmetic
view("sites_box", """
SELECT eia_id, s_nationkey, x - 3000e0 - half * 2e0 AS x0, y - 3000e0 - half AS y0, x + 3000e0 + half AS x1, y + 3000e0 + half * 3e0 AS y1 FROM site_geo
""")
view("zones_box", """
SELECT feature_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'AE' WHEN 'MACHINERY' THEN ' d' WHEN 'FURNITURE' THEN 'X' WHEN 'HOUSEHOLD' THEN 'A' ELSE '' END AS fld_zone,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Floodway in x' WHEN 'FURNITURE' THEN '0.2 Pct annual' ELSE NULL END AS zone_subty,
       CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 't' ELSE 'F' END AS sfha_tf,
       fx - 4000e0 - c_nationkey * 500e0 AS zx0, fy - 9000e0 AS zy0, fx + 6000e0 AS zx1, fy + 3000e0 + c_nationkey * 400e0 AS zy1
FROM feature_xy
""")
view("study_box", "SELECT n_nationkey AS study, -1100000e0 + n_nationkey * 43000e0 AS zx0, 250000e0 AS zy0, -1060000e0 + n_nationkey * 43000e0 AS zx1, 1400000e0 AS zy1 FROM nation")
view("parcel_box", """
SELECT c_custkey AS parcel_id, c_custkey % 40 * 1000e0 AS px0, floor(c_custkey / 40e0) * 1000e0 AS py0, c_custkey % 40 * 1000e0 + CASE WHEN c_nationkey = 7 THEN 990e0 ELSE 1000e0 END AS px1,
       floor(c_custkey / 40e0) * 1000e0 + 1000e0 AS py1, CASE WHEN c_nationkey = 3 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'Acme Solar, L.L.C.' WHEN c_mktsegment = 'MACHINERY' THEN 'ACME SOLAR LLC' ELSE concat('The Owner ', c_mktsegment) END AS owner,
       concat('R', CAST(c_custkey AS STRING)) AS prop_id, CASE WHEN c_nationkey < 10 THEN 'D1' WHEN c_nationkey < 20 THEN 'E' ELSE 'F2' END AS land_use,
       CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE CAST(c_acctbal AS STRING) END AS market_value, CAST(c_acctbal AS STRING) AS land_value, CAST(2020 + c_nationkey % 4 AS STRING) AS year,
       concat('file', CAST(c_nationkey % 2 AS STRING), '.gdb') AS source_file FROM customer
""")
view("array_box", """
SELECT s_suppkey AS eia_id, s_suppkey * 7919 % 39000 + 0e0 AS ax0, s_suppkey * 104729 % 36000 + 0e0 AS ay0, s_suppkey * 7919 % 39000 + 300e0 + s_suppkey % 9 * 200e0 AS ax1,
       s_suppkey * 104729 % 36000 + 250e0 + s_suppkey % 7 * 300e0 AS ay1, 2e1 + s_suppkey % 50 AS ac_mw, s_suppkey % 10 = 0 AS geometry_is_point FROM supplier
""")
BOX = lambda *c: geo.box_ring(*[F.col(x) for x in c])


def sites(t):
    return t["sites_box"].select("eia_id", BOX("x0", "y0", "x1", "y1").alias("ring"))


def zones(t):
    return t["zones_box"].select("feature_id", "fld_zone", "zone_subty", "sfha_tf", BOX("zx0", "zy0", "zx1", "zy1").alias("ring"))


def arrays(t):
    return t["array_box"].select("eia_id", "ac_mw", "geometry_is_point", BOX("ax0", "ay0", "ax1", "ay1").alias("ring"))


def parcels(t):
    p = t["parcel_box"]
    return p.select("parcel_id", "owner", "prop_id", "land_use", "market_value", "land_value", "year", "source_file", BOX("px0", "py0", "px1", "py1").alias("ring"))


def areas(t):
    return arrays(t).select("eia_id", geo.ring_area(F.col("ring")).alias("array_m2"))


def hosts(t):
    return ov.host_parcels(ov.parcel_overlaps(arrays(t), parcels(t)), areas(t), CFG)


_INT = "(least(x1, zx1) - greatest(x0, zx0)) * (least(y1, zy1) - greatest(y0, zy0))"


@query("polygon_overlap_area", f"""
SELECT eia_id, feature_id, round({_INT}, 1) AS overlap_m2 FROM sites_box, zones_box WHERE x0 < zx1 AND x1 > zx0 AND y0 < zy1 AND y1 > zy0
""")
def _(t):
    pairs = ov.box_pairs(sites(t), zones(t).select("feature_id", F.col("ring").alias("zring")), "ring", "zring", 8000.0)
    area = ov.overlap_area(F.col("ring"), F.col("zring"))
    return ov.measured(pairs, ["eia_id", "feature_id"], "overlap_m2", F.round(area, 1), lambda m2: m2 > 0).select("eia_id", "feature_id", "overlap_m2")


def union_sql(where: str, zone: str = "zones_box") -> str:
    """Union area by coordinate compression."""
    return f"""SELECT eia_id, sum((nx - x) * (ny - y)) AS m2 FROM (
      SELECT DISTINCT g.eia_id, g.x, g.nx, g.y, g.ny FROM (
        SELECT a.eia_id, a.x, a.nx, b.y, b.ny FROM (SELECT eia_id, x, lead(x) OVER (PARTITION BY eia_id ORDER BY x) AS nx FROM (SELECT DISTINCT eia_id, unnest([cx0, cx1]) AS x FROM clip) u) a
        JOIN (SELECT eia_id, y, lead(y) OVER (PARTITION BY eia_id ORDER BY y) AS ny FROM (SELECT DISTINCT eia_id, unnest([cy0, cy1]) AS y FROM clip) u) b ON a.eia_id = b.eia_id
        WHERE a.nx IS NOT NULL AND b.ny IS NOT NULL) g
      JOIN clip c ON c.eia_id = g.eia_id AND c.cx0 <= g.x AND c.cx1 >= g.nx AND c.cy0 <= g.y AND c.cy1 >= g.ny) cells GROUP BY eia_id""".replace(
        "FROM clip", f"FROM (SELECT eia_id, greatest(x0, zx0) AS cx0, least(x1, zx1) AS cx1, greatest(y0, zy0) AS cy0, least(y1, zy1) AS cy1 FROM sites_box, {zone} WHERE x0 < zx1 AND x1 > zx0 AND y0 < zy1 AND y1 > zy0 AND {where}) clip0").replace(
        "JOIN clip c", f"JOIN (SELECT eia_id, greatest(x0, zx0) AS cx0, least(x1, zx1) AS cx1, greatest(y0, zy0) AS cy0, least(y1, zy1) AS cy1 FROM sites_box, {zone} WHERE x0 < zx1 AND x1 > zx0 AND y0 < zy1 AND y1 > zy0 AND {where}) c")


_SFHA = "sfha_tf = 't'"


@query("union_area_share", f"""
SELECT s.eia_id, round(coalesce(u.m2, 0) / ((x1 - x0) * (y1 - y0)), 4) AS sfha_share FROM sites_box s LEFT JOIN ({union_sql(_SFHA)}) u ON s.eia_id = u.eia_id
""")
def _(t):
    u = ov.union_areas(sites(t), ov.zone_flags(zones(t)), ["sfha"], 6000.0)
    out = sites(t).join(u, "eia_id", "left")
    return out.select("eia_id", F.round(F.coalesce("sfha_m2", F.lit(0.0)) / geo.ring_area(F.col("ring")), 4).alias("sfha_share"))


_S = lambda w: f"SELECT eia_id, m2 FROM ({union_sql(w)}) q"


@query("flood_overlay", f"""
SELECT eia_id, flood_status, CASE WHEN ok THEN round(least(mm / area, 1), 4) END AS nfhl_mapped_share, CASE WHEN ok THEN round(sf / area, 4) END AS sfha_share, CASE WHEN ok THEN round(sf / {ACRE}, 1) END AS sfha_acres,
  CASE WHEN ok THEN round(fw / area, 4) END AS floodway_share, CASE WHEN ok THEN round(x5 / area, 4) END AS x500_share, CASE WHEN ok THEN round(zd / area, 4) END AS zone_d_share,
  CASE WHEN ok THEN zones END AS flood_zones, CASE WHEN ok THEN sf / area >= 0.1e0 END AS flood_flag
FROM (SELECT s.eia_id, (x1 - x0) * (y1 - y0) AS area, coalesce(m.m2, 0) AS mm, coalesce(m.m2, 0) > 0 AS ok, CASE WHEN coalesce(m.m2, 0) > 0 THEN 'ok' ELSE 'not_mapped' END AS flood_status, coalesce(a.m2, 0) AS sf, coalesce(b.m2, 0) AS fw, coalesce(c.m2, 0) AS x5, coalesce(d.m2, 0) AS zd, z.zones
  FROM sites_box s LEFT JOIN ({union_sql('true', 'study_box')}) m ON s.eia_id = m.eia_id LEFT JOIN ({_S(_SFHA)}) a ON s.eia_id = a.eia_id LEFT JOIN ({_S("zone_subty LIKE 'Floodway%'")}) b ON s.eia_id = b.eia_id
  LEFT JOIN ({_S("zone_subty LIKE '0.2 Pct%'")}) c ON s.eia_id = c.eia_id LEFT JOIN ({_S("fld_zone = ' d'")}) d ON s.eia_id = d.eia_id
  LEFT JOIN (SELECT eia_id, string_agg(DISTINCT upper(trim(fld_zone)), ';' ORDER BY upper(trim(fld_zone))) AS zones FROM sites_box, zones_box WHERE x0 <= zx1 AND x1 >= zx0 AND y0 <= zy1 AND y1 >= zy0 AND trim(fld_zone) <> '' GROUP BY eia_id) z ON s.eia_id = z.eia_id) f
""")
def _(t):
    study = t["study_box"].select(BOX("zx0", "zy0", "zx1", "zy1").alias("ring"))
    return ov.flood_overlay(sites(t), zones(t), study, CFG, 6000.0)


# zones with a hole: the outer box without an inner one, for the checking engine four boxes around it
view("holed_box", """
SELECT feature_id, fld_zone, zone_subty, sfha_tf, zx0, zy0, zx1, zy1, zx0 + (zx1 - zx0) / 4e0 AS hx0, zy0 + (zy1 - zy0) / 4e0 AS hy0, zx1 - (zx1 - zx0) / 8e0 AS hx1, zy1 - (zy1 - zy0) / 3e0 AS hy1 FROM zones_box
""")
view("around_box", """
SELECT feature_id, fld_zone, zone_subty, sfha_tf, zx0, zy0, hx0 AS zx1, zy1 FROM holed_box UNION ALL SELECT feature_id, fld_zone, zone_subty, sfha_tf, hx1, zy0, zx1, zy1 FROM holed_box
UNION ALL SELECT feature_id, fld_zone, zone_subty, sfha_tf, hx0, zy0, hx1, hy0 FROM holed_box UNION ALL SELECT feature_id, fld_zone, zone_subty, sfha_tf, hx0, hy1, hx1, zy1 FROM holed_box
""")
# a site of two overlapping boxes and one that lies apart
view("split_box", """
SELECT eia_id, x0, y0, x1, y1 FROM sites_box UNION ALL SELECT eia_id, x0 + (x1 - x0) / 2e0, y0 - 800e0, x1 + 1200e0, y1 - (y1 - y0) / 3e0 FROM sites_box
UNION ALL SELECT eia_id, x1 + 2000e0, y0, x1 + 2500e0, y1 FROM sites_box WHERE eia_id % 2 = 0
""")
_AREA = f"SELECT eia_id, m2 FROM ({union_sql('true', '(SELECT eia_id AS zid, x0 AS zx0, y0 AS zy0, x1 AS zx1, y1 AS zy1 FROM split_box) z').replace('sites_box', 'split_box').replace('WHERE x0', 'WHERE eia_id = zid AND x0')}) q"


def holed(t):
    return t["holed_box"].select("feature_id", "fld_zone", "zone_subty", "sfha_tf", F.array(BOX("zx0", "zy0", "zx1", "zy1"), BOX("hx0", "hy0", "hx1", "hy1")).alias("rings"))


def split_sites(t):
    return t["split_box"].select("eia_id", BOX("x0", "y0", "x1", "y1").alias("ring"))


@query("holed_overlap_area", f"SELECT eia_id, feature_id, round(sum({_INT}), 1) AS overlap_m2 FROM sites_box, around_box WHERE x0 < zx1 AND x1 > zx0 AND y0 < zy1 AND y1 > zy0 GROUP BY 1, 2")
def _(t):
    pairs = ov.box_pairs(sites(t), holed(t).select("feature_id", F.col("rings").alias("zshape")), "ring", "zshape", 8000.0)
    area = ov.dissolved_overlap(F.array(F.array("ring")), F.col("zshape"))
    return ov.measured(pairs, ["eia_id", "feature_id"], "overlap_m2", F.round(area, 1), lambda m2: m2 > 0).select("eia_id", "feature_id", "overlap_m2")


@query("dissolved_area", f"SELECT eia_id, round(m2, 1) AS area_m2 FROM ({_AREA}) a")
def _(t):
    nothing = zones(t).select("ring").limit(0).withColumn("none", F.lit(False))
    return ov.union_areas(split_sites(t), nothing, ["none"], 6000.0).select("eia_id", F.round("area_m2", 1).alias("area_m2"))


@query("dissolved_flood_share", f"""
SELECT a.eia_id, round(coalesce(u.m2, 0) / a.m2, 4) AS sfha_share, round(coalesce(f.m2, 0) / a.m2, 4) AS floodway_share, z.zones AS flood_zones FROM ({_AREA}) a LEFT JOIN ({union_sql(_SFHA, 'around_box').replace('sites_box', 'split_box')}) u ON a.eia_id = u.eia_id
LEFT JOIN ({union_sql("zone_subty LIKE 'Floodway%'", 'around_box').replace('sites_box', 'split_box')}) f ON a.eia_id = f.eia_id
LEFT JOIN (SELECT eia_id, string_agg(DISTINCT upper(trim(fld_zone)), ';' ORDER BY upper(trim(fld_zone))) AS zones FROM split_box, around_box WHERE x0 <= zx1 AND x1 >= zx0 AND y0 <= zy1 AND y1 >= zy0 AND trim(fld_zone) <> '' GROUP BY eia_id) z ON a.eia_id = z.eia_id
""")
def _(t):
    everywhere = split_sites(t).select("ring")
    return ov.flood_overlay(split_sites(t), holed(t), everywhere, CFG, 6000.0).select("eia_id", "sfha_share", "floodway_share", "flood_zones")


_HOST = """
SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY eia_id, px0, py0, px1, py1 ORDER BY parcel_id) AS dup FROM (
  SELECT *, max(ov) OVER (PARTITION BY eia_id) AS top, max(CASE WHEN ov >= mn THEN 1 ELSE 0 END) OVER (PARTITION BY eia_id) AS anyok FROM (
    SELECT a.eia_id, a.ac_mw, p.*, (ax1 - ax0) * (ay1 - ay0) AS array_m2, greatest(4046.8564224e0, 0.02e0 * (ax1 - ax0) * (ay1 - ay0)) AS mn, (px1 - px0) * (py1 - py0) AS pm2,
      (least(ax1, px1) - greatest(ax0, px0)) * (least(ay1, py1) - greatest(ay0, py0)) AS ov FROM array_box a, parcel_box p WHERE ax0 < px1 AND ax1 > px0 AND ay0 < py1 AND ay1 > py0) o) h
  WHERE CASE WHEN anyok = 1 THEN ov >= mn ELSE ov = top END) d WHERE dup = 1
"""
_OWN = "CASE WHEN owner IS NULL THEN '' WHEN owner LIKE 'A%' THEN 'acme solar' ELSE lower(substr(owner, 5)) END"


@query("host_parcels", f"SELECT eia_id, parcel_id, round(ov, 2) AS overlap_m2 FROM ({_HOST}) h")
def _(t):
    return hosts(t).select("eia_id", "parcel_id", R("overlap_m2", 2))


@query("norm_owner", f"SELECT parcel_id, {_OWN} AS owner_n FROM parcel_box")
def _(t):
    return t["parcel_box"].select("parcel_id", text.norm_owner(F.col("owner"), CFG["layers"]["parcels"]["owner_stopwords"]).alias("owner_n"))


_SHARES = f"SELECT eia_id, owner_n, m2 / sum(m2) OVER (PARTITION BY eia_id) AS share FROM (SELECT eia_id, {_OWN} AS owner_n, sum(pm2) AS m2 FROM ({_HOST}) h GROUP BY 1, 2) s"


@query("host_owner_shares", f"SELECT eia_id, owner_n, round(share, 6) AS share FROM ({_SHARES}) s")
def _(t):
    return ov.owner_shares(hosts(t), CFG).select("eia_id", "owner_n", R("share", 6))


_MAIN = f"SELECT eia_id, owner_n FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY share DESC, owner_n) AS rn FROM ({_SHARES}) s WHERE owner_n <> '') m WHERE rn = 1 OR share >= 0.1e0"
_EXPAND = f"""
WITH RECURSIVE hosts AS (SELECT eia_id, parcel_id, px0, py0, px1, py1 FROM ({_HOST}) h),
cand AS (SELECT a.eia_id, p.parcel_id, p.px0, p.py0, p.px1, p.py1 FROM array_box a JOIN parcel_box p ON power(greatest(px0 - ax1, ax0 - px1, 0), 2) + power(greatest(py0 - ay1, ay0 - py1, 0), 2) <= 9000000
  JOIN ({_MAIN}) m ON m.eia_id = a.eia_id AND m.owner_n = ({_OWN.replace('owner ', 'p.owner ').replace('substr(owner', 'substr(p.owner')}) WHERE (a.eia_id, p.parcel_id) NOT IN (SELECT (eia_id, parcel_id) FROM hosts)),
walk AS (SELECT eia_id, parcel_id, px0, py0, px1, py1, 0 AS step FROM hosts
  UNION SELECT c.eia_id, c.parcel_id, c.px0, c.py0, c.px1, c.py1, w.step + 1 FROM walk w JOIN cand c ON c.eia_id = w.eia_id AND power(greatest(c.px0 - w.px1, w.px0 - c.px1, 0), 2) + power(greatest(c.py0 - w.py1, w.py0 - c.py1, 0), 2) <= 4 WHERE w.step < 6)
"""


@query("same_owner_expansion", f"{_EXPAND} SELECT eia_id, parcel_id, CAST(min(step) AS BIGINT) AS step FROM walk WHERE step > 0 GROUP BY 1, 2")
def _(t):
    h = ov.cut_lineage(hosts(t))
    out = ov.same_owner_expansion(arrays(t), h, parcels(t), ov.main_owners(ov.owner_shares(h, CFG), CFG), CFG)
    return out.select("eia_id", "parcel_id", F.col("step").cast("bigint").alias("step"))


@query("parcel_metrics", f"""
{_EXPAND}, added AS (SELECT eia_id, sum((px1 - px0) * (py1 - py0)) / {ACRE} AS acres FROM (SELECT DISTINCT eia_id, parcel_id, px0, py0, px1, py1 FROM walk WHERE step > 0) d GROUP BY eia_id),
agg AS (SELECT eia_id, count(*) AS n, sum(pm2) / {ACRE} AS acres, any_value(array_m2) / {ACRE} AS arr, any_value(ac_mw) AS ac_mw, sum(TRY_CAST(market_value AS DOUBLE)) AS mkt, max(CAST(year AS INT)) AS yr,
  string_agg(prop_id, ';' ORDER BY pm2 DESC, parcel_id) AS host_parcel_ids FROM ({_HOST}) h GROUP BY eia_id),
top AS (SELECT eia_id, string_agg(upper(owner_n) || ' ' || CAST(CAST(round_even(share * 100e0, 0) AS BIGINT) AS VARCHAR) || '%', '; ' ORDER BY share DESC, owner_n) AS host_owners, max(share) AS big FROM (
  SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY share DESC, owner_n) AS rn FROM ({_SHARES}) s WHERE owner_n <> '') r WHERE rn <= 3 GROUP BY eia_id),
uses AS (SELECT eia_id, string_agg(land_use, ';' ORDER BY m DESC, land_use) AS land_use_codes FROM (SELECT eia_id, land_use, sum(pm2) AS m FROM ({_HOST}) h GROUP BY 1, 2) u GROUP BY eia_id)
SELECT a.eia_id, CASE WHEN g.n IS NULL THEN 'no_parcel_overlap' ELSE 'ok' END AS parcel_status, coalesce(g.n, 0) AS n_host_parcels, round(g.acres, 3) AS parcel_acres_host, round(g.acres + coalesce(d.acres, 0), 3) AS parcel_acres_unified,
  round(g.arr / g.acres, 6) AS host_cover_share, round((g.acres + coalesce(d.acres, 0) - g.arr) / g.arr, 5) AS headroom_pct_unified, round(g.acres / g.ac_mw, 5) AS acres_per_mw_parcel, t.host_owners, round(t.big, 6) AS largest_owner_share,
  CASE WHEN g.n IS NOT NULL THEN coalesce(t.big >= 0.9e0, false) END AS unified_land_control, u.land_use_codes, round(g.mkt, 2) AS mkt_value_total, CAST(g.yr AS VARCHAR) AS parcel_vintage, g.host_parcel_ids,
  CASE WHEN g.n IS NOT NULL THEN CASE WHEN a.geometry_is_point THEN 'low' WHEN g.arr / g.acres < 0.25 OR g.n > 12 THEN 'medium' ELSE 'high' END END AS parcels_confidence
FROM array_box a LEFT JOIN agg g ON a.eia_id = g.eia_id LEFT JOIN added d ON a.eia_id = d.eia_id LEFT JOIN top t ON a.eia_id = t.eia_id LEFT JOIN uses u ON a.eia_id = u.eia_id
""")
def _(t):
    out = ov.parcels_layer(arrays(t).drop("ring"), arrays(t).select("eia_id", "ring"), parcels(t), CFG)
    return out.select("eia_id", "parcel_status", "n_host_parcels", R("parcel_acres_host", 3), R("parcel_acres_unified", 3), R("host_cover_share", 6), R("headroom_pct_unified", 5),
                      R("acres_per_mw_parcel", 5), "host_owners", R("largest_owner_share", 6), "unified_land_control", "land_use_codes", R("mkt_value_total", 2), "parcel_vintage",
                      "host_parcel_ids", "parcels_confidence")


# the figures of host parcels one by one
@query("land_use_top", f"""
SELECT a.eia_id, string_agg(land_use, ';' ORDER BY m DESC, land_use) AS land_use_codes FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY m DESC, land_use) AS rn FROM (
  SELECT eia_id, land_use, sum(pm2) AS m FROM ({_HOST}) h GROUP BY 1, 2) u) a WHERE rn <= 3 GROUP BY a.eia_id
""")
def _(t):
    return ov.host_figures(hosts(t), CFG).select("eia_id", "land_use_codes")


@query("vintage_max", f"SELECT eia_id, CAST(max(CAST(year AS INT)) AS VARCHAR) AS parcel_vintage FROM ({_HOST}) h GROUP BY eia_id")
def _(t):
    return ov.host_figures(hosts(t), CFG).select("eia_id", "parcel_vintage")


@query("value_per_acre", f"SELECT eia_id, round(sum(TRY_CAST(land_value AS DOUBLE)) / (sum(pm2) / {ACRE}), 4) AS land_value_per_acre FROM ({_HOST}) h GROUP BY eia_id")
def _(t):
    return ov.host_figures(hosts(t), CFG).select("eia_id", F.round(F.col("land_value_total") / F.col("parcel_acres_host"), 4).alias("land_value_per_acre"))


@query("parcel_ids_by_size", f"SELECT eia_id, string_agg(prop_id, ';' ORDER BY pm2 DESC, parcel_id) AS host_parcel_ids FROM ({_HOST}) h GROUP BY eia_id")
def _(t):
    return ov.host_figures(hosts(t), CFG).select("eia_id", "host_parcel_ids")


@query("parcel_neighbourhood", """
SELECT eia_id, parcel_id FROM array_box, parcel_box WHERE power(greatest(px0 - ax1, ax0 - px1, 0), 2) + power(greatest(py0 - ay1, ay0 - py1, 0), 2) <= 9000000
""")
def _(t):
    pairs = ov.box_pairs(arrays(t).select("eia_id", F.col("ring").alias("aring")), parcels(t).select("parcel_id", F.col("ring").alias("pring")), "aring", "pring", 3000.0, 3000.0)
    return ov.measured(pairs, ["eia_id", "parcel_id"], "_d2", geo.ring_ring_d2(F.col("aring"), F.col("pring")), lambda d2: d2 <= 9_000_000).select("eia_id", "parcel_id")


view("outline_box", """
SELECT s_suppkey AS eia_id, 0 AS part, -106e0 + s_suppkey % 97 / 8e0 AS ox, 26e0 + s_suppkey % 61 / 8e0 AS oy, 0.5e0 + s_nationkey / 64e0 AS wx, 0.25e0 + s_nationkey / 32e0 AS wy FROM supplier
UNION ALL SELECT s_suppkey, 1, -98e0 + s_suppkey % 33 / 8e0, 31e0, 0.125e0, 0.125e0 FROM supplier WHERE s_nationkey % 4 = 0
""")
_CORNERS = "'[[[' || " + " || '],[' || ".join(f"CAST(round({x}, 6) AS VARCHAR) || ',' || CAST(round({y}, 6) AS VARCHAR)" for x, y in (("ox", "oy"), ("ox + wx", "oy"), ("ox + wx", "oy + wy"), ("ox", "oy + wy"), ("ox", "oy"))) + " || ']]]'"


@query("geojson_view", f"""
SELECT eia_id, CASE WHEN count(*) = 1 THEN '{{"type":"Polygon","coordinates":' || any_value(c) ELSE '{{"type":"MultiPolygon","coordinates":[' || string_agg(c, ',' ORDER BY part) || ']' END || '}}' AS geojson
FROM (SELECT eia_id, part, {_CORNERS} AS c FROM outline_box) o GROUP BY eia_id
""")
def _(t):
    # points on the way and a bend below the tolerance go again
    at = lambda fx, fy, bend=0.0: geo.point(F.col("ox") + F.col("wx") * fx + bend, F.col("oy") + F.col("wy") * fy)
    ring = F.array(at(0, 0), at(0.25, 0), at(0.75, 0), at(1, 0), at(1, 0.5, 0.00003), at(1, 1), at(0.5, 1), at(0, 1), at(0, 0.125, -0.00001))
    return outlines.map_outlines(t["outline_box"].select("eia_id", "part", F.array(ring).alias("rings")))
