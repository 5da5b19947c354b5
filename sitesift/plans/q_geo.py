"""Proximity: projection, nearest, within, radius ladder, line, gas, fibre, coverage, project and well layers."""

from pyspark.sql import functions as F

from ..config import config
from ..functions import geo
from ..operators import layers as ly
from ..operators import proximity as px
from .registry import query, view

CFG = config()
MI = CFG["units"]["m_per_mi"]
R = lambda c, d=4: F.round(F.col(c), d).alias(c)


def lit(v: float) -> str:
    s = repr(float(v))
    return s if "e" in s else s + "e0"


def albers_sql(lon: str, lat: str) -> tuple[str, str]:
    """The projection as SQL text, for views and oracles."""
    s = f"sin(radians({lat}))"
    e, e2 = lit(geo._E), lit(geo._E2)
    q = f"((1e0 - {e2}) * ({s} / (1e0 - {e2} * {s} * {s}) - ln((1e0 - {e} * {s}) / (1e0 + {e} * {s})) / (2e0 * {e})))"
    rho = f"({lit(geo._A)} * sqrt({lit(geo.C)} - {lit(geo.N)} * {q}) / {lit(geo.N)})"
    theta = f"({lit(geo.N)} * radians({lon} + 96e0))"
    return f"({rho} * sin({theta}))", f"({lit(geo.RHO0)} - {rho} * cos({theta}))"


def with_xy(src: str, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> str:
    ax, ay = albers_sql(lon, lat)
    return f"SELECT v.*, {ax} AS {x}, {ay} AS {y} FROM ({src}) v"


view("site_geo", with_xy("""
SELECT s_suppkey AS eia_id, s_name AS plant_name, 26e0 + (s_suppkey * 104729 % 10000) / 1000e0 AS lat, -106e0 + (s_suppkey * 7919 % 12000) / 1000e0 AS lon,
       s_suppkey % 3 = 0 AS geometry_is_point, CASE WHEN s_suppkey % 3 = 0 THEN 0e0 ELSE 200e0 + s_suppkey % 5 * 300e0 END AS half,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN 69e0 WHEN s_suppkey % 7 < 4 THEN 138e0 ELSE 345e0 END AS grid_voltage_kv,
       s_acctbal, s_nationkey
FROM supplier"""))
view("feature_pts", """
SELECT c_custkey AS feature_id, c_name AS name, c_mktsegment, c_nationkey, c_acctbal, 26e0 + (c_custkey * 15485863 % 10000) / 1000e0 AS lat,
       -106e0 + (c_custkey * 104723 % 12000) / 1000e0 AS lon FROM customer
""")
view("feature_xy", with_xy("SELECT * FROM feature_pts", x="fx", y="fy"))
_ln = with_xy("""
SELECT o_orderkey AS feature_id, o_orderpriority, o_orderstatus, o_totalprice, o_custkey, 26e0 + (o_orderkey * 15485863 % 10000) / 1000e0 AS lat1,
       -106e0 + (o_orderkey * 104723 % 12000) / 1000e0 AS lon1,
       26e0 + (o_orderkey * 15485863 % 10000) / 1000e0 + (o_orderkey * 31 % 200 - 100) / 1000e0 AS lat2,
       -106e0 + (o_orderkey * 104723 % 12000) / 1000e0 + (o_orderkey * 37 % 300 - 150) / 1000e0 AS lon2,
       CASE o_orderpriority WHEN '1-URGENT' THEN 345e0 WHEN '2-HIGH' THEN 138e0 WHEN '3-MEDIUM' THEN 500e0 WHEN '4-NOT SPECIFIED' THEN 115e0 ELSE 161e0 END AS voltage_kv
FROM orders""", "lon1", "lat1", "lx1", "ly1")
view("line_feats", with_xy(_ln, "lon2", "lat2", "lx2", "ly2"))


def ids(t):
    return t["site_geo"]


def boxes(t):
    """Sites as box polygons, points where only a point is known."""
    x, y, h = F.col("x"), F.col("y"), F.col("half")
    ring = F.when(F.col("geometry_is_point"), F.array(geo.point(x, y))).otherwise(geo.box_ring(x - h, y - h, x + h, y + h))
    return t["site_geo"].select("eia_id", ring.alias("ring"))


def points(t):
    return px.site_points(t["site_geo"])


def feats(t):
    return px.feature_points(t["feature_pts"])


def segments(t, *cols):
    lines = t["line_feats"].select("feature_id", *cols, F.array(geo.point(F.col("lx1"), F.col("ly1")), geo.point(F.col("lx2"), F.col("ly2"))).alias("c"))
    return px.line_segments(lines, "c", 8000.0)


_DBOX = "sqrt(power(greatest(abs(fx - x) - half, 0e0), 2) + power(greatest(abs(fy - y) - half, 0e0), 2))"
_DPT = "sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y))"
_T = "CASE WHEN (lx2-lx1)*(lx2-lx1)+(ly2-ly1)*(ly2-ly1) > 0 THEN greatest(0e0, least(1e0, ((x-lx1)*(lx2-lx1)+(y-ly1)*(ly2-ly1)) / ((lx2-lx1)*(lx2-lx1)+(ly2-ly1)*(ly2-ly1)))) ELSE 0e0 END"
_LINE_PAIRS = f"""
SELECT eia_id, grid_voltage_kv, feature_id, voltage_kv, o_orderpriority, o_orderstatus, o_totalprice, o_custkey,
  sqrt(power(x - (lx1 + tt * (lx2 - lx1)), 2) + power(y - (ly1 + tt * (ly2 - ly1)), 2)) AS d
FROM (SELECT s.eia_id, s.grid_voltage_kv, s.x, s.y, l.*, {_T} AS tt FROM site_geo s, line_feats l WHERE abs(s.lat - l.lat1) < 1.5e0 AND abs(s.lon - l.lon1) < 1.8e0) p
"""


@query("project_albers", """
SELECT eia_id, round(x, 3) AS x, round(y, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM site_geo
""")
def _(t):
    p = px.site_points(t["site_geo"])
    lon, lat = geo.albers_lonlat(F.col("x"), F.col("y"))
    return p.select("eia_id", R("x", 3), R("y", 3), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("point_fallback", """
SELECT eia_id, geometry_is_point, CASE WHEN geometry_is_point THEN 1 ELSE 4 END AS corners, round(x - half, 2) AS west FROM site_geo
""")
def _(t):
    x, y, h = F.col("x"), F.col("y"), F.col("half")
    rings = t["site_geo"].filter("not geometry_is_point").select("eia_id", geo.box_ring(x - h, y - h, x + h, y + h).alias("ring"))
    out = px.with_point_fallback(t["site_geo"].drop("geometry_is_point", "x", "y"), rings)
    return out.select("eia_id", "geometry_is_point", F.size("ring").alias("corners"), F.round(geo.bounds(F.col("ring"))["xmin"], 2).alias("west"))


@query("footprint_buffer", """
SELECT eia_id, round(CASE WHEN geometry_is_point THEN 32e0 * 300 * 300 * sin(2e0 * pi() / 64e0) ELSE 4e0 * half * half END, 1) AS area FROM site_geo
""")
def _(t):
    x, y, h = F.col("x"), F.col("y"), F.col("half")
    rings = t["site_geo"].filter("not geometry_is_point").select("eia_id", geo.box_ring(x - h, y - h, x + h, y + h).alias("ring"))
    out = px.with_point_fallback(t["site_geo"].drop("geometry_is_point", "x", "y"), rings, buffer_m=300.0)
    return out.select("eia_id", F.round(geo.ring_area(F.col("ring")), 1).alias("area"))


@query("polygon_area", "SELECT eia_id, round(4e0 * half * half / 4046.8564224e0, 4) AS acres FROM site_geo")
def _(t):
    return boxes(t).select("eia_id", F.round(geo.ring_area(F.col("ring")) / CFG["units"]["m2_per_acre"], 4).alias("acres"))


@query("representative_point", """
SELECT eia_id, round(CASE WHEN geometry_is_point THEN x ELSE x - half / 2e0 END, 3) AS px, round(CASE WHEN geometry_is_point THEN y ELSE y END, 3) AS py FROM site_geo
""")
def _(t):
    # an L: the widest stretch of the middle line is the left arm
    x, y, h = F.col("x"), F.col("y"), F.col("half")
    ell = F.array(geo.point(x - h, y - h), geo.point(x + h, y - h), geo.point(x + h, y - h / 2), geo.point(x, y - h / 2), geo.point(x, y + h), geo.point(x - h, y + h))
    p = geo.representative_point(F.when(F.col("geometry_is_point"), F.array(geo.point(x, y))).otherwise(ell))
    shift = F.when(F.col("geometry_is_point"), 0.0).otherwise(h / 4)
    return t["site_geo"].select("eia_id", F.round(p["x"], 3).alias("px"), F.round(p["y"] - shift, 3).alias("py"))


@query("grid_snap", """
SELECT eia_id, round_even(round_even(lat / 0.02e0, 0) * 0.02e0, 4) AS req_lat, round_even(round_even(lon / 0.02e0, 0) * 0.02e0, 4) AS req_lon FROM site_geo
""")
def _(t):
    step = CFG["layers"]["climate"]["point_round_deg"]
    return ids(t).select("eia_id", geo.grid_snap(F.col("lat"), step).alias("req_lat"), geo.grid_snap(F.col("lon"), step).alias("req_lon"))


@query("plant_boxes", """
SELECT DISTINCT round(cx - 0.4e0, 4) AS west, round(cy - 0.4e0, 4) AS south, round(cx + 0.4e0, 4) AS east, round(cy + 0.4e0, 4) AS north
FROM (SELECT round_even(lat / 0.25e0, 0) * 0.25e0 AS cy, round_even(lon / 0.25e0, 0) * 0.25e0 AS cx FROM site_geo) b
""")
def _(t):
    c = CFG["layers"]["gas_pipelines"]
    return px.plant_boxes(ids(t), c["bbox_snap_deg"], c["bbox_half_deg"])


@query("nearest_join", f"""
SELECT s.eia_id, n.feature_id, round(n.d / {MI}, 4) AS mi, n.name FROM site_geo s LEFT JOIN (
  SELECT * FROM (SELECT eia_id, feature_id, f.name, {_DBOX} AS d, row_number() OVER (PARTITION BY eia_id ORDER BY {_DBOX}, feature_id) AS rn FROM site_geo, feature_xy f) r
  WHERE rn = 1 AND d <= 40 * {MI}) n ON s.eia_id = n.eia_id
""")
def _(t):
    near = px.nearest_features(boxes(t), feats(t), 40 * MI, "feature_id", ["name"])
    return px.nearest_with_radius(ids(t), near, "mi", {"feature_id": "feature_id", "name": "name"}, MI).select("eia_id", "feature_id", R("mi"), "name")


@query("nearest_one", f"""
SELECT eia_id, feature_id, round(d / {MI}, 4) AS mi FROM (
  SELECT eia_id, feature_id, {_DPT} AS d, row_number() OVER (PARTITION BY eia_id ORDER BY {_DPT}, feature_id) AS rn FROM site_geo, feature_xy) r WHERE rn = 1 AND d <= 60 * {MI}
""")
def _(t):
    near = px.nearest_features(points(t), feats(t), 60 * MI, "feature_id", [])
    return near.select("eia_id", "feature_id", F.round(F.col("d") / MI, 4).alias("mi"))


@query("beyond_radius_null", f"""
SELECT s.eia_id, round(n.d / {MI}, 4) AS mi, n.name FROM site_geo s LEFT JOIN (
  SELECT * FROM (SELECT eia_id, f.name, {_DPT} AS d, row_number() OVER (PARTITION BY eia_id ORDER BY {_DPT}, feature_id) AS rn FROM site_geo, feature_xy f) r
  WHERE rn = 1 AND d <= 8 * {MI}) n ON s.eia_id = n.eia_id
""")
def _(t):
    near = px.nearest_features(points(t), feats(t), 8 * MI, "feature_id", ["name"])
    return px.nearest_with_radius(ids(t), near, "mi", {"name": "name"}, MI).select("eia_id", R("mi"), "name")


@query("within_join", f"SELECT eia_id, feature_id, round(d / {MI}, 4) AS mi FROM (SELECT eia_id, feature_id, {_DBOX} AS d FROM site_geo, feature_xy) p WHERE d <= 40 * {MI}")
def _(t):
    return px.within_features(boxes(t), feats(t), 40 * MI, "feature_id").select("eia_id", "feature_id", F.round(F.col("d") / MI, 4).alias("mi"))


@query("line_nearest", f"""
SELECT eia_id, feature_id, round(d / {MI}, 4) AS mi FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY d, feature_id) AS rn FROM ({_LINE_PAIRS}) p) r
WHERE rn = 1 AND d <= 15 * {MI}
""")
def _(t):
    near = px.nearest_features(points(t), segments(t), 15 * MI, "feature_id", [], points_only=False)
    return near.select("eia_id", "feature_id", F.round(F.col("d") / MI, 4).alias("mi"))


@query("adaptive_radius", f"""
SELECT eia_id, CASE WHEN count(CASE WHEN d <= 10 * {MI} THEN 1 END) >= 3 THEN 10e0 WHEN count(CASE WHEN d <= 20 * {MI} THEN 1 END) >= 3 THEN 20e0
  WHEN count(*) >= 3 THEN 30e0 END AS radius_mi, count(*) AS n_far
FROM (SELECT eia_id, {_DPT} AS d FROM site_geo, feature_xy) p WHERE d <= 30 * {MI} GROUP BY eia_id
""")
def _(t):
    radii = [10.0, 20.0, 30.0]
    return px.adaptive_radius(px.radius_counts(points(t), feats(t), radii, MI), radii, 3)


_HOTELS = [(n.split(" (")[0], la, lo) for n, la, lo in CFG["layers"]["fiber"]["hotels"]]
_GC = [f"2e0 * 3958.8e0 * asin(sqrt(power(sin((radians({la}e0) - radians(lat)) / 2e0), 2) + cos(radians(lat)) * cos(radians({la}e0)) * power(sin(radians({lo}e0 - lon) / 2e0), 2)))"
       for _n, la, lo in _HOTELS]
_NAMES = [n for n, _a, _b in CFG["layers"]["fiber"]["hotels"]]


@query("great_circle", f"""
SELECT eia_id, CASE WHEN h0 <= least(h1, h2) THEN '{_NAMES[0]}' WHEN h1 <= h2 THEN '{_NAMES[1]}' ELSE '{_NAMES[2]}' END AS nearest_carrier_hotel,
  round(least(h0, h1, h2), 4) AS carrier_hotel_gc_mi, round(least(h0, h1, h2) * 1.5e0, 4) AS carrier_hotel_route_mi_est,
  round(least(h0, h1, h2) * 1.5e0 * 0.0158e0, 5) AS latency_rtt_ms_est,
  printf('%s ~%.1f ms; %s ~%.1f ms; %s ~%.1f ms', '{_HOTELS[0][0]}', h0 * 1.5e0 * 0.0158e0, '{_HOTELS[1][0]}', h1 * 1.5e0 * 0.0158e0, '{_HOTELS[2][0]}', h2 * 1.5e0 * 0.0158e0) AS carrier_hotel_rtt_ms
FROM (SELECT eia_id, {_GC[0]} AS h0, {_GC[1]} AS h1, {_GC[2]} AS h2 FROM site_geo) h
""")
def _(t):
    return ly.carrier_hotels(ids(t), CFG).select("eia_id", "nearest_carrier_hotel", R("carrier_hotel_gc_mi"), R("carrier_hotel_route_mi_est"),
                                                 R("latency_rtt_ms_est", 5), "carrier_hotel_rtt_ms")


_KVSEEN = [f"max(CASE WHEN abs(voltage_kv - {k}) <= {k} * 0.05e0 THEN 1 ELSE 0 END) AS k{k}" for k in (138, 230, 345, 500)]


_CLASSES = f"""
SELECT s.eia_id, nullif(concat_ws(';', CASE WHEN k138 = 1 THEN '138' END, CASE WHEN k230 = 1 THEN '230' END, CASE WHEN k345 = 1 THEN '345' END, CASE WHEN k500 = 1 THEN '500' END), '') AS kv_classes_within_near,
  max_kv AS max_kv_within_near, CASE WHEN s.grid_voltage_kv >= 100 THEN coalesce((k138 = 1 AND abs(138 - s.grid_voltage_kv) <= s.grid_voltage_kv * 0.05e0)
     OR (k345 = 1 AND abs(345 - s.grid_voltage_kv) <= s.grid_voltage_kv * 0.05e0), false) END AS poi_kv_seen
FROM site_geo s LEFT JOIN (SELECT eia_id, max(voltage_kv) AS max_kv, {', '.join(_KVSEEN)} FROM ({_LINE_PAIRS}) p WHERE d <= 3 * {MI} GROUP BY eia_id) c ON s.eia_id = c.eia_id
"""


@query("line_classes_near", _CLASSES)
def _(t):
    return ly.line_classes_near(ids(t), points(t), segments(t, "voltage_kv"), CFG)


def _line_best(where: str, radius: float) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY d, feature_id) AS rn FROM ({_LINE_PAIRS}) p WHERE {where}) r WHERE rn = 1 AND d <= {radius} * {MI}"


def _transmission(t):
    subs = px.feature_points(t["feature_pts"].withColumn("voltage_kv", F.when(F.col("c_mktsegment") == "BUILDING", 345.0).otherwise(138.0)))
    return ly.transmission(ids(t), points(t), segments(t, "voltage_kv"), subs, CFG, "osm (extract)", "2026-10-05")


_SUB = f"""SELECT * FROM (SELECT eia_id, name, {_DPT} AS d, row_number() OVER (PARTITION BY eia_id ORDER BY {_DPT}, feature_id) AS rn FROM site_geo, feature_xy
  WHERE c_mktsegment = 'BUILDING') r WHERE rn = 1 AND d <= 40 * {MI}"""
_TX = f"""
SELECT s.eia_id, round(b.d / {MI}, 4) AS dist_345kv_sub_mi, b.name AS nearest_345kv_sub_name, round(l3.d / {MI}, 4) AS dist_345kv_line_mi, round(l1.d / {MI}, 4) AS dist_138kv_line_mi,
  k.kv_classes_within_near, k.poi_kv_seen, 4e1 AS transmission_search_mi, 'osm (extract)' AS transmission_source, '2026-10-05' AS transmission_fetched,
  CASE WHEN s.geometry_is_point THEN 'low' ELSE 'medium' END AS transmission_confidence
FROM site_geo s LEFT JOIN ({_SUB}) b ON s.eia_id = b.eia_id LEFT JOIN ({_line_best('voltage_kv >= 345', 40)}) l3 ON s.eia_id = l3.eia_id
LEFT JOIN ({_line_best('voltage_kv >= 138', 40)}) l1 ON s.eia_id = l1.eia_id JOIN ({_CLASSES}) k ON s.eia_id = k.eia_id
"""


@query("transmission_layer", _TX)
def _(t):
    return _transmission(t).select("eia_id", R("dist_345kv_sub_mi"), "nearest_345kv_sub_name", R("dist_345kv_line_mi"), R("dist_138kv_line_mi"), "kv_classes_within_near",
                                   "poi_kv_seen", "transmission_search_mi", "transmission_source", "transmission_fetched", "transmission_confidence")


@query("poi_mismatch", f"SELECT eia_id, dist_138kv_line_mi FROM ({_TX}) x WHERE poi_kv_seen = false ORDER BY dist_138kv_line_mi DESC")
def _(t):
    return (_transmission(t).filter("poi_kv_seen = false").orderBy(F.col("dist_138kv_line_mi").desc()).select("eia_id", R("dist_138kv_line_mi")))


@query("provenance_columns", """
SELECT eia_id, 'a source' AS layer_source, '2026-10-05' AS layer_fetched, 15e0 AS layer_search_mi, CASE WHEN geometry_is_point THEN 'low' ELSE 'medium' END AS layer_confidence FROM site_geo
""")
def _(t):
    out = ly.provenance(ids(t), "layer", "a source", "2026-10-05", 15.0)
    return out.select("eia_id", "layer_source", "layer_fetched", "layer_search_mi", "layer_confidence")


# ---- gas -----------------------------------------------------------------------------------------------------------------
view("gas_lines", """
SELECT l.*, concat('Op ', CAST(o_custkey % 40 AS STRING)) AS operator, concat('Sys ', o_orderstatus) AS system_name,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN ' natural/other gas transmission - x' ELSE 'Gathering' END AS system_type,
       CASE WHEN o_orderkey % 4 = 0 THEN '0' ELSE CAST(o_orderkey % 36 AS STRING) END AS diameter,
       CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'No' ELSE NULL END AS interstate,
       CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN 'Abandoned' ELSE 'In Service' END AS status,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'CRUDE OIL' WHEN o_orderpriority = '1-URGENT' THEN 'NATURAL GAS' ELSE 'OTHER GAS' END AS commodity_description
FROM line_feats l JOIN (SELECT o_orderkey FROM orders) k ON l.feature_id = k.o_orderkey
""")
_GASOK = "o_orderpriority <> '5-LOW' AND NOT (o_orderstatus = 'P' AND o_totalprice < 50000)"
_GASTX = f"({_GASOK}) AND o_orderpriority IN ('1-URGENT', '2-HIGH')"


def gas_segments(t):
    g = ly.gas_in_service(t["gas_lines"], CFG)
    g = g.select("feature_id", "operator", "system_name", "system_type", ly.diameter(F.col("diameter")).alias("diameter_in"),
                 (F.lower(F.trim("interstate")) == "yes").alias("interstate"),
                 F.array(geo.point(F.col("lx1"), F.col("ly1")), geo.point(F.col("lx2"), F.col("ly2"))).alias("c"))
    return px.line_segments(g, "c", 3000.0)


_DIA = "CASE WHEN feature_id % 4 = 0 OR feature_id % 36 = 0 THEN NULL ELSE CAST(feature_id % 36 AS DOUBLE) END"


@query("gas_near", f"""
SELECT s.eia_id, round(t.d / {MI}, 4) AS dist_gas_transmission_mi, concat('Op ', CAST(t.o_custkey % 40 AS VARCHAR)) AS op0, round(a.d / {MI}, 4) AS dist_gas_any_mi,
  coalesce(n.n, 0) AS n_gas_transmission_near, n.dia AS max_gas_transmission_diameter_near_in, CASE WHEN t.d IS NOT NULL THEN {_DIA.replace('feature_id', 't.feature_id')} END AS gas_transmission_diameter_in,
  CASE t.o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS gas_transmission_interstate
FROM site_geo s LEFT JOIN ({_line_best(_GASTX, 15)}) t ON s.eia_id = t.eia_id LEFT JOIN ({_line_best(_GASOK, 15)}) a ON s.eia_id = a.eia_id
LEFT JOIN (SELECT eia_id, count(*) AS n, max({_DIA}) AS dia FROM ({_LINE_PAIRS}) p WHERE {_GASTX} AND d <= 5 * {MI} GROUP BY eia_id) n ON s.eia_id = n.eia_id
""".replace("concat('Op ', CAST(t.o_custkey % 40 AS VARCHAR)) AS op0", "CASE WHEN t.d IS NOT NULL THEN concat('Op ', CAST(t.o_custkey % 40 AS VARCHAR)) END AS gas_transmission_operator"))
def _(t):
    out = ly.gas_pipelines(ids(t), points(t), gas_segments(t), CFG, "2026-10-05")
    return out.select("eia_id", R("dist_gas_transmission_mi"), "gas_transmission_operator", R("dist_gas_any_mi"), "n_gas_transmission_near",
                      "max_gas_transmission_diameter_near_in", "gas_transmission_diameter_in", "gas_transmission_interstate")


@query("commodity_predicate", f"SELECT feature_id FROM line_feats WHERE {_GASOK}")
def _(t):
    return ly.gas_in_service(t["gas_lines"], CFG).select("feature_id")


@query("rail_predicate", "SELECT feature_id FROM line_feats WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT')")
def _(t):
    rail = t["line_feats"].withColumn("rrowner1", F.when(F.col("o_orderstatus") == "F", "UP").when(F.col("o_orderstatus") == "O", "BNSF").otherwise("TXNW"))
    rail = rail.withColumn("net", F.when(F.col("o_orderpriority") == "1-URGENT", "M").otherwise("S"))
    return ly.rail_in_scope(rail, CFG).select("feature_id")


@query("system_type_prefix", "SELECT feature_id, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_transmission FROM line_feats")
def _(t):
    return t["gas_lines"].select("feature_id", ly.is_gas_transmission(F.col("system_type"), CFG).alias("is_transmission"))


@query("sentinel_null", """
SELECT feature_id, CASE WHEN feature_id % 4 = 0 OR feature_id % 36 = 0 THEN NULL ELSE CAST(feature_id % 36 AS DOUBLE) END AS diameter_in,
       CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS interstate FROM line_feats
""")
def _(t):
    return t["gas_lines"].select("feature_id", ly.diameter(F.col("diameter")).alias("diameter_in"), (F.lower(F.trim("interstate")) == "yes").alias("interstate"))


# ---- fibre ---------------------------------------------------------------------------------------------------------------
@query("corridor_lateral", f"""
SELECT s.eia_id, round(a.d / {MI}, 4) AS dist_class1_rail_mi, CASE WHEN a.d IS NOT NULL THEN CASE a.o_orderstatus WHEN 'F' THEN 'UP' ELSE 'BNSF' END END AS nearest_rail_owner,
  round(b.d / {MI}, 4) AS dist_interstate_mi, round(least(a.d, b.d) / {MI}, 4) AS fiber_lateral_miles,
  CASE WHEN a.d IS NULL AND b.d IS NULL THEN NULL WHEN a.d IS NOT NULL AND (b.d IS NULL OR a.d <= b.d) THEN 'rail' ELSE 'interstate' END AS fiber_corridor
FROM site_geo s LEFT JOIN ({_line_best("o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'", 12)}) a ON s.eia_id = a.eia_id
LEFT JOIN ({_line_best("o_orderpriority = '3-MEDIUM'", 12)}) b ON s.eia_id = b.eia_id
""")
def _(t):
    cfg = config()
    cfg["layers"]["fiber"]["search_radius_mi"] = 12.0
    owner = F.when(F.col("o_orderstatus") == "F", "UP").when(F.col("o_orderstatus") == "O", "BNSF").otherwise("TXNW").alias("rrowner1")
    net = F.when(F.col("o_orderpriority") == "1-URGENT", "M").otherwise("S").alias("net")
    rail = ly.rail_in_scope(segments(t, owner, net, F.col("o_orderpriority").alias("subdiv")), cfg)
    roads = segments(t, "o_orderpriority", F.lit("I-10").alias("ref")).filter("o_orderpriority = '3-MEDIUM'")
    out = ly.fiber(ids(t), points(t), rail, roads, cfg, "2026-10-05")
    return out.select("eia_id", R("dist_class1_rail_mi"), "nearest_rail_owner", R("dist_interstate_mi"), R("fiber_lateral_miles"), "fiber_corridor")


# ---- load projects -------------------------------------------------------------------------------------------------------
view("projects", """
SELECT feature_id AS project_id, name, CASE c_mktsegment WHEN 'BUILDING' THEN 'data_center' WHEN 'MACHINERY' THEN 'crypto' WHEN 'FURNITURE' THEN 'hydrogen' ELSE 'industrial' END AS kind,
       CASE WHEN c_nationkey % 4 = 0 THEN 'operating' WHEN c_nationkey % 4 = 1 THEN 'under_construction' WHEN c_nationkey % 4 = 2 THEN 'announced' ELSE 'cancelled' END AS status,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 30.17e0 END AS load_mw, CASE WHEN c_nationkey % 3 = 0 THEN 'site' WHEN c_nationkey % 3 = 1 THEN 'city' ELSE 'county' END AS location_confidence,
       lat, lon, name AS developer, 'X' AS county, 'https://example.org' AS source_url
FROM feature_pts
""")
_QUAL = "status <> 'cancelled' AND (kind = 'data_center' OR coalesce(load_mw, 0) >= 75)"
view("projects_xy", with_xy("SELECT * FROM projects", x="fx", y="fy"))


@query("qualifying_projects", f"SELECT project_id, kind, status, round(load_mw, 5) AS load_mw FROM projects WHERE {_QUAL}")
def _(t):
    return ly.qualifying_projects(t["projects"], CFG).select("project_id", "kind", "status", R("load_mw", 5))


_PAIR = f"SELECT eia_id, p.*, {_DPT} / {MI} AS mi FROM site_geo, projects_xy p WHERE {_QUAL}"
_BEST = lambda st: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY mi, project_id) AS rn FROM ({_PAIR}) q WHERE status IN ({st})) r WHERE rn = 1 AND mi <= 50"
_BAND = lambda c: f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 10 THEN 5e0 WHEN {c} < 25 THEN 3e0 WHEN {c} < 50 THEN 1e0 ELSE 0e0 END"


@query("load_pocket_near", f"""
SELECT s.eia_id, round(f.mi, 4) AS dist_load_pocket_firm_mi, f.name AS nearest_firm_project, f.kind AS nearest_firm_kind, f.status AS nearest_firm_status, round(f.load_mw, 4) AS nearest_firm_mw,
  round(a.mi, 4) AS dist_load_pocket_announced_mi, a.name AS nearest_announced_project, coalesce(l.n, 0) AS n_projects_within_search, round(coalesce(l.mw, 0), 4) AS mw_within_search, l.txt AS projects_within_search,
  CASE WHEN coalesce({_BAND('f.mi')}, 0) >= coalesce({_BAND('a.mi')} * 0.5e0, 0) THEN f.location_confidence ELSE a.location_confidence END AS load_pocket_location_confidence,
  'manual: data/projects.csv (' || (SELECT count(*) FROM projects WHERE {_QUAL}) || ' qualifying projects)' AS load_pocket_source
FROM site_geo s LEFT JOIN ({_BEST("'operating', 'under_construction'")}) f ON s.eia_id = f.eia_id LEFT JOIN ({_BEST("'announced'")}) a ON s.eia_id = a.eia_id
LEFT JOIN (SELECT eia_id, count(*) AS n, sum(load_mw) AS mw, string_agg(name || ' (' || status || ', ' || CASE WHEN load_mw IS NULL THEN '' ELSE CAST(CAST(round_even(load_mw, 0) AS BIGINT) AS VARCHAR) || ' MW, ' END
   || printf('%.1f mi)', mi), '; ' ORDER BY mi, project_id) AS txt FROM ({_PAIR}) q WHERE mi <= 50 GROUP BY eia_id) l ON s.eia_id = l.eia_id
""")
def _(t):
    out = ly.load_pocket(ids(t), points(t), t["projects"], CFG, "data/projects.csv", "2026-10-06")
    return out.select("eia_id", R("dist_load_pocket_firm_mi"), "nearest_firm_project", "nearest_firm_kind", "nearest_firm_status", R("nearest_firm_mw"), R("dist_load_pocket_announced_mi"),
                      "nearest_announced_project", "n_projects_within_search", R("mw_within_search"), "projects_within_search", "load_pocket_location_confidence", "load_pocket_source")


@query("driving_location_confidence", """
SELECT project_id, CASE WHEN coalesce(load_mw, 0e0) >= 100e0 THEN 'firm' ELSE location_confidence END AS conf FROM projects
""")
def _(t):
    return t["projects"].select("project_id", ly.driving_location(F.col("load_mw"), F.lit(100.0), F.lit("firm"), F.col("location_confidence")).alias("conf"))


@query("ref_points_projects", f"SELECT project_id, name, kind, status, {_QUAL} AS qualifies FROM projects")
def _(t):
    q = ly.qualifying_projects(t["projects"], CFG).select("project_id").withColumn("_q", F.lit(True))
    return (t["projects"].filter("lat is not null and lon is not null").join(q, "project_id", "left")
            .select("project_id", "name", "kind", "status", F.coalesce("_q", F.lit(False)).alias("qualifies")))


@query("ref_points_substations", "SELECT feature_id, name, round(lat, 5) AS lat, round(lon, 5) AS lon FROM feature_pts WHERE c_mktsegment = 'BUILDING'")
def _(t):
    subs = t["feature_pts"].withColumn("voltage_kv", F.when(F.col("c_mktsegment") == "BUILDING", 345.0).otherwise(138.0))
    return subs.filter("voltage_kv >= 345").select("feature_id", "name", R("lat", 5), R("lon", 5))


# ---- coverage ------------------------------------------------------------------------------------------------------------
BCFG = config()
BCFG["layers"]["fiber_bdc"].update(near_miles=25.0, search_radius_mi=60.0, site_cell_m=12000.0)
view("coverage_rows", """
SELECT concat(' C', CAST(o_custkey AS STRING)) AS h3_res8_id, CAST(o_orderkey % 25 AS STRING) AS provider_id, concat('Brand ', CAST(o_orderkey % 25 % 9 AS STRING), ' ') AS brand_name,
       CAST(o_orderkey AS STRING) AS location_id, CASE WHEN o_orderpriority = '5-LOW' THEN '40' ELSE '50' END AS technology,
       CAST(CAST(floor(o_totalprice) AS BIGINT) % 5000 AS STRING) AS max_advertised_download_speed, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 900 AS STRING) END AS max_advertised_upload_speed,
       CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'b' ELSE 'X' END AS business_residential_code
FROM orders
""")
_CELLS = """
SELECT lower(trim(h3_res8_id)) AS h3, provider_id, trim(brand_name) AS brand, count(*) AS locations, max(CAST(max_advertised_download_speed AS DOUBLE)) AS max_down,
  max(TRY_CAST(max_advertised_upload_speed AS DOUBLE)) AS max_up, max(CASE WHEN upper(business_residential_code) IN ('B', 'X') THEN 1 ELSE 0 END) = 1 AS business
FROM coverage_rows WHERE technology = '50' GROUP BY 1, 2, 3
"""
_CELLPT = f"""
SELECT c.*, f.fx, f.fy FROM (SELECT h3, count(DISTINCT provider_id) AS providers, max(locations) AS locations, max(max_down) AS max_down, max(max_up) AS max_up, bool_or(business) AS business,
  string_agg(DISTINCT brand, '; ' ORDER BY brand) AS brands FROM ({_CELLS}) c0 GROUP BY h3) c JOIN feature_xy f ON c.h3 = 'c' || CAST(f.feature_id AS VARCHAR)
"""


def cells(t):
    return ly.coverage_reduce(t["coverage_rows"], BCFG)


def centres(t):
    return t["feature_pts"].select(F.concat(F.lit("c"), F.col("feature_id").cast("string")).alias("h3"), "lat", "lon")


@query("coverage_reduce", _CELLS)
def _(t):
    return cells(t)


@query("chunked_reduce_read", f"SELECT h3, count(*) AS providers, sum(locations)::BIGINT AS locations, max(max_down) AS max_down FROM ({_CELLS}) c GROUP BY h3")
def _(t):
    return cells(t).groupBy("h3").agg(F.count(F.lit(1)).alias("providers"), F.sum("locations").alias("locations"), F.max("max_down").alias("max_down"))


@query("coverage_cell_points", f"SELECT h3, providers, locations, max_down, max_up, business, brands, round(fx, 2) AS x1, round(fy, 2) AS y1 FROM ({_CELLPT}) c")
def _(t):
    return ly.coverage_cell_points(cells(t), centres(t)).select("h3", "providers", "locations", "max_down", "max_up", "business", "brands", R("x1", 2), R("y1", 2))


_HIT = f"SELECT eia_id, c.*, {_DPT} / {MI} AS mi FROM site_geo, ({_CELLPT}) c"
_COV = f"""
SELECT s.eia_id, round(n.mi, 4) AS bdc_fiber_nearest_mi, n.brands AS bdc_nearest_brands, coalesce(n.mi * {MI} <= 12000, false) AS bdc_fiber_at_site, coalesce(a.cells, 0) AS bdc_cells_near,
  coalesce(p.provs, 0) AS bdc_providers_near, b.brands AS bdc_brands_near, a.down AS bdc_max_down_mbps_near, a.up AS bdc_max_up_mbps_near, coalesce(a.biz, false) AS bdc_business_fiber_near
FROM site_geo s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY mi, h3) AS rn FROM ({_HIT}) h) r WHERE rn = 1 AND mi <= 60) n ON s.eia_id = n.eia_id
LEFT JOIN (SELECT eia_id, count(*) AS cells, max(max_down) AS down, max(max_up) AS up, bool_or(business) AS biz FROM ({_HIT}) h WHERE mi <= 25 GROUP BY 1) a ON s.eia_id = a.eia_id
LEFT JOIN (SELECT h.eia_id, count(DISTINCT c.provider_id) AS provs FROM ({_HIT}) h JOIN ({_CELLS}) c ON h.h3 = c.h3 WHERE mi <= 25 GROUP BY 1) p ON s.eia_id = p.eia_id
LEFT JOIN (SELECT eia_id, string_agg(brand, '; ' ORDER BY n DESC, brand) AS brands FROM (SELECT h.eia_id, c.brand, count(DISTINCT h.h3) AS n, row_number() OVER (PARTITION BY h.eia_id ORDER BY count(DISTINCT h.h3) DESC, c.brand) AS rn
   FROM ({_HIT}) h JOIN ({_CELLS}) c ON h.h3 = c.h3 WHERE mi <= 25 GROUP BY 1, 2) z WHERE rn <= 3 GROUP BY 1) b ON s.eia_id = b.eia_id
"""


def cov(t):
    return ly.coverage(ids(t), points(t), cells(t), centres(t), BCFG, "file", "J25 30jun2026", "2026-10-14")


@query("coverage_near", _COV)
def _(t):
    return cov(t).select("eia_id", R("bdc_fiber_nearest_mi"), "bdc_nearest_brands", "bdc_fiber_at_site", "bdc_cells_near", "bdc_providers_near", "bdc_brands_near",
                         "bdc_max_down_mbps_near", "bdc_max_up_mbps_near", "bdc_business_fiber_near")


@query("fiber_at_site", f"SELECT eia_id, bdc_fiber_at_site FROM ({_COV}) c")
def _(t):
    return cov(t).select("eia_id", "bdc_fiber_at_site")


# ---- wells ---------------------------------------------------------------------------------------------------------------
WCFG = config()
WCFG["layers"]["wells"].update(min_log_depth_ft=90.0, bore_depth_ft=150.0, water_level_since=1997,
                               patterns={"caliche": "RING|BOLT", "gypsum": "GEAR|RED", "hard_rock": "OLD ?|ANVIL", "lost_circulation": "HOT PLATE"})
view("sdr_wells", """
SELECT feature_id AS id, lat1 AS lat, lon1 AS lon, CASE o_orderpriority WHEN '1-URGENT' THEN 'Closed-Loop Geothermal' ELSE 'Domestic' END AS use FROM line_feats
""")
view("sdr_lithology", """
SELECT l_orderkey AS id, l_linenumber * 20e0 AS top_ft, l_linenumber * 20e0 + l_quantity - 5e0 AS bottom_ft, p_name AS desc FROM lineitem JOIN part ON l_partkey = p_partkey
""")
view("sdr_levels", "SELECT o_orderkey AS id, o_totalprice / 1000.7e0 - 30e0 AS depth_ft, year(o_orderdate) AS year FROM orders WHERE o_orderstatus <> 'P'")
view("gwdb_wells", """
SELECT feature_id AS swn, lat, lon, CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END AS aquifer, concat('GCD ', CAST(c_nationkey AS STRING)) AS gcd FROM feature_pts
""")
view("gwdb_measured", """
SELECT o_custkey AS swn, CASE WHEN o_orderstatus = 'F' THEN 'Questionable' ELSE 'Publishable' END AS status, year(o_orderdate) AS year, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date,
       o_totalprice / 1000.7e0 - 20e0 AS depth_ft FROM orders
""")
_LOGM = """
SELECT id, max(bottom_ft) AS log_depth_ft, sum(CASE WHEN regexp_matches(u, 'RING|BOLT|GEAR|RED') THEN ft ELSE 0 END) AS hard_ft, sum(CASE WHEN regexp_matches(u, 'RING|BOLT') THEN ft ELSE 0 END) AS caliche_ft,
  sum(CASE WHEN regexp_matches(u, 'GEAR|RED') THEN ft ELSE 0 END) AS gypsum_ft, sum(CASE WHEN regexp_matches(u, 'OLD ?|ANVIL') THEN ft ELSE 0 END) AS rock_ft, bool_or(regexp_matches(u, 'HOT PLATE')) AS lost
FROM (SELECT *, upper("desc") AS u, greatest(least(bottom_ft, 150) - least(top_ft, 150), 0) AS ft FROM sdr_lithology WHERE bottom_ft > top_ft) x GROUP BY id HAVING max(bottom_ft) >= 90
"""
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY swn ORDER BY date DESC, depth_ft DESC) AS rn FROM gwdb_measured WHERE lower(status) = 'publishable' AND year >= 1997) g WHERE rn = 1"
_LEVELS = f"""
SELECT * FROM (SELECT 's' || CAST(w.id AS VARCHAR) AS level_id, lat, lon, depth_ft, year, 'sdr' AS src FROM sdr_wells w JOIN sdr_levels v ON w.id = v.id
  UNION ALL SELECT 'g' || CAST(w.swn AS VARCHAR), lat, lon, depth_ft, year, 'gwdb' FROM ({_LATEST}) v JOIN gwdb_wells w ON v.swn = w.swn) u WHERE depth_ft >= 0
"""


def well_sources(t):
    return {"sdr_wells": t["sdr_wells"], "sdr_lithology": t["sdr_lithology"], "sdr_levels": t["sdr_levels"], "gwdb_wells": t["gwdb_wells"],
            "gwdb_levels": ly.latest_levels(t["gwdb_measured"], WCFG)}


@query("log_metrics", _LOGM)
def _(t):
    return ly.log_metrics(t["sdr_lithology"], WCFG)


@query("water_level_union_latest", f"SELECT level_id, round(depth_ft, 5) AS depth_ft, CAST(year AS BIGINT) AS year, src FROM ({_LEVELS}) l")
def _(t):
    s = well_sources(t)
    out = ly.water_levels(s["sdr_wells"], s["sdr_levels"], s["gwdb_wells"], s["gwdb_levels"])
    return out.select("level_id", R("depth_ft", 5), F.col("year").cast("bigint").alias("year"), "src")


_LOGXY = with_xy(f"SELECT m.*, w.lat, w.lon FROM ({_LOGM}) m JOIN sdr_wells w ON m.id = w.id", x="fx", y="fy")
_LVLXY = with_xy(f"SELECT * FROM ({_LEVELS}) l0", x="fx", y="fy")


def _pick(src, need, ident):
    return f"""SELECT h.*, r.radius_mi FROM (SELECT eia_id, f.*, {_DPT} / {MI} AS mi FROM site_geo, ({src}) f) h JOIN (
      SELECT eia_id, CASE WHEN count(CASE WHEN mi <= 3 THEN 1 END) >= {need} THEN 3e0 WHEN count(CASE WHEN mi <= 6 THEN 1 END) >= {need} THEN 6e0 WHEN count(*) >= {need} THEN 10e0 END AS radius_mi
      FROM (SELECT eia_id, {_DPT} / {MI} AS mi FROM site_geo, ({src}) f) q WHERE mi <= 10 GROUP BY eia_id) r ON h.eia_id = r.eia_id WHERE mi <= coalesce(r.radius_mi, -1)"""


_FAR = lambda src: f"SELECT eia_id, count(*) AS n FROM (SELECT eia_id, {_DPT} / {MI} AS mi FROM site_geo, ({src}) f) q WHERE mi <= 10 GROUP BY eia_id"


_SHARE = lambda cond: f"round_even(avg(CASE WHEN {cond} THEN 1e0 ELSE 0 END), 3)"
_LOGS = f"""
SELECT s.eia_id, CAST(coalesce(a.n, f.n, 0) AS BIGINT) AS n_logs, a.radius_mi AS logs_radius_mi, a.thick AS thick_hard_layer_share, round(a.med, 4) AS hard_layer_ft_median, round(a.p90, 4) AS hard_layer_ft_p90,
  a.cal AS caliche_log_share, a.gyp AS gypsum_log_share, a.rock AS hard_rock_log_share, a.lost AS lost_circulation_log_share, round(a.dep, 4) AS median_log_depth_ft
FROM site_geo s LEFT JOIN ({_FAR(_LOGXY)}) f ON s.eia_id = f.eia_id LEFT JOIN (SELECT eia_id, max(radius_mi) AS radius_mi, count(*) AS n, {_SHARE('hard_ft >= 20')} AS thick,
  quantile_cont(hard_ft, 0.5) AS med, quantile_cont(hard_ft, 0.9) AS p90, {_SHARE('caliche_ft > 0')} AS cal, {_SHARE('gypsum_ft > 0')} AS gyp, {_SHARE('rock_ft >= 20')} AS rock, {_SHARE('lost')} AS lost,
  quantile_cont(log_depth_ft, 0.5) AS dep FROM ({_pick(_LOGXY, 5, 'id')}) p GROUP BY eia_id) a ON s.eia_id = a.eia_id
"""
_LOG_OUT = ["n_logs", "logs_radius_mi", "thick_hard_layer_share", "caliche_log_share", "gypsum_log_share", "hard_rock_log_share", "lost_circulation_log_share"]


@query("share_and_percentiles", _LOGS)
def _(t):
    out = ly.log_layer(ids(t), points(t), t["sdr_wells"], t["sdr_lithology"], WCFG)
    return out.select("eia_id", *_LOG_OUT, R("hard_layer_ft_median"), R("hard_layer_ft_p90"), R("median_log_depth_ft"))


_LVL = f"""
SELECT s.eia_id, CAST(coalesce(a.n, f.n, 0) AS BIGINT) AS n_water_levels, a.radius_mi AS water_radius_mi, round(a.med, 4) AS depth_to_water_ft, round(a.p25, 4) AS depth_to_water_ft_p25, round(a.p75, 4) AS depth_to_water_ft_p75,
  a.src AS water_level_sources, CAST(a.yr AS BIGINT) AS latest_water_level_year
FROM site_geo s LEFT JOIN ({_FAR(_LVLXY)}) f ON s.eia_id = f.eia_id LEFT JOIN (SELECT eia_id, max(radius_mi) AS radius_mi, count(*) AS n, quantile_cont(depth_ft, 0.5) AS med, quantile_cont(depth_ft, 0.25) AS p25,
  quantile_cont(depth_ft, 0.75) AS p75, max(year) AS yr, concat_ws('; ', CASE WHEN count(CASE WHEN src = 'gwdb' THEN 1 END) > 0 THEN 'gwdb ' || count(CASE WHEN src = 'gwdb' THEN 1 END) END,
  CASE WHEN count(CASE WHEN src = 'sdr' THEN 1 END) > 0 THEN 'sdr ' || count(CASE WHEN src = 'sdr' THEN 1 END) END) AS src FROM ({_pick(_LVLXY, 3, 'level_id')}) p GROUP BY eia_id) a ON s.eia_id = a.eia_id
"""


@query("value_count_label", f"SELECT eia_id, water_level_sources FROM ({_LVL}) v")
def _(t):
    s = well_sources(t)
    return ly.level_layer(ids(t), points(t), ly.water_levels(s["sdr_wells"], s["sdr_levels"], s["gwdb_wells"], s["gwdb_levels"]), WCFG).select("eia_id", "water_level_sources")


@query("water_levels_near", _LVL)
def _(t):
    s = well_sources(t)
    out = ly.level_layer(ids(t), points(t), ly.water_levels(s["sdr_wells"], s["sdr_levels"], s["gwdb_wells"], s["gwdb_levels"]), WCFG)
    return out.select("eia_id", "n_water_levels", "water_radius_mi", R("depth_to_water_ft"), R("depth_to_water_ft_p25"), R("depth_to_water_ft_p75"), "water_level_sources", "latest_water_level_year")


@query("majority_label", f"""
SELECT eia_id, aquifer AS aquifer_majority FROM (SELECT eia_id, aquifer, row_number() OVER (PARTITION BY eia_id ORDER BY count(*) DESC, aquifer) AS rn FROM (
  SELECT eia_id, CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END AS aquifer, {_DPT} / {MI} AS mi FROM site_geo, feature_xy) p WHERE mi <= 40 AND trim(aquifer) <> '' GROUP BY eia_id, aquifer) r WHERE rn = 1
""")
def _(t):
    around = px.within_counts(points(t), px.feature_points(t["gwdb_wells"]).select("swn", "aquifer", "x1", "y1", "x2", "y2"), 40 * MI, ["aquifer"])
    return ly.majority_label(around, "eia_id", "aquifer", "aquifer_majority", "n")


_NEAR_WELL = lambda cols, src: f"SELECT eia_id, {cols}, {_DPT} / {MI} AS mi FROM site_geo, ({with_xy(src, x='fx', y='fy')}) f"
_MAJOR = lambda c: f"SELECT eia_id, v FROM (SELECT eia_id, {c} AS v, row_number() OVER (PARTITION BY eia_id ORDER BY count(*) DESC, {c}) AS rn FROM ({_NEAR_WELL('aquifer, gcd', 'SELECT * FROM gwdb_wells')}) w WHERE mi <= 10 AND trim({c}) <> '' GROUP BY eia_id, {c}) r WHERE rn = 1"


@query("wells_layer", f"""
SELECT g.*, v.* EXCLUDE (eia_id), CAST(coalesce(b.n, 0) AS BIGINT) AS n_geothermal_bores, aq.v AS aquifer_majority, gc.v AS gcd_majority, 'twdb sdr (driller logs, levels) + gwdb (levels, aquifer, gcd)' AS wells_source,
  '2026-10-05' AS wells_fetched, CASE WHEN coalesce(g.logs_radius_mi = 3, false) AND NOT s.geometry_is_point THEN 'medium' ELSE 'low' END AS wells_confidence
FROM ({_LOGS}) g JOIN ({_LVL}) v ON g.eia_id = v.eia_id JOIN site_geo s ON g.eia_id = s.eia_id
LEFT JOIN (SELECT eia_id, count(*) AS n FROM ({_NEAR_WELL('id', "SELECT * FROM sdr_wells WHERE lower(use) = 'closed-loop geothermal'")}) w WHERE mi <= 10 GROUP BY 1) b ON g.eia_id = b.eia_id
LEFT JOIN ({_MAJOR('aquifer')}) aq ON g.eia_id = aq.eia_id LEFT JOIN ({_MAJOR('gcd')}) gc ON g.eia_id = gc.eia_id
""")
def _(t):
    out = ly.wells_layer(ids(t), points(t), well_sources(t), WCFG, "2026-10-05")
    rounded = {"hard_layer_ft_median", "hard_layer_ft_p90", "median_log_depth_ft", "depth_to_water_ft", "depth_to_water_ft_p25", "depth_to_water_ft_p75"}
    return out.select(*[R(c) if c in rounded else F.col(c) for c in out.columns])


# ---- boxes ---------------------------------------------------------------------------------------------------------------
view("line_boxes", """
SELECT feature_id, least(lx1, lx2) AS xmin, least(ly1, ly2) AS ymin, greatest(lx1, lx2) AS xmax, greatest(ly1, ly2) AS ymax, lat1 AS lat, 0e0 - lon1 AS lon FROM line_feats
""")


@query("bbox_scan", "SELECT feature_id FROM line_boxes WHERE xmin <= -400000 AND xmax >= -700000 AND ymin <= 900000 AND ymax >= 600000")
def _(t):
    return px.bbox_scan(t["line_boxes"], -700000.0, 600000.0, -400000.0, 900000.0).select("feature_id")


@query("mask_scan", """
SELECT DISTINCT feature_id FROM line_boxes b, site_geo s WHERE b.xmin <= s.x + 3000 AND b.xmax >= s.x - 3000 AND b.ymin <= s.y + 3000 AND b.ymax >= s.y - 3000
""")
def _(t):
    return px.mask_scan(t["line_boxes"], points(t), 3000.0, 6000.0).select("feature_id")


@query("bbox_filter", "SELECT feature_id, round(0e0 - lon, 4) AS lon FROM line_boxes WHERE lat BETWEEN 28 AND 31.5 AND 0e0 - lon BETWEEN -104.5 AND -97")
def _(t):
    return px.bbox_filter(t["line_boxes"], [-104.5, 28.0, -97.0, 31.5], west=True).select("feature_id", R("lon"))
