"""Climate, soils, readers, publishing and serving."""

from pyspark.sql import functions as F

from ..config import config
from ..functions import text
from ..functions.physics import wet_bulb_stull
from ..operators import environment as env
from ..operators import serve
from ..session import scratch_path
from ..sources import publish as pub
from ..sources import tables as tb
from .registry import query, view

CFG = config()
R = lambda c, d=4: F.round(F.col(c), d).alias(c)

view("hourly", """
SELECT event_id, user_id % 20 AS point_id, 2020 + day(ts) % 4 AS year, CASE WHEN event_type = 'signup' AND value < 5 THEN NULL ELSE value / 9.7e0 - 5e0 END AS temp_c, 0e0 + event_id % 100 AS rh_pct FROM events
""")
_WB = """(temp_c * atan(0.151977e0 * sqrt(rh + 8.313659e0)) + atan(temp_c + rh) - atan(rh - 1.676331e0) + 0.00391838e0 * pow(rh, 1.5e0) * atan(0.023101e0 * rh) - 4.686035e0)"""
_H = f"SELECT *, {_WB} AS wb FROM (SELECT *, greatest(5e0, least(99e0, rh_pct)) AS rh FROM hourly) h0"


@query("wet_bulb_stull", f"SELECT event_id, round(wb, 6) AS wb FROM ({_H}) h")
def _(t):
    return t["hourly"].select("event_id", F.round(wet_bulb_stull(F.col("temp_c"), F.col("rh_pct")), 6).alias("wb"))


_YS = f"""SELECT point_id, year, avg(CASE WHEN temp_c < 15 THEN 1e0 WHEN temp_c IS NOT NULL THEN 0 END) * 8760 AS b15, avg(CASE WHEN temp_c < 25 THEN 1e0 WHEN temp_c IS NOT NULL THEN 0 END) * 8760 AS b25,
  avg(CASE WHEN wb < 20 THEN 1e0 WHEN wb IS NOT NULL THEN 0 END) * 8760 AS w20, avg(CASE WHEN temp_c > 35 THEN 1e0 WHEN temp_c IS NOT NULL THEN 0 END) * 8760 AS a35 FROM ({_H}) h GROUP BY 1, 2"""


@query("climate_year_stats", f"SELECT point_id, CAST(year AS BIGINT) AS year, round(b15, 4) AS below_15c_drybulb, round(b25, 4) AS below_25c_drybulb, round(w20, 4) AS below_20c_wetbulb, round(a35, 4) AS above_35c_drybulb FROM ({_YS}) y")
def _(t):
    y = env.year_stats(t["hourly"], CFG)
    return y.select("point_id", F.col("year").cast("bigint").alias("year"), R("below_15c_drybulb"), R("below_25c_drybulb"), R("below_20c_wetbulb"), R("above_35c_drybulb"))


@query("climate_summary", f"""
SELECT y.point_id, round_even(avg(b25), 0) AS hours_below_25c_drybulb, round_even(min(b25), 0) AS hours_below_25c_drybulb_min, round_even(avg(w20), 0) AS hours_below_20c_wetbulb,
  string_agg(year || ': ' || CAST(CAST(round_even(b25, 0) AS BIGINT) AS VARCHAR), '; ' ORDER BY year) AS hours_below_25c_by_year, any_value(p.m) AS mean_annual_temp_c, any_value(p.d) AS design_drybulb_0p4_c, any_value(p.w) AS design_wetbulb_0p4_c
FROM ({_YS}) y JOIN (SELECT point_id, round(avg(temp_c), 2) AS m, round(quantile_cont(temp_c, 0.996), 1) AS d, round(quantile_cont(wb, 0.996), 1) AS w FROM ({_H}) h GROUP BY 1) p ON y.point_id = p.point_id GROUP BY 1
""")
def _(t):
    c = env.climate_summary(t["hourly"], CFG)
    return c.select("point_id", "hours_below_25c_drybulb", "hours_below_25c_drybulb_min", "hours_below_20c_wetbulb", "hours_below_25c_by_year", "mean_annual_temp_c", "design_drybulb_0p4_c", "design_wetbulb_0p4_c")


view("typical_hours", "SELECT * FROM hourly WHERE year = 2021")
view("weather_cells", "SELECT s_suppkey % 20 AS point_id, min(s_suppkey) AS location_id, min(s_acctbal) AS lat, max(s_acctbal) AS lon, 1e0 * count(*) AS elevation_m FROM supplier GROUP BY 1")
view("weather_points", "SELECT n_nationkey AS point_id, n_regionkey = 1 AS geometry_is_point FROM nation")


@query("climate_layer", f"""
SELECT y.point_id, y.tmy AS hours_below_25c_drybulb_tmy, c.location_id AS nsrdb_location_id, c.lat AS nsrdb_lat, c.lon AS nsrdb_lon, c.elevation_m AS nsrdb_elevation_m,
  CASE WHEN p.geometry_is_point THEN 'low' WHEN NOT p.geometry_is_point THEN 'medium' END AS climate_confidence, 'nsrdb psm v4' AS climate_source, h.mx AS max_drybulb_c, '2020-2023' AS climate_years
FROM (SELECT point_id, max(CASE WHEN year = 2021 THEN round_even(b25, 0) END) AS tmy FROM ({_YS}) s GROUP BY 1) y JOIN (SELECT point_id, round_even(max(temp_c), 1) AS mx FROM hourly GROUP BY 1) h ON y.point_id = h.point_id
LEFT JOIN weather_cells c ON y.point_id = c.point_id LEFT JOIN weather_points p ON y.point_id = p.point_id
""")
def _(t):
    c = env.climate_summary(t["hourly"], CFG, t["typical_hours"], t["weather_cells"], t["weather_points"])
    return c.select("point_id", "hours_below_25c_drybulb_tmy", "nsrdb_location_id", "nsrdb_lat", "nsrdb_lon", "nsrdb_elevation_m", "climate_confidence", "climate_source", "max_drybulb_c", "climate_years")


view("horizons", """
SELECT l_orderkey % 50 AS mukey, l_suppkey % 4 AS cokey, concat('Soil ', CAST(l_suppkey % 4 AS STRING)) AS compname, concat('MU ', CAST(l_orderkey % 50 AS STRING)) AS muname, 13e0 + l_suppkey % 4 * 8 AS comppct_r, l_linenumber * 30e0 AS hzdept_r, l_linenumber * 30e0 + l_quantity AS hzdepb_r,
  5e0 + l_partkey % 80 AS sandtotal_r, 10e0 + l_partkey % 15 AS claytotal_r, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 1.2e0 + l_discount * 5e0 END AS dbthirdbar_r, 15e0 + l_tax * 100e0 AS wthirdbar_r FROM lineitem
""")
view("site_mapunits", "SELECT DISTINCT c_custkey % 200 AS eia_id, c_nationkey * 2 AS mukey, 1e0 + c_nationkey AS a FROM customer")
view("restrictions", "SELECT s_suppkey % 50 AS mukey, s_suppkey % 4 AS cokey, 13e0 + s_suppkey % 4 * 8 AS comppct_r, 'Bedrock' AS reskind, s_acctbal / 40e0 AS resdept_r FROM supplier")
_LAM = """(SELECT *, CASE WHEN q * 100 >= 50 THEN 3.55e0 ELSE 1.9e0 END AS k, pow(pow(7.7e0, q) * pow(CASE WHEN q > 0.2e0 THEN 2e0 ELSE 3e0 END, 1 - q), 1 - n) * pow(0.6e0, n) AS sat, 0.75e0 * pow(10e0, -1.2e0 * n) AS dry, greatest(0e0, least(1e0, wthirdbar_r / 100e0 / n)) AS sr
  FROM (SELECT *, greatest(0e0, least(1e0, sandtotal_r / 100e0)) AS q, greatest(0.05e0, least(0.95e0, 1e0 - dbthirdbar_r / 2.65e0)) AS n, greatest(least(hzdepb_r, 200e0) - least(hzdept_r, 200e0), 0e0) AS w FROM horizons WHERE dbthirdbar_r IS NOT NULL) a WHERE w > 0)"""
_HW = f"SELECT mukey, cokey, compname, comppct_r, sum(((sat - dry) * (k * sr / (1 + (k - 1) * sr)) + dry) * w) / sum(w) AS lam, sum(dry * w) / sum(w) AS lam_dry, sum(sat * w) / sum(w) AS lam_sat, sum(sandtotal_r * w) / sum(w) AS sand FROM {_LAM} b GROUP BY 1, 2, 3, 4"


@query("horizon_depth_weight", f"SELECT mukey, cokey, round(lam, 5) AS lam, round(lam_dry, 5) AS lam_dry, round(lam_sat, 5) AS lam_sat, round(sand, 4) AS sandtotal_r FROM ({_HW}) h")
def _(t):
    return env.horizon_depth_weight(t["horizons"], CFG).select("mukey", "cokey", R("lam", 5), R("lam_dry", 5), R("lam_sat", 5), R("sandtotal_r"))


view("bedrock", "SELECT p_partkey % 50 AS mukey, CASE WHEN p_size > 45 THEN 'deep' ELSE CAST(p_retailprice AS STRING) END AS brockdepmin FROM part WHERE p_partkey % 50 < 30")
view("soil_points", "SELECT c_custkey % 200 AS eia_id, min(c_nationkey) = 3 AS geometry_is_point FROM customer GROUP BY 1")
_MU = "SELECT m.*, t.n, CASE WHEN t.tot > 0 THEN m.a / t.tot ELSE 1e0 / t.n END AS share FROM site_mapunits m JOIN (SELECT eia_id, sum(a) AS tot, count(*) AS n FROM site_mapunits GROUP BY 1) t ON m.eia_id = t.eia_id"
_HC = f"""SELECT mukey, cokey, compname, min(muname) AS muname, comppct_r, {', '.join(f'sum({v} * w) / sum(w) AS {k}' for k, v in {'lam': '((sat - dry) * (k * sr / (1 + (k - 1) * sr)) + dry)', 'lam_dry': 'dry', 'lam_sat': 'sat', 'sand': 'sandtotal_r', 'clay': 'claytotal_r', 'bd': 'dbthirdbar_r', 'th': 'wthirdbar_r'}.items())} FROM {_LAM} b GROUP BY mukey, cokey, compname, muname, comppct_r"""
_RESTR = f"SELECT mu.eia_id, r.cokey, mu.share * r.comppct_r / 100 AS s, r.resdept_r, r.reskind FROM ({_MU}) mu JOIN restrictions r ON mu.mukey = r.mukey WHERE coalesce(r.resdept_r, 0) < 200"


def _even(x: str, digits: int) -> str:
    """The rounding of published figures: nine digits first, then halves to even."""
    return f"round_even(round(({x}) * 1e{digits}, {9 - digits}), 0) / 1e{digits}"


@query("soil_rollup", f"""
WITH comp AS (SELECT mu.eia_id, c.*, mu.share * c.comppct_r / 100e0 AS w FROM ({_MU}) mu JOIN ({_HC}) c ON mu.mukey = c.mukey),
o AS (SELECT eia_id, sum(w) AS tw, {', '.join(f'{_even('sum(' + v + ' * w) / sum(w)', d)} AS {k}' for k, v, d in (('soil_lambda_w_mk', 'lam', 3), ('soil_lambda_dry_w_mk', 'lam_dry', 3), ('soil_lambda_sat_w_mk', 'lam_sat', 3), ('soil_sand_pct', 'sand', 1), ('soil_clay_pct', 'clay', 1), ('soil_bulk_density', 'bd', 2), ('soil_theta_fc', 'th', 1)))} FROM comp GROUP BY 1 HAVING sum(w) > 0),
dom AS (SELECT eia_id, compname || ' (' || CAST(CAST({_even('m * 100', 0)} AS BIGINT) AS VARCHAR) || '%' || ')' AS dominant_soil FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY round(m, 9) DESC, compname) AS rn FROM (SELECT eia_id, compname, sum(w) AS m FROM comp GROUP BY 1, 2) n) q WHERE rn = 1),
dmu AS (SELECT l.eia_id, n.muname AS dominant_mapunit FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY round(share, 9) DESC, mukey) AS rn FROM ({_MU}) z) l LEFT JOIN (SELECT mukey, min(muname) AS muname FROM ({_HC}) h GROUP BY 1) n ON l.mukey = n.mukey WHERE rn = 1),
rs AS (SELECT eia_id, {_even('sum(s)', 3)} AS restriction_share, min(d) AS restriction_min_depth_cm FROM (SELECT eia_id, cokey, max(s) AS s, min(resdept_r) AS d FROM ({_RESTR}) r0 GROUP BY 1, 2) r1 GROUP BY 1),
kinds AS (SELECT eia_id, string_agg(DISTINCT reskind, '; ') AS restriction_kinds FROM ({_RESTR}) r2 GROUP BY 1),
rock AS (SELECT mu.eia_id, min(TRY_CAST(b.brockdepmin AS DOUBLE)) AS bedrock_depth_cm_min FROM ({_MU}) mu JOIN bedrock b ON mu.mukey = b.mukey GROUP BY 1)
SELECT m.eia_id, m.n AS n_mapunits, o.* EXCLUDE (eia_id, tw), CASE WHEN tw IS NULL THEN NULL ELSE dominant_soil END AS dominant_soil, CASE WHEN tw IS NULL THEN NULL ELSE dominant_mapunit END AS dominant_mapunit,
  CASE WHEN tw IS NULL THEN NULL ELSE coalesce(restriction_share, 0) END AS restriction_share, CASE WHEN tw IS NULL THEN NULL ELSE restriction_min_depth_cm END AS restriction_min_depth_cm, CASE WHEN tw IS NULL THEN NULL ELSE restriction_kinds END AS restriction_kinds,
  CASE WHEN tw IS NULL THEN NULL ELSE bedrock_depth_cm_min END AS bedrock_depth_cm_min, CASE WHEN tw IS NULL THEN 'no_soil_data' ELSE 'ok' END AS soil_status, {_even('coalesce(tw, 0)', 3)} AS soil_data_share,
  'usda nrcs ssurgo via soil data access; lambda: cote & konrad (2005) at field capacity' AS soil_source, CASE WHEN tw IS NOT NULL AND {_even('tw', 3)} >= 0.8 AND NOT coalesce(p.geometry_is_point, true) THEN 'medium' ELSE 'low' END AS soil_confidence
FROM (SELECT DISTINCT eia_id, n FROM ({_MU}) z2) m LEFT JOIN o ON m.eia_id = o.eia_id LEFT JOIN dom ON m.eia_id = dom.eia_id LEFT JOIN dmu ON m.eia_id = dmu.eia_id LEFT JOIN rs ON m.eia_id = rs.eia_id
LEFT JOIN kinds ON m.eia_id = kinds.eia_id LEFT JOIN rock ON m.eia_id = rock.eia_id LEFT JOIN soil_points p ON m.eia_id = p.eia_id
""")
def _(t):
    return env.soil_rollup(t["site_mapunits"], env.horizon_depth_weight(t["horizons"], CFG), t["restrictions"], CFG, t["bedrock"], t["soil_points"])


view("tags", "SELECT event_id, concat(CAST(event_id % 400 AS STRING), ' kV; ', CAST(event_id * 100 % 600000 AS STRING), ';x') AS tag, concat(CASE WHEN event_type = 'view' THEN 'US 90; ' ELSE '' END, CASE WHEN value > 20 THEN 'I ' ELSE 'FM ' END, CAST(event_id % 90 AS STRING)) AS ref FROM events")


@query("parse_kv", "SELECT event_id, greatest(CASE WHEN event_id % 400 > 0 THEN event_id % 400 END, CASE WHEN event_id * 100 % 600000 >= 1000 THEN (event_id * 100 % 600000) / 1000e0 WHEN event_id * 100 % 600000 > 0 THEN event_id * 100 % 600000 END)::DOUBLE AS kv FROM tags")
def _(t):
    return t["tags"].select("event_id", text.parse_kv(F.col("tag")).alias("kv"))


@query("interstate_ref", "SELECT event_id, CASE WHEN ref LIKE 'I %' OR ref LIKE '%; I %' THEN 'I-' || (event_id % 90) END AS ref FROM tags")
def _(t):
    return t["tags"].select("event_id", text.interstate_ref(F.col("ref"), CFG["layers"]["fiber"]["interstate_pattern"]).alias("ref"))


@query("lithology_classes", """
SELECT lang, count(CASE WHEN regexp_matches(upper(text), 'LIME ?STONE|LIME ?ROCK|DOLOM|HARD ROCK') THEN 1 END) AS rock, count(CASE WHEN regexp_matches(upper(text), 'GYP|ANHYD|SELENITE') THEN 1 END) AS gypsum, count(CASE WHEN regexp_matches(upper(text), 'VOID|CAVITY') THEN 1 END) AS lost, count(*) AS n FROM documents GROUP BY lang
""")
def _(t):
    u = F.upper("text")
    return t["documents"].groupBy("lang").agg(F.count_if(u.rlike("LIME ?STONE|LIME ?ROCK|DOLOM|HARD ROCK")).alias("rock"), F.count_if(u.rlike("GYP|ANHYD|SELENITE")).alias("gypsum"),
                                              F.count_if(u.rlike("VOID|CAVITY")).alias("lost"), F.count(F.lit(1)).alias("n"))


@query("split_limit_read", "SELECT doc_id AS id, length(text || '|' || source) AS n FROM documents WHERE n_chars IS NOT NULL")
def _(t):
    lines = t["documents"].select(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("x"), F.lit("1.5"), F.col("n_chars").cast("string"), "text", "source").alias("value"))
    return tb.split_limit(lines).select("id", F.length("desc").cast("bigint").alias("n"))


@query("header_normalize", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS k FROM customer")
def _(t):
    return t["customer"].select("c_custkey", text.header_key_col(F.col("c_name")).alias("k"))


@query("attribute_candidates", "SELECT CAST(NULL AS VARCHAR) AS owner, c_custkey AS prop_id, c_mktsegment AS land_use FROM customer")
def _(t):
    src = t["customer"].withColumnsRenamed({"c_custkey": "Prop ID", "c_mktsegment": "Land-Use"})
    return tb.pick_attributes(src, {k: CFG["layers"]["parcels"]["fields"][k] for k in ("owner", "prop_id", "land_use")})


@query("keyed_table_clean", "SELECT o_orderkey AS k, o_orderpriority AS v FROM orders")
def _(t):
    mixed = t["orders"].select(F.col("o_orderkey").cast("string").alias("k"), F.concat(F.lit(" "), "o_orderpriority").alias("v")).union(t["orders"].select(F.concat(F.lit("note "), F.col("o_orderkey").cast("string")), F.lit("x")))
    return tb.keyed_rows(mixed, "k")


@query("day_partition_scan", "SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    ev = t["events"].select("event_id", F.col("user_id").alias("resource_name"), F.to_date("ts").alias("operating_day"))
    return tb.day_scan(ev, "2024-01-05", "2024-01-12", t["customer"].filter("c_acctbal > 0").select(F.col("c_custkey").alias("resource_name"))).select("event_id")


@query("missing_partition_report", "SELECT strftime(CAST(d AS DATE), '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS d) s WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)")
def _(t):
    return tb.days_missing(t["events"].select(F.to_date("ts").alias("day")), "2023-12-25", "2024-02-05").select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("versioned_publish", "SELECT o_orderkey, o_orderstatus, 'r2' AS run_id FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    path = scratch_path(t.spark, "publish")
    pub.publish(t["orders"].select("o_orderkey", "o_orderstatus"), path, "o_orderkey", "r1")
    pub.publish(t["orders"].filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus"), path, "o_orderkey", "r2")
    return pub.current(t.spark, path)


@query("domain_constraints", "SELECT 'o_orderstatus' AS \"column\", 'P' AS value, count(*) AS n_rows FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return pub.domain_violations(t["orders"], {"o_orderstatus": ["O", "F"]}, ["o_orderkey"])


@query("ui_search_filter", "SELECT eia_id FROM score_rows WHERE tier IN ('T1a', 'T2') AND filter_status = 'pass' AND (lower(plant_name) LIKE '%00012%' OR lower(county) LIKE '%00012%')")
def _(t):
    return serve.search_filter(t["score_rows"].withColumn("operator", F.lit(None).cast("string")), ["T1a", "T2"], ["pass"], " 00012").select("eia_id")


@query("map_points", "SELECT eia_id, CASE WHEN s < 40 THEN '< 40' WHEN s < 50 THEN '40–50' WHEN s < 60 THEN '50–60' WHEN s < 70 THEN '60–70' WHEN s >= 70 THEN '≥ 70' END AS score_bin FROM (SELECT eia_id, hours_below_25c_drybulb / 100e0 AS s FROM score_rows) r")
def _(t):
    return t["score_rows"].select("eia_id", serve.score_bin(F.col("hours_below_25c_drybulb") / 100.0).alias("score_bin"))


_CAV = [("Load import capability", "'applies'"), ("SB6 large-load risk", "CASE WHEN firm_it_mw > 30 THEN 'required' ELSE 'applies' END"), ("Mineral estate", "CASE WHEN lon < -100 THEN 'required' ELSE 'check' END"), ("Behind-the-meter configuration", "'applies'"),
        ("Chapter 313 / JETI abatement", "'check'"), ("Tax-equity consent", "CASE WHEN year(cod_first) >= 2019 THEN 'applies' ELSE 'not flagged' END"), ("ITC recapture window", "'not flagged'")]


@query("caveat_rows", " UNION ALL ".join(f"SELECT eia_id, {i} AS n, '{title}' AS title, {status} AS status FROM score_rows" for i, (title, status) in enumerate(_CAV, 1)))
def _(t):
    df = t["score_rows"].withColumn("region", F.when(F.col("lon") < -100, "west_texas")).withColumn("sb6_review_required", F.col("firm_it_mw") > 30)
    df = df.withColumn("tax_equity_consent_likely", F.year("cod_first") >= 2019).withColumn("itc_recapture_open", F.lit(None).cast("boolean"))
    return serve.caveats(df)


@query("metric_labels", """
SELECT eia_id, CASE metrics_status WHEN 'ok' THEN 'Metrics available' WHEN 'no_full_months' THEN 'Fewer than one full month of SCED data' ELSE 'Crosswalk not verified yet' END AS label FROM score_rows
""")
def _(t):
    # Status texts of the published tables.
    labels = {"ok": "Metrics available", "no_ercot_resource": "No ERCOT resource (behind the meter)", "no_sced_data": "Not a telemetered PV resource (no SCED data)",
              "no_full_months": "Fewer than one full month of SCED data", "no_settlement_point": "No settlement point: curtailment only", "too_little_generation": "Too little generation to price"}
    return t["score_rows"].select("eia_id", text.label_map(F.col("metrics_status"), labels, F.lit("Crosswalk not verified yet")).alias("label"))


@query("month_from_name", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN year(o_orderdate) || '-08' ELSE 'unknown' END AS month FROM orders")
def _(t):
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("August_generator"), F.year("o_orderdate").cast("string"), F.lit(".xlsx"))).otherwise("notes.xlsx")
    return t["orders"].select("o_orderkey", text.month_from_name(name).alias("month"))


@query("release_from_name", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'J25 30jun' || year(o_orderdate) END AS release FROM orders")
def _(t):
    name = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("bdc_48_x_J25_30jun"), F.year("o_orderdate").cast("string"), F.lit(".csv"))).otherwise("x.csv")
    return t["orders"].select("o_orderkey", text.release_from_name(name).alias("release"))


@query("export_wide_join", "SELECT p.eia_id, p.tier, s.metrics_status, l.lat FROM score_rows p JOIN score_rows s ON p.eia_id = s.eia_id JOIN score_rows l ON p.eia_id = l.eia_id WHERE p.filter_status <> 'fail'")
def _(t):
    w = t["score_rows"]
    scores = w.select("eia_id", "metrics_status", F.lit(1).alias("rank_overall"), F.lit(1.0).alias("score_total"))
    return serve.wide_export(w.select("eia_id", "filter_status", "tier"), scores, w.select("eia_id", "lat", F.lit("x").alias("tier"))).select("eia_id", "tier", "metrics_status", "lat")


view("months_in", "SELECT s_suppkey AS eia_id, substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS month, count(DISTINCT CAST(o_orderdate AS DATE)) * 9 AS days FROM orders JOIN supplier ON o_custkey % 100 = s_suppkey GROUP BY 1, 2")


@query("monthly_export", "SELECT m.eia_id, m.month, m.days, s_name AS plant_name, m.days / CAST(day(last_day(CAST(m.month || '-01' AS DATE))) AS DOUBLE) >= 0.9 AS full_month FROM months_in m JOIN supplier ON m.eia_id = s_suppkey")
def _(t):
    names = t["supplier"].select(F.col("s_suppkey").alias("eia_id"), F.col("s_name").alias("plant_name"))
    return serve.monthly_export(t["months_in"], names).select("eia_id", "month", "days", "plant_name", "full_month")


@query("union_sources", "SELECT id, src FROM (SELECT c_custkey AS id, c_mktsegment AS seg, 'c' AS src FROM customer UNION ALL SELECT s_suppkey, NULL, 's' FROM supplier) u")
def _(t):
    a = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.lit("c").alias("src"))
    return a.unionByName(t["supplier"].select(F.col("s_suppkey").alias("id"), F.lit("s").alias("src")), allowMissingColumns=True).select("id", "src")


@query("dedupe_overlapping_boxes", "SELECT DISTINCT l_orderkey FROM lineitem")
def _(t):
    return t["lineitem"].select("l_orderkey").dropDuplicates(["l_orderkey"])


@query("county_filter", "SELECT eia_id FROM score_rows WHERE lower(trim(county)) = 'county 7'")
def _(t):
    return t["score_rows"].filter(F.lower(F.trim("county")) == " COUNTY 7 ".strip().lower()).select("eia_id")


@query("table_validate", """
SELECT tag, problem FROM (SELECT CAST(project_id AS VARCHAR) AS tag, unnest(list_filter([CASE WHEN kind NOT IN ('data_center', 'crypto', 'hydrogen', 'industrial', 'other') THEN 'kind' END, CASE WHEN status NOT IN ('operating', 'under_construction', 'announced') THEN 'status' END,
  CASE WHEN lat NOT BETWEEN 28 AND 36.6 THEN 'lat/lon outside' END], lambda v: v IS NOT NULL)) AS problem FROM projects) p
""")
def _(t):
    from ..operators.rules import error_rows
    c = CFG["layers"]["load_pocket"]
    tests = [(~F.col("kind").isin(c["kinds"]), "kind"), (~F.col("status").isin(c["statuses"][:3]), "status"), (~F.col("lat").between(28.0, 36.6), "lat/lon outside")]
    return error_rows(t["projects"], tests, F.col("project_id").cast("string"))
