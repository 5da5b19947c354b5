"""Reports, serving tables, readers and publishing over the driver tables."""

from pyspark.sql import functions as F

from ..functions.bands import order_key
from ..functions.text import number_text
from ..operators import matching as mt
from ..operators import scoring as sc
from ..operators import serve
from ..session import scratch_path
from ..sources import publish as pub
from ..sources import tables as tb
from .q_market import _MONTHLY, _SUMMARY_OUT, metrics, summary_out
from .q_score import _RANK, _SCORED, _W, CFG, scored
from .registry import query, view

R = lambda c, d=6: F.round(F.col(c), d).alias(c)

view("grid_plants", "SELECT eia_id, plant_name, county, tier, filter_status, firm_it_mw AS ac_mw, net_ac_cf, bifacial_share IS NOT NULL AS uspvdb_match FROM score_rows")
view("flood_rows", "SELECT s_suppkey AS eia_id, CASE WHEN s_acctbal < 0 THEN 'no_data' ELSE 'ok' END AS flood_status, s_acctbal > 5000 AS flood_flag FROM supplier")
view("orphan_rows", "SELECT s_suppkey AS eia_id, concat(' COUNTY ', CAST(s_nationkey AS STRING), ' County') AS p_county FROM supplier")


@query("order_ranked_then_score", "SELECT eia_id, row_number() OVER (ORDER BY CASE WHEN filter_status = 'pass' THEN 0 ELSE 1 END, hours_below_25c_drybulb DESC, eia_id) AS pos FROM score_rows WHERE filter_status <> 'fail'")
def _(t):
    df = t["score_rows"].filter("filter_status <> 'fail'").withColumn("rank_overall", F.when(F.col("filter_status") == "pass", 1))
    return serve.positions(df.select("eia_id", "rank_overall", F.col("hours_below_25c_drybulb").alias("score_total")), serve.ranked_order()).select("eia_id", "pos")


@query("top25_report", f"""
WITH k AS ({_RANK}) SELECT * FROM (SELECT 'top' AS list, eia_id, rank_overall AS rank, round(score_total, 6) AS score_total FROM k WHERE rank_overall IS NOT NULL ORDER BY rank_overall, eia_id LIMIT 25) a
UNION ALL SELECT tier, eia_id, rank_in_tier, round(score_total, 6) FROM k WHERE rank_in_tier IS NOT NULL
UNION ALL SELECT 'county', eia_id, rank_overall, round(score_total, 6) FROM k WHERE county LIKE '%County 7%'
""")
def _(t):
    return serve.top_report(scored(t), "County 7").select("list", "eia_id", "rank", R("score_total"))


@query("score_report", f"""
SELECT count(rank_overall) AS n_ranked, count(*) - count(rank_overall) AS n_unranked, round(min(CASE WHEN rank_overall IS NOT NULL THEN score_total END), 6) AS total_min,
  round(quantile_cont(CASE WHEN rank_overall IS NOT NULL THEN score_total END, 0.5), 6) AS total_median, round(max(CASE WHEN rank_overall IS NOT NULL THEN score_total END), 6) AS total_max,
  round(quantile_cont(CASE WHEN rank_overall IS NOT NULL THEN data_completeness END, 0.5), 6) AS completeness_median FROM ({_RANK}) k
""")
def _(t):
    return serve.score_report(scored(t)).select("n_ranked", "n_unranked", R("total_min"), R("total_median"), R("total_max"), R("completeness_median"))


_MM = ["capture_rate", "capture_rate_potential", "shape_capture", "basis_ratio", "curtailment_pct", "sced_net_cf", "sced_potential_cf"]


@query("market_report", " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS n, round(min({m}), 4) AS min, round(quantile_cont({m}, 0.25), 4) AS q25, round(quantile_cont({m}, 0.5), 4) AS median, round(quantile_cont({m}, 0.75), 4) AS q75, round(max({m}), 4) AS max FROM s WHERE metrics_status = 'ok'" for m in _MM).join([f"WITH s AS ({_SUMMARY_OUT}) SELECT * FROM (", ") r WHERE n > 0"]))
def _(t):
    m = serve.market_report(metrics(t)[1])
    return m.select("metric", "n", *[R(c, 4) for c in ("min", "q25", "median", "q75", "max")])


@query("market_status", f"SELECT metrics_status, count(*) AS n FROM ({_SUMMARY_OUT}) s GROUP BY 1")
def _(t):
    return serve.status_counts(summary_out(t), "metrics_status")


@query("crosswalk_report", """
SELECT match_confidence, count(*) AS n_plants, count(CASE WHEN v THEN 1 END) AS n_verified, CAST(sum(r) AS BIGINT) AS n_rows FROM (
  SELECT eia_plant_id, arg_min(match_confidence, coalesce(ercot_resource_name, '')) AS match_confidence, coalesce(bool_or(trim(verified_by) <> ''), false) AS v, count(*) AS r FROM old_matches GROUP BY 1) p GROUP BY 1
""")
def _(t):
    return serve.crosswalk_report(t["old_matches"])


@query("layer_report", "SELECT p.eia_id, p.plant_name, p.county, p.tier, round_even(p.ac_mw, 1) AS ac_mw, f.flood_status, f.flood_flag FROM grid_plants p JOIN flood_rows f ON p.eia_id = f.eia_id WHERE lower(p.county) = 'county 7'")
def _(t):
    return serve.layer_report(t["flood_rows"], t["grid_plants"], "COUNTY 7")


@query("plant_report_join", "SELECT p.eia_id, p.plant_name, p.county, p.tier, f.flood_flag FROM grid_plants p JOIN flood_rows f ON p.eia_id = f.eia_id")
def _(t):
    return serve.layer_report(t["flood_rows"], t["grid_plants"]).select("eia_id", "plant_name", "county", "tier", "flood_flag")


@query("county_handcheck", """
WITH p AS (SELECT * FROM grid_plants WHERE lower(trim(county)) = 'county 5'), cf AS (SELECT net_ac_cf AS v FROM p WHERE filter_status <> 'fail' AND net_ac_cf IS NOT NULL)
SELECT section, key, n, round(ac_mw, 4) AS ac_mw, round(value, 6) AS value FROM (
SELECT 'total' AS section, 'plants' AS key, count(*) AS n, sum(ac_mw) AS ac_mw, CAST(NULL AS DOUBLE) AS value FROM p
UNION ALL SELECT 'total', 'matched', count(*), sum(ac_mw), NULL FROM p WHERE uspvdb_match
UNION ALL SELECT 'total', 'orphans', count(*), NULL, NULL FROM orphan_rows WHERE lower(trim(p_county)) LIKE 'county 5%'
UNION ALL SELECT 'status', filter_status, count(*), sum(ac_mw), NULL FROM p GROUP BY 2
UNION ALL SELECT 'capacity factor', 'min', NULL, NULL, min(v) FROM cf HAVING count(*) > 0 UNION ALL SELECT 'capacity factor', 'median', NULL, NULL, quantile_cont(v, 0.5) FROM cf HAVING count(*) > 0
UNION ALL SELECT 'capacity factor', 'max', NULL, NULL, max(v) FROM cf HAVING count(*) > 0) u
""")
def _(t):
    c = serve.county_handcheck(t["grid_plants"], t["orphan_rows"], " County 5 ")
    return c.select("section", "key", "n", R("ac_mw", 4), R("value"))


_GRID = f"SELECT p.eia_id, p.filter_status, p.tier, p.ac_mw, s.score_total, f.flood_status, f.flood_flag FROM grid_plants p LEFT JOIN ({_RANK}) s ON p.eia_id = s.eia_id LEFT JOIN flood_rows f ON p.eia_id = f.eia_id"


def grid(t):
    return serve.ranked_grid(t["grid_plants"], scored(t).select("eia_id", "plant_name", "score_total", "rank_overall"), t["flood_rows"])


@query("ranked_grid", f"SELECT eia_id, filter_status, ac_mw, round(score_total, 6) AS score_total, flood_status, flood_flag FROM ({_GRID}) g")
def _(t):
    return grid(t).select("eia_id", "filter_status", "ac_mw", R("score_total"), "flood_status", "flood_flag")


@query("grid_totals", f"SELECT count(*) AS n_plants, round(sum(ac_mw), 4) AS ac_mw FROM ({_GRID}) g WHERE tier = 'T1a' AND filter_status = 'pass'")
def _(t):
    return serve.grid_totals(grid(t).filter("tier = 'T1a' AND filter_status = 'pass'")).select("n_plants", R("ac_mw", 4))


@query("ranked_export", f"""
SELECT eia_id, flood_flag, rank_custom, round(score_custom, 6) AS score_custom, row_number() OVER (ORDER BY rank_custom NULLS LAST, round(score_custom, 9) DESC, eia_id) AS pos FROM (
  SELECT s.eia_id, f.flood_flag, {_W} AS score_custom, CASE WHEN s.filter_status = 'pass' THEN rank() OVER (PARTITION BY s.filter_status ORDER BY round({_W}, 9) DESC) END AS rank_custom
  FROM ({_SCORED}) s LEFT JOIN flood_rows f ON s.eia_id = f.eia_id) q
""")
def _(t):
    s = scored(t)
    scores = s.select("eia_id", "rank_overall", "score_total", *[f"score_{k}" for k in sc.SECTIONS])
    out = serve.ranked_export(s.select("eia_id", "filter_status", "tier"), scores, [t["flood_rows"]], {"a": 10, "b": 40, "d": 140}, CFG)
    return out.select("eia_id", "flood_flag", "rank_custom", R("score_custom"), "pos")


@query("full_months", f"SELECT eia_id, count(CASE WHEN f THEN 1 END) AS n_full, count(CASE WHEN NOT f THEN 1 END) AS n_excluded FROM (SELECT eia_id, days / CAST(day(last_day(CAST(month || '-01' AS DATE))) AS DOUBLE) >= 0.9 AS f FROM ({_MONTHLY}) m) x GROUP BY 1")
def _(t):
    return serve.full_months(metrics(t)[0])


@query("peak_warning", f"SELECT eia_id, coalesce(peak_hsl_ratio_recent < 0.75, false) AS peak_warning FROM ({_SUMMARY_OUT}) s")
def _(t):
    return serve.peak_warning(summary_out(t)).select("eia_id", "peak_warning")


@query("site_dossier", f"""
SELECT p.eia_id, p.plant_name, (SELECT count(*) FROM months_in m WHERE m.eia_id = p.eia_id) AS n_months, (SELECT min(month) FROM months_in m WHERE m.eia_id = p.eia_id) AS first_month, f.flood_status, f.flood_flag
FROM grid_plants p LEFT JOIN flood_rows f ON p.eia_id = f.eia_id WHERE p.eia_id = 7
""")
def _(t):
    d = serve.dossier(t["grid_plants"], t["months_in"], {"flood": t["flood_rows"]}, 7)
    return d.select("eia_id", "plant_name", F.when(F.col("months").isNull(), 0).otherwise(F.size("months")).cast("bigint").alias("n_months"),
                    F.expr("months[0].month").alias("first_month"), "flood.flood_status", "flood.flood_flag")


@query("monthly_fk_filter", "SELECT eia_id, month, days FROM months_in WHERE eia_id IN (SELECT eia_id FROM grid_plants WHERE filter_status IN ('pass', 'review'))")
def _(t):
    return serve.monthly_of_published(t["months_in"], t["grid_plants"].filter("filter_status IN ('pass', 'review')"))


@query("plant_rows", "SELECT p.eia_id, p.plant_name, CAST(NULL AS VARCHAR) AS operator, s.metrics_status, CAST(NULL AS VARCHAR) AS sced_coverage FROM grid_plants p LEFT JOIN score_rows s ON p.eia_id = s.eia_id WHERE p.filter_status <> 'fail'")
def _(t):
    return pub.plant_rows(t["grid_plants"], ["eia_id", "plant_name", "operator"], t["score_rows"].select("eia_id", "metrics_status"), ["metrics_status", "sced_coverage"])


@query("upsert", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    old = t["orders"].select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice")).filter("o_orderkey % 2 = 0")
    return pub.upsert(old, t["orders"].select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("stale_run_removal", "SELECT count(*) AS n, 'r2' AS run_id FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    path = scratch_path(t.spark, "publish")
    pub.publish(t["orders"].select("o_orderkey"), path, "o_orderkey", "r1")
    pub.publish(t["orders"].filter("o_orderstatus <> 'P'").select("o_orderkey"), path, "o_orderkey", "r2")
    pub.drop_stale_runs(t.spark, path)
    return t.spark.read.option("basePath", path).parquet(path).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))


@query("state_manifest", "SELECT 'layers/flood.parquet' AS name, count(*) AS n_rows FROM flood_rows UNION ALL SELECT 'layers/orphans.parquet', count(*) FROM orphan_rows")
def _(t):
    root = scratch_path(t.spark, "state")
    pub.write_layer(t["flood_rows"], root, "flood")
    pub.write_layer(t["orphan_rows"], root, "orphans")
    return pub.manifest(t.spark, root, ["layers/flood.parquet", "layers/orphans.parquet"]).select("name", "n_rows")


@query("layer_write", "SELECT * FROM flood_rows")
def _(t):
    return t.spark.read.parquet(pub.write_layer(t["flood_rows"], scratch_path(t.spark, "layer"), "flood"))


@query("hand_table_read", "SELECT CAST(c_custkey AS BIGINT) AS id, nullif(trim(c_mktsegment), 'BUILDING') AS kind, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_acctbal END AS mw, CAST(NULL AS VARCHAR) AS note FROM customer")
def _(t):
    raw = t["customer"].select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.concat("c_mktsegment", F.lit(" "))).alias("kind"),
                               F.when(F.col("c_nationkey") == 3, "about 5").otherwise(F.col("c_acctbal").cast("string")).alias("mw"))
    return tb.hand_table(raw, {"id": "bigint", "kind": "string", "mw": "double", "note": "string"})


@query("multi_sheet_union", "SELECT p_partkey AS unit_code, 'old' AS sheet FROM part WHERE p_size < 25 AND p_type = 'SMALL' UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_size >= 25 AND p_type = 'SMALL'")
def _(t):
    rows = t["part"].select(F.col("p_partkey").alias("unit_code"), F.lower("p_type").alias("fuel"), "p_size")
    sheets = {"old": rows.filter("p_size < 25"), "new": rows.filter("p_size >= 25").withColumn("extra", F.lit(1)), "notes": rows.select(F.lit("x").alias("text"))}
    return tb.union_sheets(sheets, "Unit Code", "fuel", ["SMALL"]).select("unit_code", "sheet")


@query("latest_snapshot_pick", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders)")
def _(t):
    return tb.latest_snapshot(t["orders"].withColumn("source_month", F.date_format("o_orderdate", "yyyy-MM")), "source_month").select("o_orderkey")


@query("required_columns_check", "SELECT c_custkey AS eia_id, c_nationkey AS p_area FROM customer")
def _(t):
    return tb.require_columns(t["customer"].select(F.col("c_custkey").alias("EIA_ID"), F.col("c_nationkey").alias("P_Area")), ["eia_id", "p_area"])


@query("location_cache_invalidate", "SELECT DISTINCT CAST(ts AS DATE)::VARCHAR AS day FROM events")
def _(t):
    needed = t["unit_crosswalk"].select(F.trim("ercot_settlement_point").alias("location")).filter("location <> ''")
    recorded = t["price_rows"].filter("location <> 'click'").select("location")
    return tb.days_to_read_again(needed, recorded, t["events"].select(F.to_date("ts").alias("day"))).select(F.col("day").cast("string").alias("day"))


@query("alt_line_source", "SELECT s_suppkey AS line_id, s_name AS name, CASE WHEN s_nationkey % 3 = 0 THEN 345e0 WHEN s_nationkey % 3 = 1 THEN 230e0 END AS kv, 'utility' AS source FROM supplier WHERE s_nationkey % 3 < 2")
def _(t):
    lines = t["supplier"].select(F.col("s_suppkey").alias("line_id"), F.col("s_name").alias("owner"), F.when(F.col("s_nationkey") % 3 == 0, "345").otherwise("-999999").alias("voltage"),
                                 F.when(F.col("s_nationkey") % 3 == 1, "220-287").otherwise("NOT AVAILABLE").alias("volt_class"))
    return tb.line_source(lines, lines, "map", "utility")


@query("payload_rows", "SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS n, CAST(l_partkey AS BIGINT) AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(t):
    # the answers of a service: a list inside one text a request, here made from each order's lines
    made = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_partkey").cast("bigint").alias("p"))).alias("features"))).alias("body"))
    return tb.payload_rows(made.join(t["orders"].select("o_orderkey"), "o_orderkey"), "body", "features array<struct<n: bigint, p: bigint>>", "features")


@query("typed_rows", "SELECT CAST(s_suppkey AS VARCHAR) AS eia_id, s_acctbal AS mw, CAST(NULL AS DATE) AS seen FROM supplier")
def _(t):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("eia_id", T.StringType()), T.StructField("mw", T.DoubleType()), T.StructField("seen", T.DateType())])
    return pub.conform(t["supplier"].select(F.col("s_suppkey").alias("eia_id"), F.col("s_acctbal").alias("mw"), "s_name"), schema)


@query("tier_order_sort", "SELECT eia_id, row_number() OVER (ORDER BY CASE tier WHEN 'T1b' THEN 0 WHEN 'T1a' THEN 1 WHEN 'T2' THEN 2 WHEN 'T3' THEN 3 ELSE 99 END, eia_id) AS pos FROM score_rows")
def _(t):
    return serve.positions(t["score_rows"].select("eia_id", order_key(F.col("tier"), ["T1b", "T1a", "T2", "T3"]).alias("o")), [F.col("o").asc(), F.col("eia_id").asc()]).select("eia_id", "pos")


@query("confidence_order_sort", "SELECT eia_plant_id, row_number() OVER (ORDER BY CASE match_confidence WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 99 END, eia_plant_id) AS pos FROM old_matches")
def _(t):
    return serve.positions(t["old_matches"].select("eia_plant_id", order_key(F.col("match_confidence"), ["none", "low", "medium", "high"]).alias("o")), [F.col("o").asc(), F.col("eia_plant_id").asc()]).select("eia_plant_id", "pos")


@query("display_number", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN '—' ELSE format('{:,}', CAST(c_custkey AS BIGINT)) || '.0' END AS shown FROM customer")
def _(t):
    v = F.when(F.col("c_nationkey") != 3, F.col("c_custkey").cast("double"))
    return t["customer"].select("c_custkey", number_text(v).alias("shown"))


@query("unknown_decisions", "SELECT 'NO_' || s_suppkey AS key, 'accept' AS action FROM supplier")
def _(t):
    made_up = t["supplier"].select(F.lit("accept").alias("action"), F.concat(F.lit("NO_"), F.col("s_suppkey").cast("string")).alias("key"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("note"))
    return mt.unknown_decisions(t["old_matches"], t["decision_rows"].unionByName(made_up)).select("key", "action")


view("file_listing", """
SELECT concat('in/', CAST(p_size AS STRING), '/f', CAST(p_partkey AS STRING), CASE p_partkey % 3 WHEN 0 THEN '.zip' WHEN 1 THEN '.ZIP' ELSE '.csv' END) AS path, p_retailprice AS bytes FROM part
UNION ALL SELECT concat('in/', CAST(p_size AS STRING), '/f', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '.csv' ELSE '.CSV' END), p_retailprice + 1 FROM part WHERE p_partkey % 5 < 2
""")


@query("zip_duplicate_guard", """
SELECT path, bytes FROM file_listing z WHERE NOT (lower(path) LIKE '%.zip' AND EXISTS (SELECT 1 FROM file_listing c WHERE lower(c.path) LIKE '%.csv' AND c.path[:-5] = z.path[:-5]))
""")
def _(t):
    return tb.without_zipped_twins(t["file_listing"])
