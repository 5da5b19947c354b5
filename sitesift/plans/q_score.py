"""Scoring over supplier aggregates read as a wide scoring row, and offtake over orders."""

from pyspark.sql import functions as F

from ..config import config
from ..operators import scoring as sc
from ..operators.quantiles import group_quantiles, quantile_row
from .registry import query, view

CFG = config()
R = lambda c, d=6: F.round(F.col(c), d).alias(c)

view("score_rows", """
SELECT c_custkey AS eia_id, c_name AS plant_name, concat('County ', CAST(c_nationkey AS STRING)) AS county, CASE c_mktsegment WHEN 'BUILDING' THEN 'T1b' WHEN 'MACHINERY' THEN 'T1a' WHEN 'FURNITURE' THEN 'T2' WHEN 'HOUSEHOLD' THEN 'T3' END AS tier,
  CASE WHEN c_nationkey = 3 THEN 'review' WHEN c_nationkey = 4 THEN 'fail' ELSE 'pass' END AS filter_status, 26e0 + (c_custkey * 15485863 % 10000) / 1000e0 AS lat, -106e0 + (c_custkey * 104723 % 12000) / 1000e0 AS lon,
  CASE WHEN n < 6 THEN 'no_full_months' ELSE 'ok' END AS metrics_status, tot / 3000000e0 AS capture_rate_potential, CASE WHEN n % 5 = 0 THEN NULL ELSE mx / 2500000e0 END AS curtailment_pct, tot / 9000000e0 AS sced_net_cf,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal / 30000e0 END AS net_ac_cf, make_date(2014 + CAST(c_nationkey % 9 AS INT), 6, 1) AS cod_first, CASE WHEN c_nationkey < 3 THEN NULL WHEN c_nationkey < 15 THEN 'c-Si' ELSE 'thin_film_CdTe' END AS module_tech,
  CASE WHEN c_nationkey % 4 = 0 THEN 'fixed' WHEN c_nationkey % 4 = 1 THEN 'single_axis' WHEN c_nationkey % 4 = 2 THEN 'mixed' END AS tracking_type, CASE WHEN c_acctbal > 5000 THEN c_acctbal / 10000e0 END AS bifacial_share,
  CASE WHEN n > 3 THEN 'ok' ELSE 'no_parcel_data' END AS parcel_status, CASE WHEN c_mktsegment = 'BUILDING' THEN 'low' ELSE 'high' END AS parcels_confidence, n * 1.7e0 AS acres_per_mw_parcel, c_acctbal / 9000e0 AS headroom_pct_unified,
  n % 2 = 0 AS unified_land_control, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 4 = 1 THEN 345e0 WHEN n % 4 = 2 THEN 138e0 ELSE 69e0 END AS grid_voltage_kv, CASE WHEN c_nationkey <> 9 THEN 'osm' END AS transmission_source,
  CASE WHEN n % 3 = 0 THEN NULL ELSE n * 1.3e0 END AS dist_345kv_sub_mi, CASE WHEN c_nationkey <> 8 THEN 'manual' END AS load_pocket_source, CASE WHEN n % 3 = 1 THEN NULL ELSE n * 2.9e0 END AS dist_load_pocket_firm_mi,
  CASE WHEN n % 2 = 1 THEN NULL ELSE n * 1.1e0 END AS dist_load_pocket_announced_mi, CASE WHEN c_nationkey > 20 THEN NULL ELSE n / 10e0 END AS soil_lambda_w_mk, CASE WHEN n % 7 = 0 THEN NULL ELSE n / 20e0 END AS thick_hard_layer_share,
  n * 600e0 AS hours_below_25c_drybulb, CASE WHEN n % 6 = 0 THEN NULL ELSE n * 14e0 END AS depth_to_water_ft, CASE WHEN n % 8 = 0 THEN NULL ELSE n * 0.9e0 END AS fiber_lateral_miles, 2e0 + c_nationkey * 3e0 AS firm_it_mw
FROM customer JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS tot, max(o_totalprice) AS mx FROM orders GROUP BY o_custkey) a ON c_custkey = a.o_custkey
""")

_b = lambda v, pairs, other: "CASE WHEN {0} IS NULL THEN NULL {1} ELSE {2} END".format(v, " ".join(f"WHEN {v} {op} {b} THEN {p}e0" for op, b, p in pairs), f"{other}e0")
_NEAR = lambda c: f"coalesce({_b(c, [('<', 10, 5), ('<', 25, 3), ('<', 50, 1)], 0)}, 0e0)"
_VINT = "CASE WHEN year(cod_first) <= 2018 THEN 1e0 WHEN year(cod_first) <= 2020 THEN 0.5e0 ELSE 0e0 END"
_OKP = "parcel_status = 'ok' AND parcels_confidence <> 'low'"
_REGION = "CASE WHEN lon < -100e0 THEN 'west_texas' WHEN lat < 30e0 AND lon > -99.5e0 THEN 'coastal' ELSE 'central_texas' END"
_RAW = {
    "capture": "CASE WHEN cap IS NULL THEN NULL WHEN cap <= q.c25 THEN 12e0 WHEN cap <= q.c50 THEN 8e0 WHEN cap <= q.c75 THEN 4e0 ELSE 0e0 END",
    "curtailment": "CASE WHEN cur IS NULL THEN NULL WHEN cur >= q.u75 THEN 8e0 WHEN cur >= q.u50 THEN 5e0 ELSE 2e0 END",
    "cf_benchmark": _b("((m.med - cf) * 100)", [(">", 4, 6), (">", 2, 4)], 1), "offtake": "CAST(NULL AS DOUBLE)",
    "poly": f"CASE WHEN module_tech IS NULL THEN NULL WHEN module_tech = 'c-Si' THEN 6e0 * {_VINT} ELSE 0e0 END",
    "monofacial": f"CASE WHEN module_tech IS NULL THEN NULL WHEN bifacial_share IS NOT NULL THEN 5e0 * (1 - bifacial_share) WHEN module_tech LIKE 'thin%' THEN 5e0 ELSE 5e0 * {_VINT} END",
    "tracker": f"4e0 * CASE tracking_type WHEN 'fixed' THEN 1e0 WHEN 'single_axis' THEN {_VINT} WHEN 'mixed' THEN (1e0 + {_VINT}) / 2e0 END",
    "acres": f"CASE WHEN {_OKP} THEN {_b('acres_per_mw_parcel', [('>', 14, 8), ('>', 10, 6), ('>', 7, 3)], 0)} END",
    "headroom": f"CASE WHEN {_OKP} THEN {_b('headroom_pct_unified', [('>', '0.5e0', 7), ('>', '0.2e0', 4)], 0)} END",
    "land_control": f"CASE WHEN {_OKP} THEN CASE WHEN unified_land_control THEN 5e0 ELSE 0e0 END END",
    "poi_kv": _b("grid_voltage_kv", [(">=", 345, 10), (">=", 138, 6), (">=", 69, 2)], 0),
    "dist_345": f"CASE WHEN transmission_source IS NOT NULL THEN coalesce({_b('dist_345kv_sub_mi', [('<', 5, 5), ('<', 15, 2)], 0)}, 0e0) END",
    "load_pocket": f"CASE WHEN load_pocket_source IS NOT NULL THEN greatest({_NEAR('dist_load_pocket_firm_mi')}, {_NEAR('dist_load_pocket_announced_mi')} * 0.5e0) END",
    "hours25": _b("hours_below_25c_drybulb", [(">=", 6000, 3), (">=", 5000, 2), (">=", 4000, 1)], 0),
    "drill": _b("thick_hard_layer_share", [("<", "0.1e0", 4), ("<", "0.25e0", 3), ("<", "0.5e0", 2), ("<", "0.75e0", 1)], 0),
    "water": _b("depth_to_water_ft", [(">=", 200, 2), (">=", 100, 1)], 0)}
_MAX = sc.component_max(CFG)
_WIDE = f"""SELECT *, CASE WHEN metrics_status = 'ok' THEN capture_rate_potential END AS cap, CASE WHEN metrics_status = 'ok' THEN curtailment_pct END AS cur,
  coalesce(CASE WHEN metrics_status = 'ok' THEN sced_net_cf END, net_ac_cf) AS cf, {_REGION} AS region FROM score_rows WHERE filter_status <> 'fail'"""
_RAWS = f"""SELECT w.*, m.med, {', '.join(f'{e} AS r_{c}' for c, e in _RAW.items())}, (2400000e0 + coalesce(fiber_lateral_miles * 100000e0, 0)) / (firm_it_mw * 1000e0) AS per_kw FROM ({_WIDE}) w
  CROSS JOIN (SELECT quantile_cont(cap, 0.25) AS c25, quantile_cont(cap, 0.5) AS c50, quantile_cont(cap, 0.75) AS c75, quantile_cont(cur, 0.5) AS u50, quantile_cont(cur, 0.75) AS u75 FROM ({_WIDE}) w0) q
  LEFT JOIN (SELECT region, quantile_cont(cf, 0.5) AS med FROM ({_WIDE}) w1 GROUP BY region) m ON w.region = m.region"""
_P = lambda c: f"coalesce(r_{c}, {_MAX[c] * 0.5}e0)"
_SUMS = {k: " + ".join(_P(c) for c in comps if c in _MAX) for k, comps in sc.SECTIONS.items() if k != "f"}
_F = "CASE WHEN per_kw < 100 THEN 0e0 WHEN per_kw < 250 THEN -5e0 WHEN per_kw < 450 THEN -10e0 ELSE -15e0 END"
_SCORED = f"""SELECT *, score_a + score_b + score_c + score_d + score_e + score_f AS score_total FROM (SELECT *, {', '.join(f'{e} AS score_{k}' for k, e in _SUMS.items())}, {_F} AS score_f,
  round(({' + '.join(f'CASE WHEN r_{c} IS NOT NULL THEN {m}e0 ELSE 0 END' for c, m in _MAX.items())}) / 94e0, 3) AS data_completeness,
  nullif(concat_ws(';', {', '.join(f"CASE WHEN r_{c} IS NULL THEN '{c}' END" for c in _MAX)}), '') AS missing_inputs FROM ({_RAWS}) r) s"""
_RANK = f"""SELECT *, CASE WHEN filter_status = 'pass' THEN rank() OVER (PARTITION BY filter_status ORDER BY round(score_total, 9) DESC) END AS rank_overall,
  CASE WHEN filter_status = 'pass' AND tier IS NOT NULL THEN rank() OVER (PARTITION BY filter_status, tier ORDER BY round(score_total, 9) DESC) END AS rank_in_tier FROM ({_SCORED}) z"""


def scored(t):
    return sc.score(sc.assemble_wide(t["score_rows"]), CFG)


@query("score", f"""SELECT eia_id, region, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, score_c, score_d, score_e, score_f, round(score_total, 6) AS score_total, data_completeness, missing_inputs, rank_overall, rank_in_tier FROM ({_RANK}) k""")
def _(t):
    return scored(t).select("eia_id", "region", R("score_a"), R("score_b"), "score_c", "score_d", "score_e", "score_f", R("score_total"), "data_completeness", "missing_inputs", "rank_overall", "rank_in_tier")


for _name, _comps in {"quantile_points": ["capture", "curtailment"], "cf_vs_benchmark": ["cf_benchmark"], "repowering_points": ["poly", "monofacial", "tracker"], "parcel_points": ["acres", "headroom", "land_control"],
                      "electrical_points": ["poi_kv", "dist_345", "load_pocket"], "thermal_points": ["drill", "hours25", "water"]}.items():
    query(_name, f"SELECT eia_id, {', '.join(f'round({_P(c)}, 6) AS pts_{c}' for c in _comps)} FROM ({_RAWS}) r")(
        lambda t, cs=tuple(_comps): scored(t).select("eia_id", *[R(f"pts_{c}") for c in cs]))
for _name, _cols in {"section_totals": ["score_a", "score_b", "score_c", "score_d", "score_e", "score_total"], "rank_overall": ["rank_overall"], "rank_in_tier": ["rank_in_tier"], "completeness": ["data_completeness"], "neutral_put": ["missing_inputs"]}.items():
    query(_name, f"SELECT eia_id, {', '.join(f'round({c}, 6) AS {c}' if c.startswith('score') else c for c in _cols)} FROM ({_RANK}) k")(
        lambda t, cs=tuple(_cols): scored(t).select("eia_id", *[R(c) if c.startswith("score") else c for c in cs]))


@query("fixed_cost_drag", f"SELECT eia_id, round(per_kw, 6) AS fixed_cost_per_kw_it, {_F} AS pts_fixed_cost, fiber_lateral_miles IS NOT NULL AS fixed_cost_includes_fiber FROM ({_RAWS}) r")
def _(t):
    return scored(t).select("eia_id", R("fixed_cost_per_kw_it"), "pts_fixed_cost", "fixed_cost_includes_fiber")


@query("fixed_breakpoints", f"SELECT eia_id, {_b('cap', [('<', '0.55e0', 12), ('<', '0.65e0', 8), ('<', '0.75e0', 4)], 0)} AS pts FROM ({_WIDE}) w")
def _(t):
    cfg = config(scoring={"breakpoint_mode": "fixed"})
    df = sc.assemble_wide(t["score_rows"])
    return df.select("eia_id", sc.metric_points(df, "capture", cfg).alias("pts"))


@query("fleet_quantiles", f"SELECT round(quantile_cont(cap, 0.25), 6) AS q25, round(quantile_cont(cap, 0.5), 6) AS q50, round(quantile_cont(cap, 0.75), 6) AS q75, round(min(cap), 6) AS mn, round(max(cap), 6) AS mx FROM ({_WIDE}) w")
def _(t):
    df = sc.assemble_wide(t["score_rows"]).filter("metrics_status = 'ok'")
    q = quantile_row(df, "capture_rate_potential", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "mn": 0.0, "mx": 1.0}, 0.001)
    return q.select(R("q25"), R("q50"), R("q75"), R("mn"), R("mx"))


@query("regional_median", f"SELECT region, round(quantile_cont(cf, 0.5), 6) AS cf_benchmark FROM ({_WIDE}) w GROUP BY region")
def _(t):
    df = sc.cf_benchmark(sc.assemble_wide(t["score_rows"]), CFG)
    return df.groupBy("region").agg(F.round(F.max("cf_benchmark"), 6).alias("cf_benchmark"))


@query("median_cutpoint_bands", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.996), 6) AS q996 FROM events GROUP BY event_type")
def _(t):
    return group_quantiles(t["events"], ["event_type"], "value", {"q25": 0.25, "q50": 0.5, "q996": 0.996}, 1.0).select("event_type", R("q25"), R("q50"), R("q996"))


_W = "score_a / 30e0 * 10 + score_b / 15e0 * 40 + score_c / 20e0 * 20 + score_d / 20e0 * 100 + score_e / 9e0 * 9 + score_f / 15e0 * 15"


@query("reweight", f"SELECT eia_id, round({_W}, 6) AS score_custom FROM ({_SCORED}) s")
def _(t):
    return sc.reweight(scored(t), {"a": 10, "b": 40, "d": 140}, CFG).select("eia_id", R("score_custom"))


@query("weighted_rank", f"SELECT eia_id, CASE WHEN filter_status = 'pass' THEN rank() OVER (PARTITION BY filter_status ORDER BY round({_W}, 9) DESC) END AS rank_custom FROM ({_SCORED}) s")
def _(t):
    return sc.weighted_rank(scored(t), {"a": 10, "b": 40, "d": 140}, CFG).select("eia_id", "rank_custom")


@query("assemble_wide", "SELECT eia_id, filter_status, tier, lat FROM score_rows WHERE filter_status <> 'fail'")
def _(t):
    w = t["score_rows"]
    return sc.assemble_wide(w.select("eia_id", "filter_status"), w.select("eia_id", F.lit("x").alias("filter_status"), "tier"), w.select("eia_id", "lat"))


view("offtake_rows", """
SELECT o_orderkey AS eia_id, CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'ppa' WHEN 1 THEN 'hedge' WHEN 2 THEN 'affiliate' WHEN 3 THEN 'utility_owned' WHEN 4 THEN 'merchant' WHEN 5 THEN 'unknown' ELSE 'ppa' END AS offtake_type,
  CASE o_orderstatus WHEN 'F' THEN 'Undisclosed buyer' WHEN 'O' THEN 'City' END AS counterparty, CASE o_orderpriority WHEN '1-URGENT' THEN 'yes' WHEN '2-HIGH' THEN 'no' WHEN '3-MEDIUM' THEN 'unknown' END AS counterparty_ig,
  CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN CAST(year(o_orderdate) + 6 AS STRING) WHEN o_custkey % 4 = 2 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS contract_end,
  CAST(NULL AS STRING) AS contract_end_basis, CASE WHEN o_totalprice < 50000 THEN 0.35e0 END AS share_contracted, 'u' AS source_url, 'd' AS source_date, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN o_totalprice > 400000 THEN 'see notes' END AS flag, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS cod_first FROM orders
""")
_OT = """SELECT *, CASE WHEN asm THEN strftime(make_date(CAST(year(cod_first) + term AS INT), CAST(month(cod_first) AS INT), 1), '%Y-%m') ELSE contract_end END AS e, CASE WHEN asm THEN 'assumed' WHEN contract_end IS NOT NULL THEN 'published' END AS basis FROM (
  SELECT *, CASE offtake_type WHEN 'ppa' THEN 15 WHEN 'hedge' THEN 12 END AS term, offtake_type IN ('ppa', 'hedge') AS con, offtake_type IN ('ppa', 'hedge') AND contract_end IS NULL AND cod_first IS NOT NULL AS asm FROM offtake_rows) a"""
_OY = f"""SELECT *, round_even((CAST(CASE length(e) WHEN 4 THEN e || '-07-01' WHEN 7 THEN e || '-01' ELSE e END AS DATE) - DATE '2001-10-06') / 365.25e0, 2) AS y FROM ({_OT}) b"""
_OS = f"""SELECT *, CASE WHEN offtake_type IN ('utility_owned', 'affiliate', 'merchant') THEN offtake_type WHEN con AND y <= 0 THEN 'merchant' WHEN con AND y < 5 THEN 'short_contract' WHEN con AND y >= 5 THEN
  CASE counterparty_ig WHEN 'yes' THEN 'long_contract_ig' WHEN 'no' THEN 'long_contract_non_ig' ELSE 'long_contract_unknown_credit' END ELSE 'unknown' END AS status FROM ({_OY}) c"""


def offtake(t):
    rows = t["offtake_rows"]
    return sc.offtake_classify(rows.drop("cod_first"), CFG, "2001-10-06", rows.select("eia_id", "cod_first"))


@query("offtake_classify", f"""SELECT eia_id, status AS offtake_status, e AS offtake_contract_end, basis AS offtake_end_basis, y AS offtake_years_left, con AND coalesce(y <= 0, false) AS offtake_expired,
  CASE status WHEN 'merchant' THEN 4e0 WHEN 'short_contract' THEN 3e0 WHEN 'long_contract_ig' THEN 0e0 WHEN 'long_contract_non_ig' THEN 1e0 WHEN 'long_contract_unknown_credit' THEN 0.5e0 WHEN 'utility_owned' THEN 0e0 WHEN 'affiliate' THEN 3e0 END AS offtake_pts FROM ({_OS}) d""")
def _(t):
    return offtake(t).select("eia_id", "offtake_status", "offtake_contract_end", "offtake_end_basis", "offtake_years_left", "offtake_expired", "offtake_pts")


@query("offtake_flags", f"""SELECT eia_id, nullif(concat_ws('; ', CASE WHEN offtake_type = 'unknown' THEN 'no offtake found in public sources' END, CASE WHEN basis = 'assumed' THEN 'end not published: assumed COD + ' || term || ' yr' END,
  CASE WHEN offtake_type = 'affiliate' THEN 'affiliate offtake: priced in a sale, not a third-party contract' END, CASE WHEN con AND share_contracted < 0.5 THEN 'only 35% of output publicly contracted' END, CASE WHEN con AND counterparty LIKE 'Und%' THEN 'counterparty not named' END,
  CASE WHEN con AND y >= 5 AND y < 6 THEN 'crosses the 5-yr line within 1 yr' END, CASE WHEN con AND y <= 0 THEN 'contract ended: scored merchant, a replacement may exist' END, CASE WHEN confidence = 'low' AND offtake_type <> 'unknown' THEN 'low-confidence source' END, flag), '') AS offtake_flags FROM ({_OS}) d""")
def _(t):
    return offtake(t).select("eia_id", "offtake_flags")
