"""Entity resolution between parts (as plants) and parts under another name (as market units)."""

from pyspark.sql import functions as F

from ..config import config
from ..functions import text
from ..operators import matching as mt
from .registry import query, view

CFG = config()
C = CFG["crosswalk"]
R = lambda c, d=4: F.round(F.col(c), d).alias(c)

view("match_plants", """
SELECT p_partkey AS eia_id, concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), CASE p_size % 4 WHEN 0 THEN ' Solar II' WHEN 1 THEN ' Energy Project, LLC' WHEN 2 THEN ' Farm 1' ELSE '' END) AS plant_name,
       concat(p_brand, '-', CAST(p_size AS STRING), ' County') AS county, p_retailprice / 7.3e0 + p_size AS ac_mw, make_date(1995 + CAST(p_partkey % 6 AS INT), 6, 1) AS cod_first,
       make_date(1995 + CAST(p_partkey % 6 AS INT) + CAST(p_size % 2 AS INT), 6, 1) AS cod_last, CASE WHEN p_type = 'PROMO' THEN 'fail' WHEN p_type = 'LARGE' THEN 'review' ELSE 'pass' END AS filter_status,
       CASE WHEN p_size > 30 THEN 'T1a' ELSE 'T3' END AS tier
FROM part
""")
view("market_rows", """
SELECT concat(' ', upper(substr(p_name, 1, 3)), CAST(p_partkey AS STRING), '_UNIT', CAST(p_size % 3 AS STRING)) AS unit_code,
       CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE concat(upper(p_name), ' SOLAR ', CASE p_size % 4 WHEN 0 THEN '2 U1' WHEN 1 THEN 'U2' WHEN 2 THEN '(PHASE I)' ELSE '' END) END AS unit_name,
       upper(concat(p_brand, '-', CAST(p_size AS STRING))) AS county, 'SOLAR' AS fuel, concat('in ', CAST(1995 + p_partkey % 6 AS STRING)) AS in_service_year,
       CASE WHEN p_partkey % 23 = 0 THEN 'n/a' ELSE CAST((p_retailprice / 7.3e0 + p_size) / (1e0 + p_partkey % 2) AS STRING) END AS installed_mw, p_partkey AS ordinal
FROM part
""")
view("unit_peaks", "SELECT trim(unit_code) AS resource_name, CAST(ordinal AS DOUBLE) AS max_hsl_mw FROM market_rows WHERE in_service_year <> 'in 1997'")
view("node_rows", """
SELECT concat('RN_', CAST(c_custkey AS STRING)) AS resource_node, CASE WHEN c_nationkey < 5 THEN NULL ELSE concat('SUB', CAST(c_nationkey AS STRING)) END AS unit_substation,
       CASE WHEN c_acctbal < -900 THEN NULL ELSE concat('Unit', CAST(c_custkey % 60 AS STRING)) END AS unit_name, c_custkey AS ordinal FROM customer
""")

_STOP = "['" + "', '".join(C["stopwords"]) + "']"
_WORDS = lambda c: f"list_filter(string_split(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
_TOK = lambda c: (f"list_transform(list_filter({_WORDS(c)}, lambda w: NOT list_contains({_STOP}, w)), lambda w: CASE w WHEN 'i' THEN '1' WHEN 'ii' THEN '2' WHEN 'iii' THEN '3' "
                  "WHEN 'iv' THEN '4' WHEN 'v' THEN '5' WHEN 'vi' THEN '6' ELSE w END)")


def plants(t):
    return t["match_plants"]


def units(t):
    return mt.cut_lineage(mt.market_units(t["market_rows"], C))


def named(t):
    return mt.cut_lineage(mt.plant_names(plants(t), C))


@query("norm_name", f"SELECT eia_id, array_to_string({_TOK('plant_name')}, ' ') AS name_n FROM match_plants")
def _(t):
    return plants(t).select("eia_id", text.norm_name(F.col("plant_name"), C).alias("name_n"))


@query("norm_county", "SELECT eia_id, lower(replace(county, ' County', '')) AS county_n FROM match_plants")
def _(t):
    return plants(t).select("eia_id", text.norm_county(F.col("county")).alias("county_n"))


@query("phase_digits", f"SELECT eia_id, array_to_string(list_filter({_TOK('plant_name')}, lambda w: regexp_full_match(w, '[0-9]+')), ',') AS digits FROM match_plants")
def _(t):
    return plants(t).select("eia_id", F.array_join(text.phase_digits(F.col("plant_name"), C), ",").alias("digits"))


_UNITS = f"""SELECT trim(unit_code) AS unit_code, unit_name, lower(trim(county)) AS county_n, TRY_CAST(installed_mw AS DOUBLE) AS mw, CAST(right(in_service_year, 4) AS BIGINT) AS year, ordinal,
  list_filter({_TOK('unit_name')}, lambda w: regexp_full_match(w, '[0-9]+')) AS digits FROM market_rows"""


@query("cdr_units", f"SELECT unit_code, unit_name, county_n, round(mw, 5) AS mw, year FROM ({_UNITS}) u")
def _(t):
    return units(t).select("unit_code", "unit_name", "county_n", R("mw", 5), F.col("year").cast("bigint").alias("year"))


@query("node_map", """
SELECT resource, node FROM (SELECT resource, resource_node AS node, row_number() OVER (PARTITION BY resource ORDER BY p, ordinal) AS rn FROM (
  SELECT upper(unit_substation || '_' || unit_name) AS resource, resource_node, 0 AS p, ordinal FROM node_rows WHERE unit_substation IS NOT NULL AND unit_name IS NOT NULL
  UNION ALL SELECT upper(unit_name), resource_node, 1, ordinal FROM node_rows WHERE unit_name IS NOT NULL) u) r WHERE rn = 1
""")
def _(t):
    return mt.node_map(t["node_rows"])


_PAIRS = f"""SELECT p.eia_id, p.ac_mw, u.*, year(p.cod_first) AS y1, year(p.cod_last) AS y2, list_filter({_TOK('plant_name')}, lambda w: regexp_full_match(w, '[0-9]+')) AS want
  FROM match_plants p JOIN ({_UNITS}) u ON lower(replace(p.county, ' County', '')) = u.county_n"""
_PHASE = "CASE WHEN len(want) > 0 THEN len(list_intersect(want, digits)) > 0 ELSE len(list_filter(digits, lambda d: d <> '1')) = 0 END"
_YEAR = "abs(year - y1) <= 1 OR abs(year - y2) <= 1"


@query("annotate_candidates", f"SELECT eia_id, unit_code, {_PHASE} AS phase_ok, {_YEAR} AS year_ok FROM ({_PAIRS}) p")
def _(t):
    return mt.annotate(mt.county_pairs(named(t), units(t)), C).select("eia_id", "unit_code", "phase_ok", "year_ok")


# one unit size per county, so that each enumeration is whole: masks over the county's units with known MW, at most ten of them by ordinal
_SUB = f"""
WITH RECURSIVE k AS (SELECT * FROM (SELECT eia_id, ac_mw, unit_code, mw, {_PHASE} AS phase_ok, {_YEAR} AS year_ok, row_number() OVER (PARTITION BY eia_id ORDER BY abs(mw - ac_mw), ordinal) AS rn FROM ({_PAIRS}) p WHERE mw IS NOT NULL) q WHERE rn <= 10),
sets AS (SELECT eia_id, ac_mw, rn, mw AS total, CASE WHEN phase_ok THEN 0e0 ELSE 0.05e0 END + CASE WHEN year_ok THEN 0e0 ELSE 0.1e0 END AS pen, 1 AS r, lpad(CAST(rn AS VARCHAR), 2, '0') AS codes FROM k
  UNION ALL SELECT s.eia_id, s.ac_mw, k.rn, s.total + k.mw, s.pen + CASE WHEN k.phase_ok THEN 0e0 ELSE 0.05e0 END + CASE WHEN k.year_ok THEN 0e0 ELSE 0.1e0 END, s.r + 1, s.codes || lpad(CAST(k.rn AS VARCHAR), 2, '0') FROM sets s JOIN k ON k.eia_id = s.eia_id AND k.rn > s.rn)
SELECT eia_id, CAST(r AS BIGINT) AS n_units, round(err, 6) AS err FROM (SELECT *, abs(total - ac_mw) / ac_mw AS err, row_number() OVER (PARTITION BY eia_id ORDER BY round(abs(total - ac_mw) / ac_mw + pen, 9), r, codes) AS best FROM sets) z WHERE best = 1
"""


@query("select_subset", _SUB)
def _(t):
    pairs = mt.annotate(mt.county_pairs(named(t), units(t).filter("mw is not null")), C)
    cands = pairs.withColumn("name_score", F.lit(80.0)).withColumn("tier", F.lit(1))
    return mt.choose(cands, C).select("eia_id", F.size("chosen").cast("bigint").alias("n_units"), R("err", 6))


@query("top_candidates", f"""
SELECT eia_id, unit_code, place FROM (SELECT eia_id, unit_code, row_number() OVER (PARTITION BY eia_id ORDER BY ordinal % 40 DESC, coalesce(abs(mw - ac_mw), 1e300), ordinal) AS place FROM ({_PAIRS}) p) q WHERE place <= 10
""")
def _(t):
    pairs = mt.annotate(mt.county_pairs(named(t), units(t)), C)
    cands = pairs.withColumn("name_score", (F.col("ord") % 40).cast("double")).withColumn("tier", F.lit(1))
    return mt.top_candidates(cands, C).select("eia_id", "unit_code", F.col("place").cast("bigint").alias("place"))


@query("match_confidence", f"""
SELECT eia_id, unit_code, CASE WHEN ordinal % 100 >= 85 AND e <= 0.1e0 THEN 'high' WHEN (ordinal % 100 >= 70 AND e <= 0.25e0) OR (({_YEAR}) AND e <= 0.1e0) THEN 'medium' ELSE 'low' END AS conf
FROM (SELECT *, coalesce(abs(mw - ac_mw) / ac_mw, 9e0) AS e FROM ({_PAIRS}) p) q
""")
def _(t):
    p = mt.annotate(mt.county_pairs(named(t), units(t)), C)
    conf = mt.match_confidence((F.col("ord") % 100).cast("double"), F.abs(F.col("mw") - F.col("ac_mw")) / F.col("ac_mw"), F.lit(True), F.col("year_ok"), C)
    return p.select("eia_id", "unit_code", conf.alias("conf"))


# oracle side: the longest common subsequence by the bit recurrence over one text's letters (fewer than 62 here)
_LCS = """length(p) - bit_count(list_reduce(list_prepend((1::BIGINT << length(p)) - 1, list_transform(string_split(q, ''), lambda ch: CAST(list_sum(list_transform(range(0, length(p)), lambda i: CASE WHEN p[i + 1] = ch THEN 1::BIGINT << CAST(i AS INT) ELSE 0::BIGINT END)) AS BIGINT))),
  lambda r, w: ((r + (r & w)) | (r - (r & w))) & ((1::BIGINT << length(p)) - 1)))"""


def _scored(pairs: str) -> str:
    """(a, b, score) of distinct name pairs (a, b)."""
    words = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> ''))"
    joined = lambda v: f"array_to_string(list_sort({v}), ' ')"
    return f"""SELECT a, b, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0e0 WHEN len(c) > 0 AND (len(c) = len(x) OR len(c) = len(y)) THEN 100e0 ELSE 100e0 * greatest(CASE WHEN len(c) > 0 THEN greatest(1 - (1e0 + length(p)) / (length(s) + lp), 1 - (1e0 + length(q)) / (length(s) + lq)) ELSE 0e0 END,
        1 - (length(p) + length(q) - 2e0 * CASE WHEN p = '' OR q = '' THEN 0 ELSE {_LCS} END) / (lp + lq)) END AS score
      FROM (SELECT *, length(s) + CASE WHEN s <> '' THEN 1 ELSE 0 END + length(p) AS lp, length(s) + CASE WHEN s <> '' THEN 1 ELSE 0 END + length(q) AS lq FROM (
        SELECT *, {joined('c')} AS s, {joined('list_filter(x, lambda w: NOT list_contains(c, w))')} AS p, {joined('list_filter(y, lambda w: NOT list_contains(c, w))')} AS q FROM (
          SELECT *, list_filter(x, lambda w: list_contains(y, w)) AS c FROM (SELECT a, b, {words('a')} AS x, {words('b')} AS y FROM ({pairs}) n0) n1) n2) n3) n4"""


_NAMES = f"""SELECT p.eia_id, p.ac_mw, year(p.cod_first) AS y1, year(p.cod_last) AS y2, array_to_string({_TOK('plant_name')}, ' ') AS plant_n, lower(replace(p.county, ' County', '')) AS county_n FROM match_plants p"""
_CODES = f"""SELECT trim(unit_code) AS unit_code, lower(trim(county)) AS county_n, TRY_CAST(installed_mw AS DOUBLE) AS mw, CAST(right(in_service_year, 4) AS BIGINT) AS year, array_to_string({_TOK('unit_name')}, ' ') AS name_n, array_to_string({_TOK('unit_code')}, ' ') AS code_n FROM market_rows"""
_HOME = f"SELECT p.eia_id, p.ac_mw, p.y1, p.y2, p.plant_n, u.* FROM ({_NAMES}) p JOIN ({_CODES}) u ON p.county_n = u.county_n"
_HOME_SCORES = f"""
WITH home AS ({_HOME}), sc AS ({_scored("SELECT DISTINCT plant_n AS a, o AS b FROM (SELECT plant_n, name_n AS o FROM home UNION ALL SELECT plant_n, code_n FROM home) n")})
SELECT h.eia_id, h.unit_code, h.ac_mw, h.mw, h.year, h.y1, h.y2, greatest(s1.score, s2.score) AS score FROM home h JOIN sc s1 ON h.plant_n = s1.a AND h.name_n = s1.b JOIN sc s2 ON h.plant_n = s2.a AND h.code_n = s2.b
"""


@query("token_set_ratio", f"SELECT eia_id, unit_code, round(score, 3) AS name_score FROM ({_HOME_SCORES}) h")
def _(t):
    pairs = mt.scored_pairs(named(t).select("eia_id", "county_n", "plant_n"), units(t).select("county_n", "unit_code", "name_n", "code_n"))
    return pairs.select("eia_id", "unit_code", R("name_score", 3))


@query("score_candidates", f"SELECT eia_id, unit_code, round(score, 3) AS name_score FROM ({_HOME_SCORES}) h WHERE score >= 55")
def _(t):
    return mt.named_in_county(named(t), units(t), C["name_min"]).select("eia_id", "unit_code", R("name_score", 3))


def _both(p, u):
    return mt.home_candidates(p, u, C).unionByName(mt.far_candidates(p, u, C))


_FAR_SCORES = f"""
WITH p AS ({_NAMES}), u AS ({_CODES}), o AS (SELECT DISTINCT name FROM (SELECT name_n AS name FROM u UNION ALL SELECT code_n FROM u) n WHERE name <> ''),
sc AS (SELECT a, b, score FROM ({_scored("SELECT a, b FROM (SELECT DISTINCT plant_n AS a FROM p WHERE plant_n <> '') x, (SELECT name AS b FROM o) y")}) z WHERE score >= 85)
SELECT DISTINCT p.eia_id, u.unit_code FROM p JOIN sc ON sc.a = p.plant_n JOIN u ON (u.name_n = sc.b OR u.code_n = sc.b) WHERE p.county_n <> u.county_n
"""


@query("candidate_fallbacks", f"""
SELECT eia_id, min(tier) AS tier, count(*) AS n FROM (
  SELECT eia_id, CASE WHEN score >= 70 THEN 1 ELSE 2 END AS tier FROM ({_HOME_SCORES}) h WHERE score >= 55 OR coalesce(abs(mw - ac_mw) / ac_mw <= 0.1e0 AND (abs(year - y1) <= 1 OR abs(year - y2) <= 1), false)
  UNION ALL SELECT eia_id, 3 FROM ({_FAR_SCORES}) f) c GROUP BY 1
""")
def _(t):
    return _both(named(t), units(t)).groupBy("eia_id").agg(F.min("tier").alias("tier"), F.count(F.lit(1)).alias("n"))


@query("greedy_assignment")
def _(t):
    todo = mt.cut_lineage(mt.plant_names(plants(t).filter("filter_status <> 'fail'"), C))
    cands = mt.cut_lineage(mt.home_candidates(todo, units(t), C))
    return mt.assign(cands, todo, units(t), C).select("eia_id", "tier", F.array_join(F.array_sort("chosen.unit_code"), "+").alias("units"), R("err", 6))


def xwalk(t, existing=None):
    return mt.crosswalk(plants(t), t["market_rows"], CFG, t["unit_peaks"], mt.node_map(t["node_rows"]), existing)


@query("crosswalk_rows")
def _(t):
    return xwalk(t)


view("old_matches", """
SELECT CAST(eia_id AS STRING) AS eia_plant_id, plant_name AS eia_plant_name, concat('OLD_', CAST(eia_id AS STRING)) AS ercot_resource_name, county, 'high' AS match_confidence, CASE WHEN tier = 'T1a' THEN 'CR' ELSE ' ' END AS verified_by,
       '2026-10-01' AS verified_on, 'manual' AS match_method, tier FROM match_plants
""")


@query("verified_lock", "SELECT CAST(eia_plant_id AS BIGINT) AS eia_plant_id, ercot_resource_name, verified_by, match_method FROM old_matches WHERE trim(verified_by) <> ''")
def _(t):
    out = xwalk(t, t["old_matches"])
    return out.filter("verified_by is not null").select("eia_plant_id", "ercot_resource_name", "verified_by", "match_method")


view("decision_rows", """
SELECT 'accept' AS action, CAST(p_partkey AS STRING) AS key, CAST(NULL AS STRING) AS value, CAST(NULL AS STRING) AS note FROM part WHERE p_type = 'SMALL'
UNION ALL SELECT 'set', CAST(p_partkey AS STRING), concat('A_', CAST(p_partkey AS STRING), ' + B_', CAST(p_partkey AS STRING)), NULL FROM part WHERE p_type = 'MEDIUM'
UNION ALL SELECT 'no_resource', CAST(p_partkey AS STRING), NULL, 'behind the meter' FROM part WHERE p_type = 'STANDARD'
UNION ALL SELECT 'set_node', concat('OLD_', CAST(p_partkey AS STRING)), 'NODE_X', NULL FROM part WHERE p_type = 'ECONOMY'
UNION ALL SELECT 'undo', CAST(p_partkey AS STRING), NULL, NULL FROM part WHERE p_type = 'SMALL' AND p_size < 20
""")


@query("apply_decisions", """
SELECT o.eia_plant_id, CASE p_type WHEN 'MEDIUM' THEN s.code WHEN 'STANDARD' THEN NULL ELSE o.ercot_resource_name END AS ercot_resource_name, CASE WHEN p_type = 'ECONOMY' THEN 'NODE_X' END AS ercot_settlement_point,
  CASE WHEN p_type = 'SMALL' AND p_size < 20 THEN NULL WHEN p_type IN ('SMALL', 'MEDIUM', 'STANDARD') THEN 'ZZ' ELSE o.verified_by END AS verified_by,
  CASE p_type WHEN 'STANDARD' THEN 'none' ELSE 'high' END AS match_confidence, CASE p_type WHEN 'STANDARD' THEN 'behind the meter' WHEN 'MEDIUM' THEN 'manual match' END AS notes
FROM old_matches o JOIN part p ON o.eia_plant_id = CAST(p.p_partkey AS STRING) LEFT JOIN (SELECT p_partkey AS k, 'A_' || p_partkey AS code FROM part UNION ALL SELECT p_partkey, 'B_' || p_partkey FROM part) s ON p_type = 'MEDIUM' AND s.k = p_partkey
""")
def _(t):
    x = t["old_matches"].drop("tier").withColumn("ercot_settlement_point", F.lit(None).cast("string")).withColumn("notes", F.lit(None).cast("string"))
    out = mt.apply_decisions(x, t["decision_rows"], "ZZ", "2026-10-07")
    return out.select("eia_plant_id", "ercot_resource_name", "ercot_settlement_point", "verified_by", "match_confidence", "notes")


@query("crosswalk_status", """
SELECT count(*) AS plants, count(CASE WHEN trim(verified_by) <> '' THEN 1 END) AS verified, count(CASE WHEN trim(verified_by) = '' THEN 1 END) AS to_review,
  count(CASE WHEN m.tier = 'T1a' AND filter_status = 'pass' THEN 1 END) AS top_tier, count(CASE WHEN m.tier = 'T1a' AND filter_status = 'pass' AND trim(verified_by) <> '' THEN 1 END) AS top_tier_verified
FROM old_matches o JOIN match_plants m ON o.eia_plant_id = CAST(m.eia_id AS STRING)
""")
def _(t):
    return mt.crosswalk_status(t["old_matches"], plants(t))


def review(t):
    return mt.candidate_review(plants(t), t["market_rows"], t["old_matches"], CFG, t["unit_peaks"], mt.node_map(t["node_rows"]))


_REVIEW = f"""
WITH p AS (SELECT n.*, m.plant_name FROM ({_NAMES}) n JOIN match_plants m ON m.eia_id = n.eia_id), u AS ({_CODES}),
sc AS ({_scored("SELECT a, b FROM (SELECT DISTINCT plant_n AS a FROM p) x, (SELECT DISTINCT name AS b FROM (SELECT name_n AS name FROM u UNION ALL SELECT code_n FROM u) n) y")})
SELECT p.eia_id, p.plant_name, p.ac_mw, u.unit_code, u.mw, u.year, greatest(s1.score, s2.score) AS name_score, p.county_n = u.county_n AS county_match, o.eia_plant_name AS held_by, k.max_hsl_mw AS sced_peak_mw
FROM p CROSS JOIN u JOIN sc s1 ON s1.a = p.plant_n AND s1.b = u.name_n JOIN sc s2 ON s2.a = p.plant_n AND s2.b = u.code_n LEFT JOIN old_matches o ON o.ercot_resource_name = u.unit_code LEFT JOIN unit_peaks k ON k.resource_name = u.unit_code
WHERE p.county_n = u.county_n OR greatest(s1.score, s2.score) >= 50
"""


@query("candidate_review", f"SELECT eia_id, plant_name, unit_code, mw, CAST(year AS BIGINT) AS year, round(name_score, 3) AS name_score, county_match, held_by, sced_peak_mw FROM ({_REVIEW}) r")
def _(t):
    return review(t).select("eia_id", "plant_name", "unit_code", "mw", F.col("year").cast("bigint").alias("year"), R("name_score", 3), "county_match", "held_by", "sced_peak_mw")


_HELD = f"SELECT p.eia_id, p.ac_mw, p.plant_name, u.unit_code, u.mw, o.eia_plant_name AS held_by FROM (SELECT n.*, m.plant_name FROM ({_NAMES}) n JOIN match_plants m ON m.eia_id = n.eia_id) p JOIN ({_CODES}) u ON p.county_n = u.county_n LEFT JOIN old_matches o ON o.ercot_resource_name = u.unit_code"


def held(t):
    mine = mt.held_by(units(t).select("county_n", "unit_code", "mw"), t["old_matches"])  # a unit's holder is looked up once, not for each pair
    return mt.county_pairs(named(t).select("eia_id", "ac_mw", "plant_name", "county_n"), mine)


@query("held_by_lookup", f"SELECT eia_id, unit_code, held_by FROM ({_HELD}) r")
def _(t):
    return held(t).select("eia_id", "unit_code", "held_by")


def _sets(df):
    return df.select("eia_id", F.col("place").cast("bigint").alias("place"), F.col("n_units").cast("bigint").alias("n_units"), R("total_mw"), "codes")


# Sets of one and two units first. The error of the sixth best of them bounds the larger sets, whose last unit or last pair is then
# looked up in hundredths of a MW; `least` (a plant's smallest unit) leaves out what is too large for the units still missing.
_WIDTH = "(b.bound + 2e-9) * {0}.ac_mw + 1e-6"
_SLOTS = lambda x: f"unnest(range(CAST(floor(100 * (ac_mw - {x} - width)) AS BIGINT), CAST(floor(100 * (ac_mw - {x} + width)) AS BIGINT) + 1)) AS slot"
_FREE_SETS = f"""
WITH q AS (SELECT DISTINCT eia_id, ac_mw, unit_code, mw FROM ({_REVIEW}) v WHERE (held_by IS NULL OR held_by = plant_name) AND mw > 0),
r AS MATERIALIZED (SELECT *, min(mw) OVER (PARTITION BY eia_id) AS least, CAST(floor(100 * mw) AS BIGINT) AS slot FROM q WHERE mw <= ac_mw * 1.15e0 + 1e-9),
two AS NOT MATERIALIZED (SELECT x.eia_id, x.ac_mw, x.least, x.unit_code AS c1, y.unit_code AS c2, x.mw + y.mw AS total, y.mw AS m2, x.mw AS m1 FROM r x JOIN r y ON x.eia_id = y.eia_id AND x.unit_code < y.unit_code WHERE x.mw + y.mw <= x.ac_mw * 1.15e0 + 1e-9),
low AS (SELECT eia_id, min(e, 6) AS six FROM (SELECT eia_id, abs(mw - ac_mw) / ac_mw AS e FROM r UNION ALL SELECT eia_id, abs(total - ac_mw) / ac_mw FROM two) n GROUP BY eia_id),
b AS MATERIALIZED (SELECT eia_id, CASE WHEN len(six) = 6 THEN least(six[6], 0.15e0) ELSE 0.15e0 END AS bound FROM low),
pairs AS NOT MATERIALIZED (SELECT x.*, {_WIDTH.format('x')} AS width FROM two x JOIN b ON b.eia_id = x.eia_id),
triples AS (SELECT x.eia_id, x.ac_mw, x.least, x.width, x.c1 || '+' || x.c2 || '+' || r.unit_code AS codes, r.unit_code AS last, x.total + r.mw AS total FROM pairs x JOIN r ON r.eia_id = x.eia_id AND r.unit_code > x.c2
  WHERE x.total + 3 * x.least <= x.ac_mw + x.width AND x.total + r.mw + 2 * x.least <= x.ac_mw + x.width),
ends AS NOT MATERIALIZED (SELECT eia_id, c1, c2, m1, m2, CAST(floor(100 * total) AS BIGINT) AS slot FROM pairs WHERE total + 2 * least <= ac_mw + width),
sets AS (SELECT r.eia_id, ac_mw, mw AS total, 1 AS n, unit_code AS codes FROM r
  UNION ALL SELECT eia_id, ac_mw, total, 2, c1 || '+' || c2 FROM pairs WHERE abs(total - ac_mw) <= width
  UNION ALL SELECT x.eia_id, x.ac_mw, x.total + r.mw, 3, x.c1 || '+' || x.c2 || '+' || r.unit_code FROM (SELECT *, {_SLOTS('total')} FROM pairs WHERE total + least <= ac_mw + width) x JOIN r ON r.eia_id = x.eia_id AND r.slot = x.slot AND r.unit_code > x.c2
  UNION ALL SELECT x.eia_id, x.ac_mw, x.total + y.m1 + y.m2, 4, x.c1 || '+' || x.c2 || '+' || y.c1 || '+' || y.c2 FROM (SELECT *, {_SLOTS('total')} FROM pairs WHERE total + 2 * least <= ac_mw + width) x JOIN ends y ON y.eia_id = x.eia_id AND y.slot = x.slot AND y.c1 > x.c2
  UNION ALL SELECT x.eia_id, x.ac_mw, x.total + y.m1 + y.m2, 5, x.codes || '+' || y.c1 || '+' || y.c2 FROM (SELECT *, {_SLOTS('total')} FROM triples) x JOIN ends y ON y.eia_id = x.eia_id AND y.slot = x.slot AND y.c1 > x.last)
SELECT eia_id, CAST(place AS BIGINT) AS place, CAST(n AS BIGINT) AS n_units, round(total, 4) AS total_mw, codes FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY round(abs(total - ac_mw) / ac_mw, 9), n, codes) AS place FROM sets
  WHERE abs(total - ac_mw) / ac_mw <= 0.15e0 AND total <= ac_mw * 1.15e0 + 1e-9) z WHERE place <= 6
"""


@query("free_unit_sets", _FREE_SETS)
def _(t):
    return _sets(mt.free_unit_sets(review(t), C))


@query("held_by_lookup_all", f"SELECT eia_id, unit_code, held_by FROM ({_HELD}) r")
def _(t):
    return held(t).select("eia_id", "unit_code", "held_by")


# as free_unit_sets; tests/test_matching.py has the plain version
@query("free_unit_sets_all")
def _(t):
    return _sets(mt.free_unit_sets(review(t), C))


view("twin_plants", """
SELECT s_suppkey * 2 + k AS eia_id, concat('Ridge', CAST(s_suppkey AS STRING), CASE k WHEN 0 THEN ' East' ELSE ' West' END) AS plant_name, concat('C', CAST(s_suppkey AS STRING), ' County') AS county,
       CASE k WHEN 0 THEN 90e0 ELSE 20e0 END AS ac_mw, make_date(2018, 5, 1) AS cod_first, make_date(2018, 5, 1) AS cod_last, 'pass' AS filter_status
FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) t
""")
view("twin_units", """
SELECT concat('RIDGE', CAST(s_suppkey AS STRING), '_1') AS unit_code, concat('RIDGE', CAST(s_suppkey AS STRING)) AS unit_name, concat('C', CAST(s_suppkey AS STRING)) AS county, 'SOLAR' AS fuel, '2018' AS in_service_year,
       CAST(CASE WHEN s_nationkey < 12 THEN 110e0 ELSE 200e0 END AS STRING) AS installed_mw, s_suppkey AS ordinal FROM supplier
""")


@query("shared_unit_rule", """
SELECT t.eia_id, CASE WHEN s_nationkey < 12 OR t.eia_id % 2 = 0 THEN 'RIDGE' || s_suppkey || '_1' END AS unit_code, CASE WHEN t.eia_id % 2 = 0 THEN 'auto:name+county' WHEN s_nationkey < 12 THEN 'auto:shared unit' ELSE 'no candidate' END AS match_method,
  CASE WHEN s_nationkey < 12 THEN 'medium' WHEN t.eia_id % 2 = 0 THEN 'low' ELSE 'none' END AS match_confidence, s_nationkey < 12 AS shared FROM twin_plants t JOIN supplier ON t.eia_id // 2 = s_suppkey
""")
def _(t):
    x = mt.crosswalk(t["twin_plants"], t["twin_units"], CFG)
    return x.select(F.col("eia_plant_id").alias("eia_id"), F.col("ercot_resource_name").alias("unit_code"), "match_method", "match_confidence", F.coalesce(F.col("notes").startswith("one ERCOT unit shared"), F.lit(False)).alias("shared"))
