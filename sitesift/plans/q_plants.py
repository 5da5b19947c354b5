"""Plant master: roll-ups, joins, filters, tiers, survey attributes."""

from pyspark.sql import functions as F

from ..config import config
from ..operators import rollup, rules
from .registry import query, view

AS_OF = "2001-06-01"
CFG = config(hard_filters={"cod_from": "1995-02-01", "cod_to": "1998-01-01"})

view("pv_plants", """
SELECT eia_id,
  sum(CASE WHEN pv THEN nameplate_mw ELSE 0e0 END) AS ac_mw,
  CASE WHEN count(CASE WHEN pv THEN dc_mw END) = count(CASE WHEN pv THEN 1 END) THEN sum(CASE WHEN pv THEN dc_mw END) END AS dc_mw_eia,
  count(CASE WHEN pv THEN 1 END) AS n_generators,
  min(CASE WHEN pv THEN make_date(op_year, op_month, 1) END) AS cod_first,
  max(CASE WHEN pv THEN make_date(op_year, op_month, 1) END) AS cod_last,
  count(CASE WHEN energy_source = 'MWH' THEN 1 END) > 0 AS has_colocated_storage
FROM (SELECT *, energy_source = 'SUN' AND prime_mover = 'PV' AS pv FROM generators WHERE state = 'TX') g
GROUP BY eia_id HAVING count(CASE WHEN pv THEN 1 END) > 0
""")

_MODES = """
SELECT eia_id, max(CASE WHEN what = 'operator' THEN v END) AS operator, max(CASE WHEN what = 'county' THEN v END) AS county,
       max(CASE WHEN what = 'ba' THEN v END) AS ba_code
FROM (SELECT eia_id, what, v, row_number() OVER (PARTITION BY eia_id, what ORDER BY count(*) DESC, v) AS rn
      FROM (SELECT eia_id, 'operator' AS what, operator AS v FROM pvrows UNION ALL SELECT eia_id, 'county', county FROM pvrows
            UNION ALL SELECT eia_id, 'ba', ba_code FROM pvrows) u
      WHERE v IS NOT NULL GROUP BY eia_id, what, v) t WHERE rn = 1 GROUP BY eia_id
"""
_PVROWS = "SELECT * FROM generators WHERE state = 'TX' AND energy_source = 'SUN' AND prime_mover = 'PV'"
_FIRST = """
SELECT eia_id, plant_name, lat, lon, source_month FROM (
  SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY ordinal) AS rn FROM pvrows) f WHERE rn = 1
"""
_POLY = """
SELECT CAST(eia_id AS BIGINT) AS eia_id, sum(p_area) / 4046.8564224e0 AS array_acres, sum(area_calc_m2) / 4046.8564224e0 AS array_acres_calc,
       sum(p_cap_ac) AS ac_mw_uspvdb, sum(p_cap_dc) AS dc_mw_uspvdb, min(p_year) AS year_uspvdb, count(*) AS n_polygons
FROM array_polygons WHERE p_state = 'TX' AND eia_id IS NOT NULL GROUP BY eia_id
"""


def plants(t):
    return rollup.plant_rollup(t["generators"], CFG)


def polygons(t):
    return rollup.polygon_rollup(t["array_polygons"], CFG)


def master(t, parcels: bool = True):
    joined = rollup.plant_left_join(plants(t), polygons(t))
    joined = rollup.attribute_enrich(joined, t["parcel_layer_in"] if parcels else None)
    return rules.apply_filters(joined, CFG, AS_OF)


R = lambda c, d=6: F.round(F.col(c), d).alias(c)
TXT = lambda c: F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


@query("plant_rollup", f"""
WITH pvrows AS ({_PVROWS}), modes AS ({_MODES}), firsts AS ({_FIRST})
SELECT p.eia_id, f.plant_name, m.operator, m.county, m.ba_code, round(p.ac_mw, 6) AS ac_mw, round(p.dc_mw_eia, 6) AS dc_mw_eia,
       p.n_generators, CAST(p.cod_first AS STRING) AS cod_first, CAST(p.cod_last AS STRING) AS cod_last, round(f.lat, 6) AS lat,
       round(f.lon, 6) AS lon, f.source_month, p.has_colocated_storage, p.cod_first <> p.cod_last AS cod_multi_phase
FROM pv_plants p LEFT JOIN modes m ON p.eia_id = m.eia_id JOIN firsts f ON p.eia_id = f.eia_id
""")
def _(t):
    return plants(t).select("eia_id", "plant_name", "operator", "county", "ba_code", R("ac_mw"), R("dc_mw_eia"), "n_generators",
                            TXT("cod_first"), TXT("cod_last"), R("lat"), R("lon"), "source_month", "has_colocated_storage",
                            "cod_multi_phase")


@query("storage_semi_flag", "SELECT eia_id, has_colocated_storage FROM pv_plants")
def _(t):
    return plants(t).select("eia_id", "has_colocated_storage")


@query("polygon_rollup", f"""
WITH poly AS ({_POLY}), labels3 AS (
  SELECT eia_id, max(CASE WHEN what = 'axis' THEN v END) AS tracking_uspvdb, max(CASE WHEN what = 'tech' THEN v END) AS tech_uspvdb,
         max(CASE WHEN what = 'county' THEN v END) AS p_county
  FROM (SELECT eia_id, what, v, row_number() OVER (PARTITION BY eia_id, what ORDER BY count(*) DESC, v) AS rn
        FROM (SELECT CAST(eia_id AS BIGINT) AS eia_id, 'axis' AS what, p_axis AS v FROM array_polygons WHERE p_state = 'TX' AND eia_id IS NOT NULL
              UNION ALL SELECT CAST(eia_id AS BIGINT), 'tech', p_tech_pri FROM array_polygons WHERE p_state = 'TX' AND eia_id IS NOT NULL
              UNION ALL SELECT CAST(eia_id AS BIGINT), 'county', p_county FROM array_polygons WHERE p_state = 'TX' AND eia_id IS NOT NULL) u
        GROUP BY eia_id, what, v) r WHERE rn = 1 GROUP BY eia_id)
SELECT poly.eia_id, round(array_acres, 6) AS array_acres, round(array_acres_calc, 6) AS array_acres_calc,
       round(ac_mw_uspvdb, 6) AS ac_mw_uspvdb, round(dc_mw_uspvdb, 6) AS dc_mw_uspvdb, CAST(year_uspvdb AS BIGINT) AS year_uspvdb,
       tracking_uspvdb, tech_uspvdb, p_county, n_polygons
FROM poly JOIN labels3 ON poly.eia_id = labels3.eia_id
""")
def _(t):
    return polygons(t).select("eia_id", R("array_acres"), R("array_acres_calc"), R("ac_mw_uspvdb"), R("dc_mw_uspvdb"),
                              F.col("year_uspvdb").cast("bigint").alias("year_uspvdb"), "tracking_uspvdb", "tech_uspvdb", "p_county",
                              "n_polygons")


@query("rows_without_id", "SELECT count(*) AS rows_without_eia_id FROM array_polygons WHERE p_state = 'TX' AND eia_id IS NULL")
def _(t):
    return rollup.rows_without_id(t["array_polygons"], CFG)


@query("plant_left_join", f"""
WITH poly AS ({_POLY})
SELECT p.eia_id, round(p.ac_mw, 6) AS ac_mw, q.eia_id IS NOT NULL AS uspvdb_match, round(q.array_acres, 6) AS array_acres, q.n_polygons
FROM pv_plants p LEFT JOIN poly q ON p.eia_id = q.eia_id
""")
def _(t):
    return rollup.plant_left_join(plants(t), polygons(t)).select("eia_id", R("ac_mw"), "uspvdb_match", R("array_acres"), "n_polygons")


@query("orphan_anti_join", f"""
WITH poly AS ({_POLY})
SELECT q.eia_id, round(q.array_acres, 6) AS array_acres, q.n_polygons FROM poly q
WHERE NOT EXISTS (SELECT 1 FROM pv_plants p WHERE p.eia_id = q.eia_id)
""")
def _(t):
    return rollup.orphans(polygons(t), plants(t)).select("eia_id", R("array_acres"), "n_polygons")


@query("attribute_enrich", """
SELECT p.eia_id, round(p.ac_mw, 6) AS ac_mw, l.parcel_status, round(l.parcel_acres_host, 6) AS parcel_acres_host,
       round(l.acres_per_mw_parcel, 6) AS acres_per_mw_parcel, l.parcels_confidence
FROM pv_plants p LEFT JOIN parcel_layer_in l ON p.eia_id = l.eia_id
""")
def _(t):
    return rollup.attribute_enrich(plants(t), None, t["parcel_layer_in"]).select(
        "eia_id", R("ac_mw"), "parcel_status", R("parcel_acres_host"), R("acres_per_mw_parcel"), "parcels_confidence")


view("master_sql", f"""
SELECT b.*,
  array_acres / ac_mw AS acres_per_mw_ac,
  parcel_status IS NOT NULL AND parcel_status = 'ok' AND coalesce(parcels_confidence, '') <> 'low' AS on_parcel
FROM (SELECT p.eia_id, p.ac_mw, p.dc_mw_eia, p.cod_first, p.cod_last, q.array_acres, q.array_acres_calc, q.ac_mw_uspvdb, q.dc_mw_uspvdb,
        q.eia_id IS NOT NULL AS uspvdb_match, l.parcel_status, l.parcel_acres_host, l.acres_per_mw_parcel, l.parcels_confidence, m.ba_code, m.county
      FROM pv_plants p
      LEFT JOIN ({_POLY}) q ON p.eia_id = q.eia_id LEFT JOIN parcel_layer_in l ON p.eia_id = l.eia_id
      LEFT JOIN ({_MODES.replace('pvrows', '(' + _PVROWS + ') pv0')}) m ON p.eia_id = m.eia_id) b
""")

view("master_rules_sql", """
SELECT *, coalesce(dc_mw_eia, dc_mw_uspvdb) AS dc_mw,
  CASE WHEN dc_mw_eia IS NOT NULL THEN 'eia860m' WHEN dc_mw_uspvdb IS NOT NULL THEN 'uspvdb' ELSE 'ilr_default' END AS dc_mw_source,
  coalesce(coalesce(dc_mw_eia, dc_mw_uspvdb) / ac_mw, 1.3e0) AS ilr,
  concat_ws(';', CASE WHEN ac_mw < 10 THEN 'ac_mw<10' END, CASE WHEN cod_first IS NULL THEN 'cod_missing' END,
    CASE WHEN cod_first < DATE '1995-02-01' THEN 'cod<1995-02-01' END, CASE WHEN cod_first > DATE '1998-01-01' THEN 'cod>1998-01-01' END,
    CASE WHEN on_parcel AND parcel_acres_host < 60 THEN 'acres<60' END,
    CASE WHEN on_parcel AND acres_per_mw_parcel < 5 THEN 'acres_per_mw<5' END) AS hard,
  concat_ws(';', CASE WHEN NOT on_parcel AND array_acres < 60 THEN 'array_acres<60' END,
    CASE WHEN NOT on_parcel AND acres_per_mw_ac < 5 THEN 'array_acres_per_mw<5' END,
    CASE WHEN NOT on_parcel AND array_acres IS NULL THEN 'no_uspvdb_polygon' END) AS soft,
  CASE WHEN ac_mw >= 75 / (1.15e0 * 0.5e0 * 1.3e0) THEN 'T1b' WHEN ac_mw >= 75 THEN 'T1a' WHEN ac_mw >= 25 THEN 'T2' WHEN ac_mw >= 10 THEN 'T3' END AS tier
FROM master_sql
""")
_STATUS = "CASE WHEN hard <> '' THEN 'fail' WHEN soft <> '' THEN 'review' ELSE 'pass' END"
_REASONS = "CASE WHEN hard <> '' AND soft <> '' THEN concat(hard, ';', soft) ELSE concat(hard, soft) END"
_LOAD = "ac_mw * ilr * 0.5e0 * 1.15e0"


@query("hard_soft_filters", f"SELECT eia_id, {_STATUS} AS filter_status, {_REASONS} AS filter_reasons FROM master_rules_sql")
def _(t):
    return master(t).select("eia_id", "filter_status", "filter_reasons")


@query("footprint_basis", "SELECT eia_id, CASE WHEN on_parcel THEN 'parcel' ELSE 'array_flag' END AS footprint_basis FROM master_sql")
def _(t):
    return master(t).select("eia_id", "footprint_basis")


@query("provenance_coalesce", """
SELECT eia_id, round(dc_mw, 6) AS dc_mw, dc_mw_source, round(ilr, 6) AS ilr,
       CASE WHEN dc_mw_source = 'ilr_default' THEN 'assumed' ELSE 'reported' END AS ilr_confidence FROM master_rules_sql
""")
def _(t):
    return master(t).select("eia_id", R("dc_mw"), "dc_mw_source", R("ilr", 6), "ilr_confidence")


@query("derived_tier_line", "SELECT tier, count(*) AS plants, round(min(ac_mw), 6) AS min_mw, round(max(ac_mw), 6) AS max_mw FROM master_rules_sql GROUP BY tier")
def _(t):
    return master(t, False).groupBy("tier").agg(F.count(F.lit(1)).alias("plants"), F.round(F.min("ac_mw"), 6).alias("min_mw"),
                                                F.round(F.max("ac_mw"), 6).alias("max_mw"))


@query("assign_tier", "SELECT eia_id, tier FROM master_rules_sql")
def _(t):
    return master(t, False).select("eia_id", "tier")


@query("planned_load", f"""
SELECT eia_id, round(ac_mw * ilr * 0.5e0, 6) AS firm_it_mw, round({_LOAD}, 6) AS planned_load_mw, {_LOAD} >= 75 AS sb6_review_required
FROM master_rules_sql
""")
def _(t):
    return master(t, False).select("eia_id", R("firm_it_mw"), R("planned_load_mw"), "sb6_review_required")


@query("cod_flags", """
SELECT eia_id, year(cod_first) >= 2019 AS tax_equity_consent_likely, cod_last > DATE '1996-06-01' AS itc_recapture_open FROM pv_plants
""")
def _(t):
    return master(t, False).select("eia_id", "tax_equity_consent_likely", "itc_recapture_open")


@query("delta_pct", """
SELECT eia_id, round((ac_mw_uspvdb - ac_mw) / ac_mw, 5) AS ac_mw_delta_pct,
       round((array_acres_calc - array_acres) / array_acres, 6) AS acres_calc_delta_pct FROM master_sql
""")
def _(t):
    return master(t, False).select("eia_id", R("ac_mw_delta_pct", 5), R("acres_calc_delta_pct", 6))


@query("non_region_flag", "SELECT eia_id, coalesce(ba_code, '') <> 'ERCO' AS non_ercot_texas, coalesce(ba_code, '') = 'ERCO' AS ercot_flag FROM master_sql")
def _(t):
    return master(t, False).select("eia_id", "non_ercot_texas", "ercot_flag")


@query("parcel_decided_fails", """
SELECT eia_id, hard <> '' AND soft = '' AND hard IN ('acres<60', 'acres_per_mw<5', 'acres<60;acres_per_mw<5') AS only_parcel
FROM master_rules_sql
""")
def _(t):
    return master(t).select("eia_id", rules.parcel_decided_fails(F.col("filter_status"), F.col("filter_reasons")).alias("only_parcel"))


@query("status_counts", f"""
SELECT county, {_STATUS} AS filter_status, count(*) AS plants, round(sum(ac_mw), 3) AS mw FROM master_rules_sql GROUP BY 1, 2
""")
def _(t):
    return rollup.status_counts(master(t), ["county", "filter_status"]).select("county", "filter_status", "plants", R("mw", 3))


@query("mw_dominant", """
SELECT eia_id, label, round(mw / tot, 6) AS label_share FROM (
  SELECT eia_id, label, sum(mw) AS mw, sum(sum(mw)) OVER (PARTITION BY eia_id) AS tot,
         row_number() OVER (PARTITION BY eia_id ORDER BY sum(mw) DESC, label) AS rn FROM survey_solar GROUP BY eia_id, label) t WHERE rn = 1
""")
def _(t):
    return rollup.mw_dominant(t["survey_solar"], "label").select("eia_id", "label", R("label_share", 6))


@query("share_of_total", """
SELECT eia_id, label, round(sum(mw) / sum(sum(mw)) OVER (PARTITION BY eia_id), 6) AS mw_share FROM survey_solar GROUP BY eia_id, label
""")
def _(t):
    s = t["survey_solar"].groupBy("eia_id", "label").agg(F.sum("mw").alias("mw"))
    total = s.groupBy("eia_id").agg(F.sum("mw").alias("tot"))
    return s.join(total, "eia_id").select("eia_id", "label", F.round(F.col("mw") / F.col("tot"), 6).alias("mw_share"))


_FLAGS = "(CASE WHEN upper(trim({0})) IN ('Y', 'YES', 'TRUE', '1') THEN 1 ELSE 0 END)"
_TRK = [_FLAGS.format(c) for c in ("single_axis", "dual_axis", "east_west", "fixed_tilt")]
_TRACKING = (f"CASE WHEN {' + '.join(_TRK)} > 1 THEN 'mixed' WHEN {_TRK[0]} = 1 THEN 'single_axis' WHEN {_TRK[1]} = 1 THEN 'dual_axis' "
             f"WHEN {_TRK[2]} = 1 THEN 'fixed_east_west' WHEN {_TRK[3]} = 1 THEN 'fixed' END")
_MOD = [_FLAGS.format(c) for c in ("crystalline", "cdte")]
_MODULE = f"CASE WHEN {_MOD[0]} + {_MOD[1]} > 1 THEN 'mixed' WHEN {_MOD[0]} = 1 THEN 'c-Si' WHEN {_MOD[1]} = 1 THEN 'thin_film_CdTe' END"


@query("flag_category", f"SELECT eia_id, {_TRACKING} AS tracking_type, count(*) AS n FROM survey_solar GROUP BY 1, 2")
def _(t):
    s = t["survey_solar"]
    return (s.withColumn("tracking_type", rollup.flag_category(set(s.columns), rollup.TRACKING_FLAGS))
            .groupBy("eia_id", "tracking_type").agg(F.count(F.lit(1)).alias("n")))


@query("bifacial_share", """
SELECT eia_id, round(sum(CASE WHEN bifacial = 'Y' THEN mw ELSE 0 END) / nullif(sum(CASE WHEN bifacial IN ('Y', 'N') THEN mw ELSE 0 END), 0), 6)
  AS bifacial_share FROM survey_solar GROUP BY eia_id
""")
def _(t):
    return rollup.bifacial_share(t["survey_solar"]).select("eia_id", R("bifacial_share", 6))


def _dominant(cat):
    return f"""SELECT eia_id, cat, mw / tot AS share FROM (
      SELECT eia_id, cat, sum(mw) AS mw, sum(sum(mw)) OVER (PARTITION BY eia_id) AS tot,
             row_number() OVER (PARTITION BY eia_id ORDER BY sum(mw) DESC, cat) AS rn
      FROM (SELECT eia_id, mw, {cat} AS cat FROM survey_solar) c WHERE cat IS NOT NULL GROUP BY eia_id, cat) d WHERE rn = 1"""


@query("annual_attributes", f"""
SELECT p.eia_id, grid_voltage_kv, greatest(grid_voltage_kv, grid_voltage_2_kv, grid_voltage_3_kv) AS grid_voltage_max_kv,
       CASE WHEN grid_voltage_kv IS NOT NULL THEN 'eia860' END AS grid_voltage_source,
       coalesce(grid_voltage_kv <= 34.5e0, false) AS distribution_class_poi, t.cat AS tracking_type, round(t.share, 6) AS tracking_type_share,
       m.cat AS module_tech, round(m.share, 6) AS module_tech_share, round(b.bif, 6) AS bifacial_share
FROM survey_plants p LEFT JOIN ({_dominant(_TRACKING)}) t ON p.eia_id = t.eia_id LEFT JOIN ({_dominant(_MODULE)}) m ON p.eia_id = m.eia_id
LEFT JOIN (SELECT eia_id, sum(CASE WHEN bifacial = 'Y' THEN mw ELSE 0 END) / nullif(sum(CASE WHEN bifacial IN ('Y', 'N') THEN mw ELSE 0 END), 0) AS bif
           FROM survey_solar GROUP BY eia_id) b ON p.eia_id = b.eia_id
""")
def _(t):
    a = rollup.annual_attributes(t["survey_plants"], t["survey_solar"], CFG)
    return a.select("eia_id", "grid_voltage_kv", "grid_voltage_max_kv", "grid_voltage_source", "distribution_class_poi", "tracking_type",
                    R("tracking_type_share", 6), "module_tech", R("module_tech_share", 6), R("bifacial_share", 6))


_MONTHS = " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in rollup.MONTH_COLUMNS)
_GEN = f"""
SELECT eia_id, sum(net_generation_mwh) AS net_mwh, max({_MONTHS}) AS months_reported FROM survey_generation WHERE upper(trim(prime_mover)) = 'PV' GROUP BY eia_id
"""
_FREQ = """
SELECT eia_id, freq FROM (SELECT eia_id, upper(trim(frequency)) AS freq, row_number() OVER (PARTITION BY eia_id ORDER BY ordinal) AS rn
  FROM survey_generation WHERE upper(trim(prime_mover)) = 'PV' AND frequency IS NOT NULL AND trim(frequency) <> '') f WHERE rn = 1
"""


@query("capacity_factor", f"""
WITH g AS ({_GEN}), f AS ({_FREQ}), j AS (
  SELECT c.eia_id, g.net_mwh, CAST(g.months_reported AS BIGINT) AS months_reported, f.freq, g.net_mwh / (c.ac_mw * 8760) AS cf,
         coalesce(c.cod_last < DATE '1997-01-01', false) AS full_year
  FROM survey_capacity c LEFT JOIN g ON c.eia_id = g.eia_id LEFT JOIN f ON c.eia_id = f.eia_id)
SELECT eia_id, round(net_mwh, 4) AS net_mwh, months_reported,
  round(CASE WHEN net_mwh IS NOT NULL AND full_year AND NOT (coalesce(freq, '') = 'M' AND months_reported < 12) THEN cf END, 6) AS net_ac_cf,
  CAST(1997 AS BIGINT) AS cf_year, CASE freq WHEN 'M' THEN 'monthly' WHEN 'A' THEN 'annual' WHEN 'AM' THEN 'annual' END AS cf_series_resolution,
  CASE WHEN net_mwh IS NULL THEN 'no_eia923_record' WHEN NOT full_year THEN 'partial_year_cod'
       WHEN coalesce(freq, '') = 'M' AND months_reported < 12 THEN 'incomplete_months' WHEN cf < 0.05e0 OR cf > 0.4e0 THEN 'outside_plausible_range' END AS cf_note
FROM j
""")
def _(t):
    out = rollup.capacity_factor(t["survey_generation"], t["survey_capacity"], CFG, 1997)
    return out.select("eia_id", R("net_mwh", 4), F.col("months_reported").cast("bigint").alias("months_reported"), R("net_ac_cf", 6),
                      F.col("cf_year").cast("bigint").alias("cf_year"), "cf_series_resolution", "cf_note")


@query("row_count_nonnull", f"""
SELECT months, count(*) AS n FROM (SELECT CAST({_MONTHS} AS BIGINT) AS months FROM survey_generation) x GROUP BY months
""")
def _(t):
    return (t["survey_generation"].select(rollup.months_reported().cast("bigint").alias("months")).groupBy("months")
            .agg(F.count(F.lit(1)).alias("n")))


@query("unknown_codes", """
SELECT freq, count(*) AS n_rows FROM (SELECT upper(trim(frequency)) AS freq FROM survey_generation) x
WHERE freq IS NOT NULL AND freq <> '' AND freq NOT IN ('M', 'A', 'AM') GROUP BY freq
""")
def _(t):
    return rollup.unknown_codes(t["survey_generation"], CFG)


@query("latest_per_key", """
SELECT eia_id, freq, ordinal FROM (SELECT eia_id, frequency AS freq, ordinal, row_number() OVER (PARTITION BY eia_id ORDER BY ordinal DESC) AS rn
FROM survey_generation) x WHERE rn = 1
""")
def _(t):
    rows = t["survey_generation"].select("eia_id", F.col("frequency").alias("freq"), "ordinal", F.col("ordinal").alias("_o"))
    return rollup.latest_per_key(rows, ["eia_id"], [F.col("_o")]).drop("_o")


@query("dup_key_flag", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return rollup.dup_keys(t["lineitem"], ["l_orderkey", "l_linenumber"])


@query("top_k_labels", """
SELECT eia_id, label, round(mw, 6) AS weight, CAST(rn AS BIGINT) AS rank FROM (
  SELECT eia_id, label, sum(mw) AS mw, row_number() OVER (PARTITION BY eia_id ORDER BY sum(mw) DESC, label) AS rn FROM survey_solar GROUP BY eia_id, label) t
WHERE rn <= 3
""")
def _(t):
    top = rollup.top_k_labels(t["survey_solar"], "eia_id", "label", F.sum("mw"), 3)
    return top.select("eia_id", "label", R("weight"), F.col("rank").cast("bigint").alias("rank"))


@query("plant_screen", f"""
SELECT {_STATUS} AS filter_status, tier, {_REASONS} AS filter_reasons, count(*) AS plants, round(sum(ac_mw), 3) AS ac_mw
FROM master_rules_sql GROUP BY 1, 2, 3
""")
def _(t):
    return (master(t).groupBy("filter_status", "tier", "filter_reasons")
            .agg(F.count(F.lit(1)).alias("plants"), F.round(F.sum("ac_mw"), 3).alias("ac_mw")))
