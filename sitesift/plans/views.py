"""Derived inputs: the driver tables read as generators, polygons, telemetry, prices, features and hand tables."""

from .registry import view

# ---- generator inventory: plant = part, generator = line item ---------------------------------------------------------
view("generators", """
SELECT l.l_partkey AS eia_id, concat('Plant ', p.p_name) AS plant_name,
       CAST(o_mode.c_name AS STRING) AS operator,
       CASE WHEN n.n_nationkey = 24 THEN 'NM' ELSE 'TX' END AS state, n.n_name AS county,
       CASE WHEN n.n_regionkey < 3 THEN 'ERCO' WHEN n.n_regionkey = 3 THEN 'EPE' ELSE NULL END AS ba_code,
       l.l_quantity * p.p_size / 100e0 AS nameplate_mw,
       CASE WHEN l.l_partkey % 3 = 0 AND l.l_tax <= 0e0 THEN NULL ELSE l.l_quantity * p.p_size * 13e0 / 1000e0 END AS dc_mw,
       month(l.l_shipdate) AS op_month, year(l.l_shipdate) AS op_year,
       CASE WHEN l.l_returnflag = 'R' THEN 'MWH' WHEN l.l_linestatus = 'O' THEN 'SUN' ELSE 'WND' END AS energy_source,
       CASE WHEN l.l_returnflag = 'R' THEN 'BA' WHEN l.l_linestatus = 'O' THEN 'PV' ELSE 'WT' END AS prime_mover,
       26e0 + (l.l_suppkey * 104729 % 10000) / 1000e0 AS lat, -106e0 + (l.l_suppkey * 7919 % 12000) / 1000e0 AS lon,
       '2026-08' AS source_month, l.l_returnflag, l.l_linestatus, l.l_orderkey, l.l_linenumber, l.l_suppkey,
       ((l.l_orderkey * 10 + l.l_linenumber) * 1000000 + l.l_suppkey) * 100 + CAST(l.l_quantity AS BIGINT) AS ordinal
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN (SELECT o_orderkey, c_mktsegment AS c_name FROM orders JOIN customer ON o_custkey = c_custkey) o_mode
  ON l.l_orderkey = o_mode.o_orderkey
""")

view("array_polygons", """
SELECT CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN CAST(p_partkey + 10000000 AS STRING)
            ELSE CAST(p_partkey AS STRING) END AS eia_id,
       CASE WHEN p_partkey % 11 = 0 THEN 'NM' ELSE 'TX' END AS p_state, concat(p_brand, ' County') AS p_county,
       p_retailprice * (2 + p_partkey % 9) / 10e0 * 4046.8564224e0 AS p_area,
       p_retailprice * (2 + p_partkey % 9) / 10e0 * 4046.8564224e0 * (1e0 + (p_partkey % 7) / 1000e0) AS area_calc_m2,
       p_size * 2e0 AS p_cap_ac, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size * 26e0 / 10e0 END AS p_cap_dc,
       1995 + p_partkey % 7 AS p_year, p_type AS p_axis,
       CASE WHEN p_partkey % 4 = 0 THEN 'thin-film' ELSE 'crystalline' END AS p_tech_pri, p_partkey AS case_id
FROM part
UNION ALL
SELECT CAST(p_partkey AS STRING), 'TX', concat(p_brand, ' County'), p_size * 1000e0, p_size * 1001e0, p_size / 10e0,
       p_size / 8e0, 1996 + p_partkey % 5, 'SMALL', 'crystalline', p_partkey + 5000000
FROM part WHERE p_size > 25
""")

view("parcel_layer_in", """
SELECT p_partkey AS eia_id, CASE WHEN p_size < 5 THEN 'no_parcel_overlap' ELSE 'ok' END AS parcel_status,
       p_retailprice / 4e0 AS parcel_acres_host, p_size / 3e0 AS acres_per_mw_parcel,
       CASE WHEN p_type = 'PROMO' THEN 'low' ELSE 'high' END AS parcels_confidence
FROM part WHERE p_type <> 'SMALL'
""")

view("survey_plants", """
SELECT s_suppkey AS eia_id,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 345e0 WHEN s_suppkey % 3 = 1 THEN 138e0 ELSE 34.5e0 END
         AS grid_voltage_kv,
       CASE WHEN s_suppkey % 5 = 0 THEN 345e0 ELSE NULL END AS grid_voltage_2_kv,
       CASE WHEN s_suppkey % 4 = 0 THEN 69e0 ELSE NULL END AS grid_voltage_3_kv,
       1997 AS data_year, s_nationkey AS ordinal
FROM supplier
""")

view("survey_solar", """
SELECT l_suppkey AS eia_id, CAST(l_quantity AS STRING) AS nameplate_mw, l_quantity AS mw,
       CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'Y' ELSE 'N' END AS single_axis,
       CASE WHEN p_type = 'PROMO' THEN 'yes' ELSE NULL END AS dual_axis,
       CASE WHEN p_type IN ('LARGE', 'SMALL') AND p_size > 25 THEN 'Y' ELSE 'N' END AS fixed_tilt,
       CASE WHEN p_type = 'ECONOMY' AND p_size > 40 THEN ' y ' ELSE NULL END AS east_west,
       CASE l_returnflag WHEN 'A' THEN 'Y' WHEN 'N' THEN 'N' ELSE NULL END AS bifacial,
       CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END AS crystalline,
       CASE WHEN p_size % 3 = 0 THEN 'Y' ELSE 'N' END AS cdte, p_type AS label
FROM lineitem JOIN part ON l_partkey = p_partkey
""")

view("survey_generation", """
SELECT l_suppkey AS eia_id, CASE WHEN l_returnflag = 'R' THEN 'BA' ELSE ' pv' END AS prime_mover,
       CASE WHEN l_linestatus = 'O' THEN l_extendedprice / 10e0 ELSE NULL END AS net_generation_mwh,
       CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN 'm' WHEN 4 THEN 'A' WHEN 5 THEN 'AM' WHEN 6 THEN 'X' ELSE 'M' END
         AS frequency,
       l_quantity AS netgen_jan, l_quantity AS netgen_feb, l_quantity AS netgen_mar, l_quantity AS netgen_apr,
       CASE WHEN l_quantity > 10 THEN l_quantity END AS netgen_may, CASE WHEN l_quantity > 20 THEN l_quantity END AS netgen_jun,
       CASE WHEN l_quantity > 30 THEN l_quantity END AS netgen_jul, CASE WHEN l_quantity > 40 THEN l_quantity END AS netgen_aug,
       CASE WHEN l_quantity > 42 THEN l_quantity END AS netgen_sep, CASE WHEN l_quantity > 44 THEN l_quantity END AS netgen_oct,
       CASE WHEN l_quantity > 46 THEN l_quantity END AS netgen_nov, CASE WHEN l_quantity > 48 THEN l_quantity END AS netgen_dec,
       ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT) AS ordinal
FROM lineitem
""")

view("survey_capacity", """
SELECT s_suppkey AS eia_id, 3e1 + s_suppkey % 200 AS ac_mw,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE make_date(CAST(1994 + s_suppkey % 5 AS INT), 6, 1) END AS cod_last
FROM supplier
""")
