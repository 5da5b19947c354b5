"""Settlement: telemetry → 15-minute energy → unit, plant and window metrics."""

from pyspark.sql import functions as F

from ..config import config
from ..functions import calendar
from ..operators import settlement as st
from ..session import scratch_path
from ..streaming.live_settlement import live_energy
from ..streaming.settlement_stream import settle_days
from .registry import query, view

CFG = config(market={"max_interval_minutes": 360, "slice_minutes": 720, "min_gen_mwh_for_capture": 100.0})
R = lambda c, d=6: F.round(F.col(c), d).alias(c)

view("telemetry", """
SELECT concat('U', CAST(user_id AS STRING)) AS resource_name, CASE WHEN event_type = 'signup' THEN 'WIND' ELSE ' pvgr' END AS resource_type,
       ts AS sced_time_stamp, CAST(ts AS DATE) AS operating_day, value * 0.97345731e0 AS hsl,
       CASE WHEN event_type = 'click' AND value > 100 THEN NULL ELSE value * 0.97345731e0 * (event_id % 5) / 4e0 END AS base_point,
       CASE WHEN event_type = 'error' THEN 0e0 - value * 0.97345731e0 WHEN event_id % 5 < 4 THEN value * 0.97345731e0 * (event_id % 5) / 4e0 ELSE value * 0.97345731e0 END AS telemetered_net_output,
       event_type AS qse, event_id AS ordinal
FROM events
""")
view("price_rows", """
SELECT concat(substr(CAST(ts AS STRING), 1, 14), CASE WHEN minute(ts) < 15 THEN '00' WHEN minute(ts) < 30 THEN '15' WHEN minute(ts) < 45 THEN '30' ELSE '45' END)
         AS interval_text, event_type AS location, value * 1.03271593e0 AS spp, event_id AS ordinal
FROM events
UNION ALL
SELECT concat(substr(CAST(ts AS STRING), 1, 14), CASE WHEN minute(ts) < 15 THEN '00' WHEN minute(ts) < 30 THEN '15' WHEN minute(ts) < 45 THEN '30' ELSE '45' END),
       'HB_HUBAVG', value * 1.03271593e0 + 10e0, event_id FROM events
""")
view("unit_crosswalk", """
SELECT user_id % 40 AS eia_plant_id, concat('U', CAST(user_id AS STRING)) AS ercot_resource_name,
       CASE user_id % 6 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase' WHEN 4 THEN 'signup' ELSE '  ' END
         AS ercot_settlement_point, 50e0 + user_id % 40 AS ac_mw_eia,
       CASE WHEN user_id % 9 = 0 THEN ' ' ELSE 'CR' END AS verified_by, user_id AS ordinal
FROM (SELECT DISTINCT user_id FROM events) u
UNION ALL SELECT 1000 + r_regionkey, NULL, NULL, 50e0, 'CR', 1000000 + r_regionkey FROM region
UNION ALL SELECT 2000 + n_nationkey, concat('NOT_SEEN_', n_name), 'view', 60e0, 'CR', 2000000 + n_nationkey FROM nation
UNION ALL SELECT 3000 + c_nationkey, concat('U', CAST(c_custkey AS STRING)), 'click', 70e0, 'CR', 3000000 + c_custkey
FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT user_id FROM events)
""")

# oracle side only: epoch arithmetic in the checking engine
_HOURS = """
SELECT *, CASE WHEN gap > 0 AND gap <= 6 THEN gap ELSE 5e0 / 60e0 END AS hours FROM (
  SELECT *, (lead(epoch_us(sced_time_stamp)) OVER (PARTITION BY resource_name, operating_day
             ORDER BY sced_time_stamp, telemetered_net_output NULLS FIRST, base_point NULLS FIRST, hsl NULLS FIRST) - epoch_us(sced_time_stamp)) / 3.6e9 AS gap
  FROM telemetry WHERE upper(trim(resource_type)) = 'PVGR') g
"""
_S15 = f"""
SELECT resource_name, operating_day, time_bucket(INTERVAL 15 MINUTE, sced_time_stamp) AS interval_start,
  sum(greatest(telemetered_net_output, 0) * hours) AS gen_mwh, sum(hsl * hours) AS hsl_mwh,
  sum(greatest(hsl - coalesce(base_point, hsl), 0) * hours) AS curtailed_mwh, sum(hours) AS hours
FROM ({_HOURS}) h GROUP BY 1, 2, 3
"""
_PRICE = """
SELECT location, CAST(interval_text || ':00' AS TIMESTAMP) AS interval_start, spp FROM (
  SELECT *, row_number() OVER (PARTITION BY location, interval_text ORDER BY ordinal) AS rn FROM price_rows) p WHERE rn = 1
"""
_X = """
SELECT eia_plant_id AS eia_id, ercot_resource_name AS resource_name, nullif(trim(ercot_settlement_point), '') AS sp, ac_mw_eia, ordinal
FROM unit_crosswalk WHERE trim(verified_by) <> ''
"""
_UNITS = f"""
SELECT x.eia_id, x.resource_name, x.sp AS settlement_point, strftime(s.interval_start - INTERVAL 6 HOUR, '%Y-%m') AS month,
  sum(gen_mwh) AS gen_mwh, sum(hsl_mwh) AS hsl_mwh, sum(curtailed_mwh) AS curtailed_mwh,
  sum(CASE WHEN n.spp IS NOT NULL AND h.spp IS NOT NULL THEN gen_mwh ELSE 0 END) AS gen_priced_mwh,
  sum(CASE WHEN n.spp IS NOT NULL AND h.spp IS NOT NULL THEN gen_mwh * n.spp ELSE 0 END) AS rev_node,
  sum(CASE WHEN n.spp IS NOT NULL AND h.spp IS NOT NULL THEN gen_mwh * h.spp ELSE 0 END) AS rev_hub,
  sum(CASE WHEN n.spp IS NOT NULL AND h.spp IS NOT NULL THEN hsl_mwh ELSE 0 END) AS hsl_priced_mwh,
  sum(CASE WHEN n.spp IS NOT NULL AND h.spp IS NOT NULL THEN hsl_mwh * n.spp ELSE 0 END) AS rev_node_pot,
  sum(CASE WHEN n.spp IS NOT NULL AND h.spp IS NOT NULL THEN hsl_mwh * h.spp ELSE 0 END) AS rev_hub_pot,
  coalesce(sum(h.spp), 0) AS hub_sum, count(h.spp) AS hub_n, sum(hours) AS hours,
  count(DISTINCT CAST(s.interval_start - INTERVAL 6 HOUR AS DATE)) AS days, max(hsl_mwh / hours) AS peak_hsl_mw
FROM ({_S15}) s JOIN ({_X}) x ON s.resource_name = x.resource_name
LEFT JOIN ({_PRICE}) n ON n.location = x.sp AND n.interval_start = s.interval_start
LEFT JOIN ({_PRICE}) h ON h.location = 'HB_HUBAVG' AND h.interval_start = s.interval_start
GROUP BY 1, 2, 3, 4
"""
_CAP = f"SELECT eia_id, ac_mw_eia AS ac_mw FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY ordinal) AS rn FROM ({_X}) x1) c WHERE rn = 1"
_MONTHLY = f"""
SELECT g.*, c.ac_mw FROM (SELECT eia_id, month, {', '.join(f'sum({c}) AS {c}' for c in st.SUMS)}, max(hours) AS hours, max(days) AS days,
  sum(peak_hsl_mw) AS peak_hsl_mw, count(DISTINCT resource_name) AS n_units FROM ({_UNITS}) u GROUP BY 1, 2) g LEFT JOIN ({_CAP}) c ON g.eia_id = c.eia_id
"""


def tel(t):
    return st.pv_telemetry(t["telemetry"], CFG)


def sced15(t):
    return st.interval_energy(tel(t), CFG)


def prices(t):
    return t["price_rows"].withColumn("interval_start", F.to_timestamp("interval_text", "yyyy-MM-dd HH:mm"))


def xwalk(t):
    return st.verified_only(t["unit_crosswalk"])


def unit_energy(t):
    return st.interval_energy(st.of_units(tel(t), xwalk(t)), CFG)


def metrics(t):
    return st.market_metrics(unit_energy(t), prices(t), t["unit_crosswalk"], CFG)


view("doubled_crosswalk", "SELECT * FROM unit_crosswalk UNION ALL SELECT * FROM unit_crosswalk WHERE eia_plant_id % 3 = 0")


@query("duplicate_units", "SELECT eia_plant_id AS eia_id, ercot_resource_name AS resource_name, count(*) AS n_rows FROM doubled_crosswalk WHERE trim(ercot_resource_name) <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return st.duplicate_units(t["doubled_crosswalk"])


STAMP = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("dispatch_duration", f"SELECT resource_name, strftime(sced_time_stamp, '%Y-%m-%d %H:%M:%S') AS at, round(hours, 6) AS hours FROM ({_HOURS}) h")
def _(t):
    return st.dispatch_hours(tel(t), CFG).select("resource_name", STAMP("utc").alias("at"), R("hours"))


@query("interval_15min_sum", f"""
SELECT resource_name, strftime(interval_start, '%Y-%m-%d %H:%M:%S') AS interval_start, round(gen_mwh, 6) AS gen_mwh, round(hsl_mwh, 6) AS hsl_mwh,
       round(curtailed_mwh, 6) AS curtailed_mwh, round(hours, 6) AS hours FROM ({_S15}) s
""")
def _(t):
    return sced15(t).select("resource_name", STAMP("interval_start").alias("interval_start"), R("gen_mwh"), R("hsl_mwh"), R("curtailed_mwh"), R("hours"))


@query("incremental_settlement", f"""
SELECT resource_name, strftime(interval_start, '%Y-%m-%d %H:%M:%S') AS interval_start, round(gen_mwh, 6) AS gen_mwh, round(hours, 6) AS hours FROM ({_S15}) s
""")
def _(t):
    """Each day comes in two deliveries, mornings first; the stream must end with what one batch of all rows gives."""
    source, out, state = (scratch_path(t.spark, f"day-{k}") for k in ("files", "energy", "state"))
    rows = t["telemetry"]
    for part in (F.hour("sced_time_stamp") < 12, F.hour("sced_time_stamp") >= 12):
        rows.filter(part).write.mode("append").parquet(source)
        settle_days(t.spark, source, rows.schema, out, state, CFG).awaitTermination()
    return t.spark.read.parquet(out).select("resource_name", STAMP("interval_start").alias("interval_start"), R("gen_mwh"), R("hours"))


@query("live_settlement", f"""
SELECT resource_name, strftime(interval_start, '%Y-%m-%d %H:%M:%S') AS interval_start, round(gen_mwh, 6) AS gen_mwh, round(curtailed_mwh, 6) AS curtailed_mwh,
       round(hours, 6) AS hours
FROM ({_S15}) s WHERE interval_start + INTERVAL 375 MINUTE <= (SELECT date_trunc('millisecond', max(sced_time_stamp)) - INTERVAL 3 HOUR FROM telemetry WHERE upper(trim(resource_type)) = 'PVGR')
""")
def _(t):
    """Rows arrive up to two hours out of order, in two deliveries that overlap; the watermark waits for three. What is final
    at the last watermark is what one batch of all rows gives for it."""
    source, out, state = (scratch_path(t.spark, f"live-{k}") for k in ("files", "energy", "state"))
    rows = t["telemetry"]
    seconds = F.unix_seconds(F.col("sced_time_stamp").cast("timestamp"))
    low, high = rows.agg(F.min(seconds), F.max(seconds)).first()
    early = seconds + F.pmod(F.xxhash64("ordinal"), F.lit(7200)) < ((low or 0) + (high or 0)) // 2
    for part in (early, ~early):
        rows.filter(part).write.mode("append").parquet(source)
        live = live_energy(st.pv_telemetry(t.spark.readStream.schema(rows.schema).parquet(source), CFG), CFG, "3 hours")
        live.writeStream.option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return t.spark.read.parquet(out).select("resource_name", STAMP("interval_start").alias("interval_start"), R("gen_mwh"), R("curtailed_mwh"), R("hours"))


@query("curtailed_energy", f"""
SELECT resource_name, round(sum(gen_mwh), 6) AS gen_mwh, round(sum(hsl_mwh), 6) AS hsl_mwh, round(sum(curtailed_mwh), 6) AS curtailed_mwh
FROM ({_S15}) s GROUP BY 1
""")
def _(t):
    return sced15(t).groupBy("resource_name").agg(*[F.round(F.sum(c), 6).alias(c) for c in ("gen_mwh", "hsl_mwh", "curtailed_mwh")])


@query("sced_pv_summary", """
SELECT resource_name, max(hsl) AS max_hsl_mw, count(*) AS intervals, arg_min(qse, ordinal) AS qse FROM telemetry
WHERE upper(trim(resource_type)) = 'PVGR' GROUP BY 1
""")
def _(t):
    return st.resource_summary(t["telemetry"], CFG)


@query("price_lookup", f"""
SELECT x.eia_id, s.resource_name, strftime(s.interval_start, '%Y-%m-%d %H:%M:%S') AS interval_start, n.spp AS node, h.spp AS hub
FROM ({_S15}) s JOIN ({_X}) x ON s.resource_name = x.resource_name
LEFT JOIN ({_PRICE}) n ON n.location = x.sp AND n.interval_start = s.interval_start
LEFT JOIN ({_PRICE}) h ON h.location = 'HB_HUBAVG' AND h.interval_start = s.interval_start
""")
def _(t):
    p = st.priced_intervals(unit_energy(t), prices(t), xwalk(t), CFG)
    return p.select("eia_id", "resource_name", STAMP("interval_start").alias("interval_start"), "node", "hub")


_UR = ["gen_mwh", "hsl_mwh", "curtailed_mwh", "gen_priced_mwh", "rev_node", "rev_hub", "hsl_priced_mwh", "rev_node_pot", "rev_hub_pot", "hub_sum"]


@query("unit_monthly", f"""
SELECT eia_id, resource_name, settlement_point, month, {', '.join(f'round({c}, 4) AS {c}' for c in _UR)}, hub_n, round(hours, 6) AS hours, days,
       round(peak_hsl_mw, 6) AS peak_hsl_mw, gen_priced_mwh > 0 AS node_priced FROM ({_UNITS}) u
""")
def _(t):
    u = st.unit_monthly(unit_energy(t), prices(t), xwalk(t), CFG)
    return u.select("eia_id", "resource_name", "settlement_point", "month", *[R(c, 4) for c in _UR], "hub_n", R("hours"), "days", R("peak_hsl_mw"), "node_priced")


_RATIOS = """
  hub_sum / nullif(hub_n, 0) AS hub_avg, rev_node / nullif(gen_priced_mwh, 0) AS node_w, rev_hub / nullif(gen_priced_mwh, 0) AS hub_w
"""


@query("plant_monthly", f"""
SELECT eia_id, month, n_units, days, round(hours, 6) AS hours, round(gen_mwh, 4) AS gen_mwh, round(hsl_mwh, 4) AS hsl_mwh, round(curtailed_mwh, 4) AS curtailed_mwh,
  round(peak_hsl_mw, 6) AS peak_hsl_mw, round(hub_avg, 6) AS hub_avg_spp, round(node_w, 6) AS node_gen_wtd_spp, round(hub_w, 6) AS hub_gen_wtd_spp,
  round(curtailed_mwh / nullif(hsl_mwh, 0), 6) AS curtailment_pct, round(node_w / nullif(hub_avg, 0), 6) AS capture_rate,
  round(rev_node_pot / nullif(hsl_priced_mwh, 0) / nullif(hub_avg, 0), 6) AS capture_rate_potential, round(hub_w / nullif(hub_avg, 0), 6) AS shape_capture,
  round(rev_node / nullif(rev_hub, 0), 6) AS basis_ratio, round(gen_mwh / (ac_mw * hours), 6) AS sced_net_cf, round(hsl_mwh / (ac_mw * hours), 6) AS sced_potential_cf
FROM (SELECT *, {_RATIOS} FROM ({_MONTHLY}) m) r
""")
def _(t):
    m, _s = metrics(t)
    return m.select("eia_id", "month", "n_units", "days", R("hours"), R("gen_mwh", 4), R("hsl_mwh", 4), R("curtailed_mwh", 4), R("peak_hsl_mw"), R("hub_avg_spp"),
                    R("node_gen_wtd_spp"), R("hub_gen_wtd_spp"), R("curtailment_pct"), R("capture_rate"), R("capture_rate_potential"), R("shape_capture"),
                    R("basis_ratio"), R("sced_net_cf"), R("sced_potential_cf"))


_META = f"""
SELECT eia_id, coalesce(string_agg(resource_name, '+' ORDER BY ordinal), '') AS resources,
  coalesce((SELECT string_agg(v, '+' ORDER BY v) FROM (SELECT DISTINCT sp AS v FROM ({_X}) x3 WHERE x3.eia_id = x2.eia_id AND sp IS NOT NULL) d), '') AS settlement_points,
  coalesce(bool_or(uses > 1), false) AS ercot_resource_shared
FROM (SELECT *, CASE WHEN resource_name IS NOT NULL THEN count(*) OVER (PARTITION BY resource_name) END AS uses FROM ({_X}) x0) x2 GROUP BY eia_id
"""
_FULL = f"SELECT * FROM ({_MONTHLY}) m WHERE days / CAST(day(last_day(CAST(month || '-01' AS DATE))) AS DOUBLE) >= 0.9"
_SUMMARY = f"""
SELECT b.*, {_RATIOS}, coalesce(gen_priced_mwh >= 100, false) AS enough FROM (
  SELECT x.*, c.ac_mw, w.* EXCLUDE (eia_id), r.recent, s.months_seen FROM ({_META}) x LEFT JOIN ({_CAP}) c ON x.eia_id = c.eia_id
  LEFT JOIN (SELECT eia_id, count(DISTINCT month) AS months, min(month) AS window_start, max(month) AS window_end, max(peak_hsl_mw) AS peak_hsl_mw,
     sum(hours) AS hours, {', '.join(f'sum({c}) AS {c}' for c in st.SUMS)} FROM ({_FULL}) f GROUP BY 1) w ON x.eia_id = w.eia_id
  LEFT JOIN (SELECT eia_id, max(peak_hsl_mw) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY month DESC) AS rn FROM ({_FULL}) f2) q
     WHERE rn <= 3 GROUP BY 1) r ON x.eia_id = r.eia_id
  LEFT JOIN (SELECT eia_id, count(DISTINCT month) AS months_seen FROM ({_MONTHLY}) m2 GROUP BY 1) s ON x.eia_id = s.eia_id) b
"""
_SUMMARY_OUT = f"""
SELECT eia_id, resources, settlement_points, ercot_resource_shared, coalesce(months, 0) AS metrics_window_months, window_start, window_end,
  CASE WHEN resources = '' THEN 'no_ercot_resource' WHEN months_seen IS NULL THEN 'no_sced_data' WHEN months IS NULL THEN 'no_full_months'
       WHEN settlement_points = '' THEN 'no_settlement_point' WHEN NOT enough THEN 'too_little_generation' ELSE 'ok' END AS metrics_status,
  round(gen_mwh, 4) AS gen_mwh, round(peak_hsl_mw / ac_mw, 6) AS peak_hsl_ratio, round(recent / ac_mw, 6) AS peak_hsl_ratio_recent,
  round(hub_avg, 6) AS hub_avg_spp, round(curtailed_mwh / nullif(hsl_mwh, 0), 6) AS curtailment_pct,
  round(CASE WHEN enough THEN node_w END, 6) AS node_gen_wtd_spp, round(CASE WHEN enough THEN node_w / hub_avg END, 6) AS capture_rate,
  round(CASE WHEN enough THEN rev_node_pot / hsl_priced_mwh / hub_avg END, 6) AS capture_rate_potential,
  round(CASE WHEN enough THEN hub_w / hub_avg END, 6) AS shape_capture, round(CASE WHEN enough THEN rev_node / nullif(rev_hub, 0) END, 6) AS basis_ratio,
  round(gen_mwh / (ac_mw * hours), 6) AS sced_net_cf, round(hsl_mwh / (ac_mw * hours), 6) AS sced_potential_cf
FROM ({_SUMMARY}) z
"""


def summary_out(t):
    _m, s = metrics(t)
    return s.select("eia_id", "resources", "settlement_points", "ercot_resource_shared", "metrics_window_months", "window_start", "window_end", "metrics_status",
                    R("gen_mwh", 4), R("peak_hsl_ratio"), R("peak_hsl_ratio_recent"), R("hub_avg_spp"), R("curtailment_pct"), R("node_gen_wtd_spp"),
                    R("capture_rate"), R("capture_rate_potential"), R("shape_capture"), R("basis_ratio"), R("sced_net_cf"), R("sced_potential_cf"))


@query("window_summary", _SUMMARY_OUT)
def _(t):
    return summary_out(t)


@query("market_compute", f"SELECT eia_id, metrics_status, round(gen_mwh, 3) AS gen_mwh FROM ({_SUMMARY_OUT}) s")
def _(t):
    return summary_out(t).select("eia_id", "metrics_status", R("gen_mwh", 3))


@query("recent_peak", f"""
SELECT eia_id, round(max(peak_hsl_mw), 6) AS peak_hsl_mw_recent FROM (SELECT *, row_number() OVER (PARTITION BY eia_id ORDER BY month DESC) AS rn FROM ({_FULL}) f) q
WHERE rn <= 3 GROUP BY 1
""")
def _(t):
    m, _s = metrics(t)
    return st.recent_peak(m, CFG).select("eia_id", R("peak_hsl_mw_recent"))


@query("resource_concat", f"SELECT eia_id, resources, settlement_points FROM ({_META}) m")
def _(t):
    return st.crosswalk_meta(xwalk(t)).select("eia_id", "resources", "settlement_points")


@query("shared_unit_flag", f"SELECT eia_id, ercot_resource_shared FROM ({_META}) m")
def _(t):
    return st.crosswalk_meta(xwalk(t)).select("eia_id", "ercot_resource_shared")


@query("verified_only_filter", "SELECT eia_plant_id, ercot_resource_name FROM unit_crosswalk WHERE trim(verified_by) <> ''")
def _(t):
    return xwalk(t).select("eia_plant_id", "ercot_resource_name")


@query("history_pivot", f"""
SELECT strftime(interval_start - INTERVAL 6 HOUR, '%Y-%m') AS month, round(max(CASE WHEN resource_name = 'U3' THEN hsl_mwh / hours END), 6) AS U3_peak,
  round(sum(CASE WHEN resource_name = 'U3' THEN gen_mwh END), 6) AS U3_gen, round(max(CASE WHEN resource_name = 'U8' THEN hsl_mwh / hours END), 6) AS U8_peak,
  round(sum(CASE WHEN resource_name = 'U8' THEN gen_mwh END), 6) AS U8_gen FROM ({_S15}) s GROUP BY 1
""")
def _(t):
    p = st.history_pivot(sced15(t), ["U3", "U8"], CFG)
    return p.select("month", R("U3_peak"), R("U3_gen"), R("U8_peak"), R("U8_gen"))


@query("required_minus_recorded", """
SELECT DISTINCT trim(ercot_settlement_point) AS location FROM unit_crosswalk WHERE trim(ercot_settlement_point) <> ''
  AND trim(ercot_settlement_point) NOT IN (SELECT location FROM price_rows WHERE spp < 0.5e0)
UNION SELECT location FROM (VALUES ('HB_NORTH'), ('HB_SOUTH'), ('HB_WEST'), ('HB_HOUSTON'), ('HB_BUSAVG'), ('HB_HUBAVG')) v(location)
WHERE location NOT IN (SELECT location FROM price_rows WHERE spp < 0.5e0)
""")
def _(t):
    recorded = t["price_rows"].filter("spp < 0.5e0").select("location")
    return st.locations_to_fetch(t["unit_crosswalk"], recorded, CFG)


view("wall_clocks", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN concat('11/03/2024 0', CAST(hour(ts) % 4 AS STRING)) WHEN event_type = 'error'
       THEN concat('03/10/2024 0', CAST(hour(ts) % 4 AS STRING)) ELSE concat('07/15/2024 0', CAST(hour(ts) % 4 AS STRING)) END AS head,
       minute(ts) AS mi, CASE WHEN event_type = 'click' THEN 'Y' ELSE 'N' END AS flag, event_type, hour(ts) % 4 AS hr
FROM events
""")


@query("localize_dst", """
SELECT event_id, strftime(CASE WHEN event_type IN ('view', 'click') THEN TIMESTAMP '2024-11-03 00:00:00' WHEN event_type = 'error' THEN TIMESTAMP '2024-03-10 00:00:00'
    ELSE TIMESTAMP '2024-07-15 00:00:00' END + to_minutes(CAST(hr * 60 + mi AS BIGINT))
    + to_hours(CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN hr = 0 OR (hr = 1 AND flag = 'N') THEN 5 ELSE 6 END
                    WHEN event_type = 'error' THEN CASE WHEN hr < 2 THEN 6 ELSE 5 END ELSE 5 END), '%Y-%m-%d %H:%M:%S') AS utc
FROM wall_clocks WHERE NOT (event_type = 'error' AND hr = 2)
""")
def _(t):
    w = t["wall_clocks"].withColumn("wall", F.try_to_timestamp(F.concat(F.col("head"), F.lit(":"), F.lpad(F.col("mi").cast("string"), 2, "0"), F.lit(":00")),
                                                                F.lit("MM/dd/yyyy HH:mm:ss")))
    utc = calendar.localize(F.col("wall"), F.col("flag") == "Y", CFG["market"]["timezone"])
    return w.withColumn("utc", utc).filter("utc is not null").select("event_id", STAMP("utc").alias("utc"))


@query("local_month", "SELECT event_id, strftime(ts - INTERVAL 6 HOUR, '%Y-%m') AS month, strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d') AS day FROM events")
def _(t):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), CFG["market"]["timezone"])
    return t["events"].select("event_id", F.date_format(local, "yyyy-MM").alias("month"), F.date_format(local, "yyyy-MM-dd").alias("day"))


@query("history_window", """
SELECT o_orderkey, CAST(greatest(DATE '1998-06-11', CAST((CAST(o_orderdate AS DATE) - 62) - INTERVAL 36 MONTH AS DATE)) AS STRING) AS window_start,
       CAST(CAST(o_orderdate AS DATE) - 62 AS STRING) AS window_end FROM orders
""")
def _(t):
    start, end = calendar.history_window(F.to_date("o_orderdate"), config(market_window={"history_floor": "1998-06-11"}))
    return t["orders"].select("o_orderkey", F.date_format(start, "yyyy-MM-dd").alias("window_start"), F.date_format(end, "yyyy-MM-dd").alias("window_end"))
