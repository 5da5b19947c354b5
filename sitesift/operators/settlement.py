"""Interval telemetry and prices → unit months → plant months → window metrics.

The telemetry is the large table. It is shuffled once, on (resource, day, time slice): slices are a few hours wide and
each also receives the rows just after its end, so the time to the next dispatch run is exact while a resource that
holds most of a day's rows is still spread over many tasks. The 15-minute sums reuse that partitioning. Everything after
them works on sums that were reduced map-side.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import days_in_month, localize
from ..functions.text import month_label
from ..functions.nulls import blank_to_null, ratio, sum_or_zero, to_number
from ..session import cut_lineage

MINUTE_US = 60_000_000
INTERVAL_US = 15 * MINUTE_US
SUMS = ["gen_mwh", "hsl_mwh", "curtailed_mwh", "gen_priced_mwh", "rev_node", "rev_hub", "hsl_priced_mwh", "rev_node_pot",
        "rev_hub_pot", "hub_sum", "hub_n"]


def pv_telemetry(raw: DataFrame, cfg: dict, stamp_format: str = "MM/dd/yyyy HH:mm:ss") -> DataFrame:
    """Published dispatch rows → photovoltaic rows with a UTC instant. Wall-clock text is localised (the repeated autumn
    hour by its flag); a timestamp column is taken as an instant. Rows without a usable instant are dropped."""
    cols, m = set(raw.columns), cfg["market"]
    pv = raw.filter(F.upper(F.trim(F.col("resource_type"))) == cfg["market_source"]["pv_resource_type"])
    kind = dict(raw.dtypes)["sced_time_stamp"]
    if kind == "string":
        wall = F.try_to_timestamp(F.col("sced_time_stamp"), F.lit(stamp_format))
        flag = (F.coalesce(F.upper(F.trim(F.col("repeated_hour_flag"))) == "Y", F.lit(False))
                if "repeated_hour_flag" in cols else None)
        utc = localize(wall, flag, m["timezone"])
        day = F.to_date(wall)
    else:
        utc = F.col("sced_time_stamp").cast("timestamp")
        day = F.to_date(F.from_utc_timestamp(utc, m["timezone"]))
    day = F.col("operating_day") if "operating_day" in cols else day
    return pv.select(F.trim(F.col("resource_name")).alias("resource_name"), day.alias("operating_day"), utc.alias("utc"),
                     to_number(F.col("telemetered_net_output")).alias("tno"), to_number(F.col("base_point")).alias("bp"),
                     to_number(F.col("hsl")).alias("hsl")).filter("utc is not null")


def resource_summary(raw: DataFrame, cfg: dict, ordinal: str = "ordinal") -> DataFrame:
    """Per photovoltaic resource: highest HSL, rows seen, first scheduling entity."""
    pv = raw.filter(F.upper(F.trim(F.col("resource_type"))) == cfg["market_source"]["pv_resource_type"])
    return pv.groupBy("resource_name").agg(
        F.max(to_number(F.col("hsl"))).alias("max_hsl_mw"), F.count(F.lit(1)).alias("intervals"),
        F.min_by("qse", F.when(F.col("qse").isNotNull(), F.col(ordinal))).alias("qse"))


def slice_width(cfg: dict) -> int:
    """Microseconds of a time slice: whole quarter hours, at least as long as the farthest next run."""
    m = cfg["market"]
    if m["slice_minutes"] <= 0 or m["slice_minutes"] % 15:
        raise ValueError("slice_minutes must be a multiple of 15, so that no quarter hour lies in two slices")
    return -(-max(m["slice_minutes"], m["max_interval_minutes"]) // 15) * INTERVAL_US


def time_slices(tel: DataFrame, cfg: dict) -> DataFrame:
    """Each row in its slice `_cell`, and again (`_after`, its instant alone) in the slice before if it lies just behind its end."""
    reach, width = cfg["market"]["max_interval_minutes"] * MINUTE_US, slice_width(cfg)
    us = F.unix_micros("utc")
    cell = F.floor(us / width)
    here = F.struct(cell.alias("cell"), F.lit(False).alias("after"))
    before = F.when(us - cell * width <= reach, F.struct((cell - 1).alias("cell"), F.lit(True).alias("after")))
    payload = [c for c in tel.columns if c not in ("resource_name", "operating_day", "utc")]
    return (tel.select("*", F.explode(F.array_compact(F.array(here, before))).alias("_s"))
            .select("resource_name", "operating_day", "utc", F.col("_s.cell").alias("_cell"), F.col("_s.after").alias("_after"),
                    *[F.when(~F.col("_s.after"), F.col(c)).alias(c) for c in payload]))


def dispatch_hours(tel: DataFrame, cfg: dict) -> DataFrame:
    """Adds hours: time to the resource's next run of the same day; none, zero or too far → the default length."""
    m = cfg["market"]
    payload = [c for c in tel.columns if c not in ("resource_name", "operating_day", "utc")]
    w = Window.partitionBy("resource_name", "operating_day", "_cell").orderBy("utc", "_after", *payload)
    gap = (F.unix_micros(F.lead("utc").over(w)) - F.unix_micros("utc")) / F.lit(60.0 * MINUTE_US)
    usable = (F.col("_gap") > 0) & (F.col("_gap") <= m["max_interval_minutes"] / 60.0)
    return (time_slices(tel, cfg).withColumn("_gap", gap).filter("not _after")
            .withColumn("hours", F.when(usable, F.col("_gap")).otherwise(m["default_minutes"] / 60.0))
            .drop("_gap", "_after"))


def interval_energy(tel: DataFrame, cfg: dict) -> DataFrame:
    """15-minute energy per resource: delivered, available and curtailed MWh. Negative output counts as none and an
    unknown base point as no curtailment."""
    timed = dispatch_hours(tel, cfg)
    hsl = F.coalesce(F.greatest(F.col("hsl"), F.lit(0.0)), F.lit(0.0))
    out = F.coalesce(F.greatest(F.col("tno"), F.lit(0.0)), F.lit(0.0))
    cut = F.greatest(hsl - F.coalesce(F.col("bp"), hsl), F.lit(0.0))
    start = F.timestamp_micros((F.floor(F.unix_micros("utc") / INTERVAL_US) * INTERVAL_US).cast("bigint"))
    return (timed.withColumn("interval_start", start)
            .groupBy("resource_name", "operating_day", "_cell", "interval_start")
            .agg(F.sum(out * F.col("hours")).alias("gen_mwh"), F.sum(hsl * F.col("hours")).alias("hsl_mwh"),
                 F.sum(cut * F.col("hours")).alias("curtailed_mwh"), F.sum("hours").alias("hours"))
            .drop("_cell"))


def first_prices(prices: DataFrame) -> DataFrame:
    """One price per location and interval: the first row stands, even if its price is null. Rows carry their place in
    `ordinal`; a table without it has no first row, there the lowest price stands."""
    pick = F.min_by("spp", "ordinal") if "ordinal" in prices.columns else F.min("spp")
    return prices.groupBy("location", "interval_start").agg(pick.alias("spp"))


def crosswalk_units(xwalk: DataFrame) -> DataFrame:
    """Plant, resource, node of the rows that name a resource. A row that stands there twice counts once: its unit's
    energy and hours are not doubled (`duplicate_units` lists such rows for correction)."""
    return (xwalk.select(F.col("eia_plant_id").cast("bigint").alias("eia_id"),
                         blank_to_null(F.col("ercot_resource_name")).alias("resource_name"),
                         blank_to_null(F.col("ercot_settlement_point")).alias("settlement_point"))
            .filter("resource_name is not null").distinct())


def duplicate_units(xwalk: DataFrame) -> DataFrame:
    """(eia_id, resource_name, n_rows) of units that a plant's crosswalk rows name more than once."""
    return (xwalk.select(F.col("eia_plant_id").cast("bigint").alias("eia_id"), blank_to_null(F.col("ercot_resource_name")).alias("resource_name"))
            .filter("resource_name is not null").groupBy("eia_id", "resource_name").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"))


def of_units(tel: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Telemetry of the crosswalk's resources alone. It stands before the shuffle of the dispatch lengths: a resource's rows
    never depend on another's."""
    return tel.join(crosswalk_units(xwalk).select("resource_name").distinct(), "resource_name", "left_semi")


def priced_intervals(sced15: DataFrame, prices: DataFrame, xwalk: DataFrame, cfg: dict) -> DataFrame:
    """Intervals of crosswalk units with their node price and the hub price. Prices are reduced once, for node and hub."""
    hub_name = cfg["market"]["hub"]
    one = cut_lineage(first_prices(prices), "prices")
    node = one.select(F.col("location").alias("settlement_point"), "interval_start", F.col("spp").alias("node"))
    hub = one.filter(F.col("location") == hub_name).select("interval_start", F.col("spp").alias("hub"))
    return (sced15.join(crosswalk_units(xwalk), "resource_name")
            .join(node, ["settlement_point", "interval_start"], "left")
            .join(hub, "interval_start", "left"))


def unit_monthly(sced15: DataFrame, prices: DataFrame, xwalk: DataFrame, cfg: dict) -> DataFrame:
    """Per plant, unit and local month: energy, price-weighted sums over priced intervals, days seen, peak."""
    u = priced_intervals(sced15, prices, xwalk, cfg)
    local = F.from_utc_timestamp("interval_start", cfg["market"]["timezone"])
    priced = F.col("node").isNotNull() & F.col("hub").isNotNull()
    only = lambda v: F.sum(F.when(priced, v).otherwise(0.0))
    gen, hsl = F.col("gen_mwh"), F.col("hsl_mwh")
    return (u.withColumn("month", month_label(local)).withColumn("_date", F.to_date(local))
            .groupBy("eia_id", "resource_name", "settlement_point", "month")
            .agg(F.sum(gen).alias("gen_mwh"), F.sum(hsl).alias("hsl_mwh"), F.sum("curtailed_mwh").alias("curtailed_mwh"),
                 only(gen).alias("gen_priced_mwh"), only(gen * F.col("node")).alias("rev_node"),
                 only(gen * F.col("hub")).alias("rev_hub"), only(hsl).alias("hsl_priced_mwh"),
                 only(hsl * F.col("node")).alias("rev_node_pot"), only(hsl * F.col("hub")).alias("rev_hub_pot"),
                 sum_or_zero(F.col("hub")).alias("hub_sum"), F.count("hub").alias("hub_n"), F.sum("hours").alias("hours"),
                 F.countDistinct("_date").alias("days"), F.max(ratio(hsl, F.col("hours"))).alias("peak_hsl_mw"))
            .withColumn("node_priced", F.col("gen_priced_mwh") > 0))


def plant_capacity(xwalk: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    return (xwalk.groupBy(F.col("eia_plant_id").cast("bigint").alias("eia_id"))
            .agg(F.min_by("ac_mw_eia", F.when(F.col("ac_mw_eia").isNotNull(), F.col(ordinal))).alias("ac_mw")))


def _ratios(df: DataFrame) -> DataFrame:
    hub_avg = ratio(F.col("hub_sum"), F.col("hub_n"))
    per_hour = F.col("ac_mw") * F.col("hours")
    return (df.withColumn("hub_avg_spp", hub_avg)
            .withColumn("node_gen_wtd_spp", ratio(F.col("rev_node"), F.col("gen_priced_mwh")))
            .withColumn("hub_gen_wtd_spp", ratio(F.col("rev_hub"), F.col("gen_priced_mwh")))
            .withColumn("curtailment_pct", ratio(F.col("curtailed_mwh"), F.col("hsl_mwh")))
            .withColumn("capture_rate", ratio(F.col("node_gen_wtd_spp"), F.col("hub_avg_spp")))
            .withColumn("capture_rate_potential",
                        ratio(ratio(F.col("rev_node_pot"), F.col("hsl_priced_mwh")), F.col("hub_avg_spp")))
            .withColumn("shape_capture", ratio(F.col("hub_gen_wtd_spp"), F.col("hub_avg_spp")))
            .withColumn("basis_ratio", ratio(F.col("rev_node"), F.col("rev_hub")))
            .withColumn("sced_net_cf", ratio(F.col("gen_mwh"), per_hour))
            .withColumn("sced_potential_cf", ratio(F.col("hsl_mwh"), per_hour)))


def plant_monthly(units: DataFrame, capacity: DataFrame) -> DataFrame:
    """Units summed into plants per month. Hours and days are those of the best-covered unit, the peak is the sum."""
    g = units.groupBy("eia_id", "month").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.max("hours").alias("hours"), F.max("days").alias("days"),
        F.sum("peak_hsl_mw").alias("peak_hsl_mw"), F.countDistinct("resource_name").alias("n_units"))
    return _ratios(g.join(capacity, "eia_id", "left"))


def crosswalk_meta(xwalk: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Per plant: resources joined by + in crosswalk order, distinct nodes sorted, whether a unit is also another row's.
    The lists are a plant's own few crosswalk rows."""
    x = xwalk.select(F.col("eia_plant_id").cast("bigint").alias("eia_id"), F.col(ordinal).alias("_o"),
                     blank_to_null(F.col("ercot_resource_name")).alias("res"),
                     blank_to_null(F.col("ercot_settlement_point")).alias("sp"))
    uses = x.filter("res is not null").groupBy("res").agg((F.count(F.lit(1)) > 1).alias("_shared"))
    in_order = F.array_sort(F.collect_list(F.when(F.col("res").isNotNull(), F.struct("_o", "res"))))
    return (x.join(uses, "res", "left").groupBy("eia_id").agg(
        F.array_join(F.transform(in_order, lambda s: s["res"]), "+").alias("resources"),
        F.array_join(F.array_sort(F.collect_set("sp")), "+").alias("settlement_points"),
        F.coalesce(F.max("_shared"), F.lit(False)).alias("ercot_resource_shared")))


def full_month(cfg: dict) -> Column:
    return F.coalesce(F.col("days") / days_in_month(F.col("month")) >= cfg["market"]["min_month_coverage"], F.lit(False))


def recent_peak_of(months: int, is_full: Column) -> Column:
    """Highest peak of a plant's last full months. The list holds one entry per month of the window, a few dozen."""
    entries = F.collect_list(F.when(is_full, F.struct("month", "peak_hsl_mw")))
    return F.array_max(F.transform(F.slice(F.sort_array(entries, asc=False), 1, months), lambda e: e["peak_hsl_mw"]))


def recent_peak(monthly: DataFrame, cfg: dict, months: int = 3) -> DataFrame:
    return (monthly.groupBy("eia_id").agg(recent_peak_of(months, full_month(cfg)).alias("peak_hsl_mw_recent"))
            .filter("peak_hsl_mw_recent is not null"))


def plant_summary(monthly: DataFrame, xwalk: DataFrame, capacity: DataFrame, cfg: dict) -> DataFrame:
    """One row per crosswalk plant over its full months. Ratios come from sums; the status says why one is missing.
    monthly has one row per plant and month and is read once."""
    m = cfg["market"]
    full = full_month(cfg)
    sums = ["gen_mwh", "hsl_mwh", "curtailed_mwh", "gen_priced_mwh", "rev_node", "rev_hub", "hsl_priced_mwh", "rev_node_pot",
            "hub_sum", "hub_n", "hours"]
    window = (monthly.withColumn("_full", full).groupBy("eia_id").agg(
        F.count_if("_full").alias("_n"), F.count(F.lit(1)).alias("months_seen"),
        F.min(F.when(F.col("_full"), F.col("month"))).alias("window_start"),
        F.max(F.when(F.col("_full"), F.col("month"))).alias("window_end"),
        *[F.sum(F.when(F.col("_full"), F.col(c))).alias(c) for c in sums],
        F.max(F.when(F.col("_full"), F.col("peak_hsl_mw"))).alias("peak_hsl_mw"),
        recent_peak_of(3, F.col("_full")).alias("peak_hsl_mw_recent"))
        .withColumn("metrics_window_months", F.when(F.col("_n") > 0, F.col("_n"))).drop("_n"))
    out = crosswalk_meta(xwalk).join(capacity, "eia_id", "left").join(window, "eia_id", "left")
    enough = F.coalesce(F.col("gen_priced_mwh") >= m["min_gen_mwh_for_capture"], F.lit(False))
    out = _ratios(out).withColumn("_enough", enough)
    for c in ("node_gen_wtd_spp", "capture_rate", "capture_rate_potential", "shape_capture", "basis_ratio"):
        out = out.withColumn(c, F.when(F.col("_enough"), F.col(c)))
    status = (F.when(F.col("resources") == "", "no_ercot_resource").when(F.col("months_seen").isNull(), "no_sced_data")
              .when(F.col("metrics_window_months").isNull(), "no_full_months")
              .when(F.col("settlement_points") == "", "no_settlement_point")
              .when(~F.col("_enough"), "too_little_generation").otherwise("ok"))
    none = ["no_ercot_resource", "no_sced_data", "no_full_months"]
    return (out.withColumn("metrics_status", status)
            .withColumn("sced_coverage", F.when(F.col("metrics_status").isin(none), "none").otherwise("full"))
            .withColumn("peak_hsl_ratio", ratio(F.col("peak_hsl_mw"), F.col("ac_mw")))
            .withColumn("peak_hsl_ratio_recent", ratio(F.col("peak_hsl_mw_recent"), F.col("ac_mw")))
            .withColumn("metrics_window_months", F.coalesce(F.col("metrics_window_months"), F.lit(0)))
            .drop("gen_priced_mwh", "rev_node", "rev_hub", "hsl_priced_mwh", "rev_node_pot", "hub_sum", "hub_n", "hours",
                  "peak_hsl_mw_recent", "hub_gen_wtd_spp", "_enough", "ac_mw"))


def verified_only(xwalk: DataFrame) -> DataFrame:
    return xwalk.filter(blank_to_null(F.col("verified_by")).isNotNull())


def market_metrics(sced15: DataFrame, prices: DataFrame, xwalk: DataFrame, cfg: dict) -> tuple[DataFrame, DataFrame]:
    """(plant months, plant summary) from the verified crosswalk rows alone, which are found once."""
    x = cut_lineage(verified_only(xwalk), "verified")
    capacity = plant_capacity(x)
    monthly = plant_monthly(unit_monthly(sced15, prices, x, cfg), capacity)
    return monthly, plant_summary(monthly, x, capacity, cfg)


def history_pivot(sced15: DataFrame, resources: list[str], cfg: dict) -> DataFrame:
    """Month rows, per named resource its peak HSL MW and total generation. The names are given, so no distinct pass."""
    local = F.from_utc_timestamp("interval_start", cfg["market"]["timezone"])
    return (sced15.withColumn("month", month_label(local)).groupBy("month").pivot("resource_name", resources)
            .agg(F.max(ratio(F.col("hsl_mwh"), F.col("hours"))).alias("peak"), F.sum("gen_mwh").alias("gen")))


def wanted_locations(xwalk: DataFrame, cfg: dict) -> DataFrame:
    """Price locations the crosswalk and the hub comparisons need."""
    spark = xwalk.sparkSession
    fixed = spark.createDataFrame([(n,) for n in [cfg["market"]["hub"], *cfg["market"]["extra_locations"]]], "location string")
    nodes = xwalk.select(blank_to_null(F.col("ercot_settlement_point")).alias("location")).filter("location is not null")
    return nodes.union(fixed).distinct()


def locations_to_fetch(xwalk: DataFrame, recorded: DataFrame, cfg: dict) -> DataFrame:
    """Wanted price locations that are not recorded. Both sides are counted per location and met in one grouping, so the
    plan stays a hash aggregation whatever constants the inputs hold."""
    sides = wanted_locations(xwalk, cfg).withColumn("_w", F.lit(1)).unionByName(recorded.select("location", F.lit(0).alias("_w")))
    return sides.groupBy("location").agg(F.min("_w").alias("_w")).filter("_w = 1").select("location")
