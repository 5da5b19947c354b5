"""Tables the ranking page, map, dossier and exports read."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import days_in_month
from ..functions.nulls import is_true
from ..session import cut_lineage
from .quantiles import group_quantiles, quantile_row
from .scoring import weighted_rank


def wide_export(plants: DataFrame, *parts: DataFrame) -> DataFrame:
    """Pass and review plants with scores and layers, earlier tables winning a name; ranked first, then by score."""
    df = plants.filter(F.col("filter_status").isin("pass", "review"))
    for p in parts:
        df = df.join(p.select("eia_id", *[c for c in p.columns if c not in df.columns]), "eia_id", "left")
    return df.orderBy(F.col("rank_overall").asc_nulls_last(), F.col("score_total").desc())


def monthly_export(monthly: DataFrame, plants: DataFrame, coverage: float = 0.9) -> DataFrame:
    full = F.col("days") / days_in_month(F.col("month")) >= coverage
    return monthly.join(plants.select("eia_id", "plant_name"), "eia_id", "left").withColumn("full_month", full).orderBy("plant_name", "month")


def search_filter(df: DataFrame, tiers: list[str], statuses: list[str], text: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "plant_name", F.coalesce("county", F.lit("")), F.coalesce("operator", F.lit(""))))
    return df.filter(is_true(F.col("tier").isin(tiers)) & F.col("filter_status").isin(statuses) & hay.contains(text.strip().lower()))


def score_bin(score: Column) -> Column:
    return (F.when(score < 40, "< 40").when(score < 50, "40–50").when(score < 60, "50–60").when(score < 70, "60–70").when(score >= 70, "≥ 70"))


def caveats(df: DataFrame) -> DataFrame:
    """Seven caveats per plant with their status, one row each."""
    west = is_true(F.col("region") == "west_texas")
    on = lambda c, yes, no: F.when(is_true(F.col(c)), yes).otherwise(no)
    items = [("Load import capability", F.lit("applies")), ("SB6 large-load risk", on("sb6_review_required", "required", "applies")),
             ("Mineral estate", F.when(west, "required").otherwise("check")), ("Behind-the-meter configuration", F.lit("applies")),
             ("Chapter 313 / JETI abatement", F.lit("check")), ("Tax-equity consent", on("tax_equity_consent_likely", "applies", "not flagged")),
             ("ITC recapture window", on("itc_recapture_open", "applies", "not flagged"))]
    rows = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("title"), s.alias("status")) for i, (t, s) in enumerate(items, 1)])
    return df.select("eia_id", F.explode(rows).alias("c")).select("eia_id", "c.n", "c.title", "c.status")


def dossier(df: DataFrame, monthly: DataFrame, layers: dict[str, DataFrame], eia_id: int) -> DataFrame:
    """One plant with its months and each layer as nested columns. The months are one plant's, a few dozen."""
    one = df.filter(F.col("eia_id") == eia_id)
    months = monthly.filter(F.col("eia_id") == eia_id).groupBy("eia_id").agg(F.array_sort(F.collect_list(F.struct("month", *[c for c in monthly.columns if c not in ("eia_id", "month")]))).alias("months"))
    out = one.join(months, "eia_id", "left")
    for name, lay in layers.items():
        out = out.join(lay.filter(F.col("eia_id") == eia_id).select("eia_id", F.struct(*[c for c in lay.columns if c != "eia_id"]).alias(name)), "eia_id", "left")
    return out


def running_total(df: DataFrame, order: list[Column], amount: Column, out: str) -> DataFrame:
    """Every row with the sum of `amount` up to it in the order. Rows are dealt by range and summed per part; only those sums,
    one per part, meet in one place. `order` should end in a key, so that equal rows do not crowd one part."""
    rows = cut_lineage(df.withColumn("_amount", amount).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.sum("_amount").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("_at", F.sum("_amount").over(inside)).join(parts.select("_part", "_before"), "_part")
            .withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before", "_amount"))


def positions(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """Every row with its place in the order, 1 first."""
    return running_total(df, order, F.lit(1), out)


def ranked_order(rank: str = "rank_overall", score: str = "score_total") -> list[Column]:
    """By rank, then by score (sums of the same points may differ in their last bits, so nine digits count), then by id."""
    return [F.col(rank).asc_nulls_last(), F.round(F.col(score), 9).desc_nulls_last(), F.col("eia_id").asc()]


def ranked_export(plants: DataFrame, scores: DataFrame, layers: list[DataFrame], weights: dict | None, cfg: dict) -> DataFrame:
    """One wide row per pass or review plant with its position; other weights than the defaults add score_custom and
    rank_custom (pass plants only) and order by them."""
    wide = plants.filter(F.col("filter_status").isin("pass", "review"))
    for part in (scores, *layers):
        wide = wide.join(part.select("eia_id", *[c for c in part.columns if c not in wide.columns]), "eia_id", "left")
    mx = cfg["scoring"]["section_max"]
    if not weights or all(float(weights.get(k, m)) == float(m) for k, m in mx.items()):
        return positions(wide, ranked_order())
    custom = weighted_rank(wide, weights, cfg).drop("rank_custom_tier")
    return positions(custom, ranked_order("rank_custom", "score_custom"))


def ranked_grid(plants: DataFrame, scores: DataFrame, flood: DataFrame) -> DataFrame:
    """Plants with their scores and flood flags; plants without either keep their row."""
    return plants.join(scores.drop("plant_name"), "eia_id", "left").join(flood.select("eia_id", "flood_status", "flood_flag"), "eia_id", "left")


def grid_totals(grid: DataFrame) -> DataFrame:
    """Count and MW of what a filter left: one row."""
    return grid.agg(F.count(F.lit(1)).alias("n_plants"), F.sum("ac_mw").alias("ac_mw"))


def full_months(monthly: DataFrame, coverage: float = 0.9) -> DataFrame:
    """Per plant: months covered in full and months left out."""
    full = F.coalesce(F.col("days") / days_in_month(F.col("month")) >= coverage, F.lit(False))
    return monthly.groupBy("eia_id").agg(F.count_if(full).alias("n_full"), F.count_if(~full).alias("n_excluded"))


def peak_warning(df: DataFrame, below: float = 0.75) -> DataFrame:
    return df.withColumn("peak_warning", is_true(F.col("peak_hsl_ratio_recent") < below))


def monthly_of_published(monthly: DataFrame, published: DataFrame) -> DataFrame:
    """Monthly rows of published plants only."""
    return monthly.join(published.select("eia_id"), "eia_id", "left_semi")


# ---- reports --------------------------------------------------------------------------------------------------------
def top_report(scores: DataFrame, county: str, first: int = 25) -> DataFrame:
    """(list, eia_id, rank, score_total): the first ranked plants, each tier's ranked plants, one county's plants."""
    pick = lambda df, name, rank: df.select(F.lit(name).alias("list") if isinstance(name, str) else name.alias("list"), "eia_id", F.col(rank).alias("rank"), "score_total")
    ranked = scores.filter("rank_overall is not null")
    top = ranked.orderBy("rank_overall", "eia_id").limit(first)  # the report's own length
    return (pick(top, "top", "rank_overall").unionByName(pick(ranked.filter("rank_in_tier is not null"), F.col("tier"), "rank_in_tier"))
            .unionByName(pick(scores.filter(F.col("county").contains(county)), "county", "rank_overall")))


def score_report(scores: DataFrame) -> DataFrame:
    """One row: plants ranked and unranked, spread of the total, median completeness."""
    ranked = scores.filter("rank_overall is not null")
    n = scores.agg(F.count("rank_overall").alias("n_ranked"), F.count_if(F.col("rank_overall").isNull()).alias("n_unranked"))
    total = quantile_row(ranked, "score_total", {"total_min": 0.0, "total_median": 0.5, "total_max": 1.0}, 1.0)
    data = quantile_row(ranked, "data_completeness", {"completeness_median": 0.5}, 0.01)
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(n).join(one(total), "_k", "left").join(one(data), "_k", "left").drop("_k")


MARKET_METRICS = ("capture_rate", "capture_rate_potential", "shape_capture", "basis_ratio", "curtailment_pct", "sced_net_cf", "sced_potential_cf")


def market_report(summary: DataFrame) -> DataFrame:
    """(metric, n, min, q25, median, q75, max) over plants with usable metrics."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in MARKET_METRICS])
    long = summary.filter("metrics_status = 'ok'").select(F.explode(items).alias("i")).select("i.metric", "i.v").filter("v is not null")
    q = group_quantiles(long, ["metric"], "v", {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}, 0.01)
    return q.join(long.groupBy("metric").agg(F.count(F.lit(1)).alias("n")), "metric")


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def crosswalk_report(xwalk: DataFrame) -> DataFrame:
    """(match_confidence, n_plants, n_verified, n_rows) with a plant's lowest resource deciding its confidence."""
    per = xwalk.groupBy("eia_plant_id").agg(
        F.min_by("match_confidence", F.coalesce("ercot_resource_name", F.lit(""))).alias("match_confidence"),
        F.coalesce(F.max(F.trim("verified_by") != ""), F.lit(False)).alias("v"), F.count(F.lit(1)).alias("r"))
    return per.groupBy("match_confidence").agg(F.count(F.lit(1)).alias("n_plants"), F.count_if("v").alias("n_verified"), F.sum("r").alias("n_rows"))


def layer_report(layer: DataFrame, plants: DataFrame, county: str | None = None, digits: int = 1) -> DataFrame:
    """A layer beside the identity of its plants; plants without the layer are left out, numbers rounded for reading."""
    who = plants.select("eia_id", "plant_name", "county", "tier", "ac_mw")
    if county is not None:
        who = who.filter(F.lower(F.coalesce("county", F.lit(""))) == county.lower())
    cols = [c for c in layer.columns if c != "eia_id" and c not in who.columns]
    out = who.join(layer.select("eia_id", *cols), "eia_id")
    return out.select(*[F.bround(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in out.dtypes])


def county_handcheck(plants: DataFrame, orphans: DataFrame, county: str) -> DataFrame:
    """(section, key, n, ac_mw, value) of one county: totals, statuses, matched polygons, orphans, capacity factors."""
    key = county.strip().lower()
    p = plants.filter(F.lower(F.trim(F.coalesce("county", F.lit("")))) == key)
    o = orphans.filter(F.lower(F.trim(F.coalesce("p_county", F.lit("")))).startswith(key))
    row = lambda df, section, k, n, mw, value: df.agg(n.alias("n"), mw.alias("ac_mw"), value.alias("value")).select(F.lit(section).alias("section"), F.lit(k).alias("key"), "n", "ac_mw", "value")
    none, mw, every = F.lit(None).cast("double"), F.sum("ac_mw"), F.count(F.lit(1))
    statuses = p.groupBy("filter_status").agg(every.alias("n"), mw.alias("ac_mw")).select(F.lit("status").alias("section"), F.col("filter_status").alias("key"), "n", "ac_mw", none.alias("value"))
    cf = p.filter("filter_status <> 'fail' and net_ac_cf is not null")
    spread = group_quantiles(cf.withColumn("_g", F.lit(1)), ["_g"], "net_ac_cf", {"min": 0.0, "median": 0.5, "max": 1.0}, 0.01)
    spread = spread.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("min", "median", "max")])).alias("e"))
    return (row(p, "total", "plants", every, mw, none).unionByName(row(p.filter("uspvdb_match"), "total", "matched", every, mw, none))
            .unionByName(row(o, "total", "orphans", every, none, none)).unionByName(statuses)
            .unionByName(spread.select(F.lit("capacity factor").alias("section"), "e.key", F.lit(None).cast("long").alias("n"), none.alias("ac_mw"), "e.value")))
