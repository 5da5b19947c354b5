"""Hard and soft rules that keep every reason, tiers, derived loads and flags."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import tier_of
from ..functions.nulls import is_true, ratio


def _text(n) -> str:
    return str(int(n)) if float(n).is_integer() else str(n)


def reasons(rules) -> Column:
    """Array of the texts of the rules that hold, in rule order; an unknown (null) comparison does not hold."""
    return F.array_compact(F.array(*[F.when(is_true(test), F.lit(text)) for test, text in rules]))


def footprint_on_parcel(columns, cfg: dict) -> Column:
    """Judge on parcel area only where parcels were read well; an unknown basis is an error."""
    basis = cfg["hard_filters"]["footprint_basis"]
    if basis not in ("array_flag", "parcel"):
        raise ValueError(f"unknown footprint basis {basis!r}: array_flag and parcel are known")
    if basis == "array_flag" or "parcel_status" not in columns:
        return F.lit(False)
    return is_true(F.col("parcel_status") == "ok") & ~is_true(F.col("parcels_confidence") == "low")


def apply_filters(df: DataFrame, cfg: dict, as_of: str) -> DataFrame:
    """Status (fail > review > pass), reasons, tier, planned load and flags. All row-local: no shuffle."""
    hf, a = cfg["hard_filters"], cfg["assumptions"]
    cols = set(df.columns)
    num = lambda c: F.col(c) if c in cols else F.lit(None).cast("double")
    ac, first, last = F.col("ac_mw"), F.col("cod_first"), F.col("cod_last")
    df = (df.withColumn("dc_mw", F.coalesce("dc_mw_eia", "dc_mw_uspvdb"))
          .withColumn("dc_mw_source", F.when(F.col("dc_mw_eia").isNotNull(), "eia860m")
                      .when(F.col("dc_mw_uspvdb").isNotNull(), "uspvdb").otherwise("ilr_default"))
          .withColumn("ilr", F.when(F.col("dc_mw").isNotNull(), ratio(F.col("dc_mw"), ac)).otherwise(a["ilr_default"]))
          .withColumn("ilr_confidence", F.when(F.col("dc_mw_source") == "ilr_default", "assumed").otherwise("reported"))
          .withColumn("acres_per_mw_ac", ratio(F.col("array_acres"), ac))
          .withColumn("_on_parcel", footprint_on_parcel(cols, cfg)))
    on, off = F.col("_on_parcel"), ~F.col("_on_parcel")
    lo, hi = F.to_date(F.lit(hf["cod_from"])), F.to_date(F.lit(hf["cod_to"]))
    acres, per_mw = hf["min_acres"], hf["min_acres_per_mw_ac"]
    hard = reasons([
        (ac < hf["min_ac_mw"], f"ac_mw<{_text(hf['min_ac_mw'])}"),
        (first.isNull(), "cod_missing"),
        (first < lo, f"cod<{hf['cod_from']}"),
        (first > hi, f"cod>{hf['cod_to']}"),
        (on & (num("parcel_acres_host") < acres), f"acres<{_text(acres)}"),
        (on & (num("acres_per_mw_parcel") < per_mw), f"acres_per_mw<{_text(per_mw)}")])
    soft = reasons([
        (off & (F.col("array_acres") < acres), f"array_acres<{_text(acres)}"),
        (off & (F.col("acres_per_mw_ac") < per_mw), f"array_acres_per_mw<{_text(per_mw)}"),
        (off & F.col("array_acres").isNull(), "no_uspvdb_polygon")])
    df = df.withColumn("_hard", hard).withColumn("_soft", soft)
    firm = ac * F.col("ilr") * a["it_mw_per_mwdc"]
    return (df
            .withColumn("footprint_basis", F.when(on, "parcel").otherwise("array_flag"))
            .withColumn("non_ercot_texas", F.coalesce(F.col("ba_code"), F.lit("")) != cfg["inventory"]["home_ba_code"])
            .withColumn("ercot_flag", ~F.col("non_ercot_texas"))
            .withColumn("filter_reasons", F.array_join(F.concat("_hard", "_soft"), ";"))
            .withColumn("filter_status", F.when(F.size("_hard") > 0, "fail").when(F.size("_soft") > 0, "review")
                        .otherwise("pass"))
            .withColumn("tier", tier_of(ac, cfg))
            .withColumn("firm_it_mw", firm)
            .withColumn("planned_load_mw", F.col("firm_it_mw") * a["pue_assumed"])
            .withColumn("sb6_review_required", is_true(F.col("planned_load_mw") >= cfg["large_load_threshold_mw"]))
            .withColumn("tax_equity_consent_likely", is_true(F.year(first) >= 2019))
            .withColumn("itc_recapture_open", is_true(last > F.add_months(F.to_date(F.lit(as_of)), -60)))
            .withColumn("ac_mw_delta_pct", ratio(F.col("ac_mw_uspvdb") - ac, ac))
            .withColumn("acres_calc_delta_pct", ratio(F.col("array_acres_calc") - F.col("array_acres"), F.col("array_acres")))
            .withColumn("module_type_confidence", F.lit("proxy"))
            .drop("_hard", "_soft", "_on_parcel"))


def parcel_decided_fails(status: Column, reason_text: Column) -> Column:
    """Failed on parcel acreage and on nothing else."""
    parts = F.filter(F.split(F.coalesce(reason_text, F.lit("")), ";"), lambda x: x != "")
    only = F.forall(parts, lambda x: x.startswith("acres<") | x.startswith("acres_per_mw<"))
    return is_true(status == "fail") & (F.size(parts) > 0) & only


def error_rows(df: DataFrame, rules, tag: Column) -> DataFrame:
    """One row per violated rule: (tag, problem)."""
    return (df.select(tag.alias("tag"), F.explode(reasons(rules)).alias("problem")))
