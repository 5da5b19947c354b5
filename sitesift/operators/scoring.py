"""Offtake classes, banded and fleet-quantile points, sections, completeness, ranks, re-weighting."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bands import band, else_points, quantile_band, region_of
from ..functions.calendar import parse_end, years_left
from ..functions.nulls import is_true, ratio
from ..functions.text import percent_text
from ..session import cut_lineage
from .quantiles import group_quantiles, quantile_row

# Section → components, in published order.
SECTIONS = {"a": ["capture", "curtailment", "cf_benchmark", "offtake"], "b": ["poly", "monofacial", "tracker"],
            "c": ["acres", "headroom", "land_control"], "d": ["poi_kv", "dist_345", "load_pocket"],
            "e": ["lambda", "drill", "hours25", "water"], "f": ["fixed_cost"]}


# ---- offtake ---------------------------------------------------------------------------------------------------------------
def offtake_classify(table: DataFrame, cfg: dict, as_of: str, cod: DataFrame | None = None) -> DataFrame:
    """Adds class, end (published or assumed from the plant's first COD), years left, points and every doubt as a flag."""
    o = cfg["offtake"]
    df = table.join(cod.select("eia_id", F.col("cod_first").alias("_cod")), "eia_id", "left") if cod is not None else table.withColumn("_cod", F.lit(None).cast("date"))
    t = F.col("offtake_type")
    contract = is_true(t.isin("ppa", "hedge"))
    term = F.lit(None).cast("int")
    for kind, years in o["assumed_term_years"].items():
        term = F.when(t == kind, years).otherwise(term)
    assume = contract & F.col("contract_end").isNull() & F.col("_cod").isNotNull() & term.isNotNull()
    made = F.date_format(F.make_date(F.year("_cod") + term, F.month("_cod"), F.lit(1)), "yyyy-MM")
    given = F.coalesce("contract_end_basis", F.when(F.col("contract_end").isNotNull(), "published"))
    df = (df.withColumn("offtake_contract_end", F.when(assume, made).otherwise(F.col("contract_end")))
          .withColumn("offtake_end_basis", F.when(assume, "assumed").otherwise(given))
          .withColumn("offtake_years_left", years_left(parse_end(F.col("offtake_contract_end"), o["year_only_end_month"]), F.to_date(F.lit(as_of)))))
    y, ig = F.col("offtake_years_left"), F.coalesce("counterparty_ig", F.lit("unknown"))
    long = contract & (y >= o["short_years"])
    status = (F.when(t.isin("utility_owned", "affiliate", "merchant"), t).when(contract & (y <= 0), "merchant")
              .when(contract & (y < o["short_years"]), "short_contract").when(long & (ig == "yes"), "long_contract_ig")
              .when(long & (ig == "no"), "long_contract_non_ig").when(long, "long_contract_unknown_credit").otherwise("unknown"))
    pts = F.lit(None).cast("double")
    for name in ("merchant", "short_contract", "long_contract_ig", "long_contract_non_ig", "long_contract_unknown_credit", "utility_owned", "affiliate"):
        pts = F.when(F.col("offtake_status") == name, o[name]).otherwise(pts)
    near, short, share = o["flag_years_near_line"], o["short_years"], F.col("share_contracted")
    flags = [
        (t == "unknown", F.lit("no offtake found in public sources")),
        (F.col("offtake_end_basis") == "assumed", F.concat(F.lit("end not published: assumed COD + "), term.cast("string"), F.lit(" yr"))),
        (t == "affiliate", F.lit("affiliate offtake: priced in a sale, not a third-party contract")),
        (contract & (share < o["flag_share_below"]), F.concat(F.lit("only "), percent_text(share), F.lit(" of output publicly contracted"))),
        (contract & F.col("counterparty").rlike("(?i)unnamed|undisclosed"), F.lit("counterparty not named")),
        (contract & (y >= short) & (y < short + near), F.lit(f"crosses the {short:g}-yr line within {near} yr")),
        (contract & (y <= 0), F.lit("contract ended: scored merchant, a replacement may exist")),
        ((F.col("confidence") == "low") & (t != "unknown"), F.lit("low-confidence source")),
        (F.col("flag") != "", F.col("flag"))]
    text = F.array_join(F.array_compact(F.array(*[F.when(is_true(test), v) for test, v in flags])), "; ")
    return (df.withColumn("offtake_status", status).withColumn("offtake_pts", pts)
            .withColumn("offtake_expired", is_true(contract & (y <= 0))).withColumn("offtake_flags", F.when(text != "", text))
            .withColumnsRenamed({"counterparty": "offtake_counterparty", "counterparty_ig": "offtake_counterparty_ig", "share_contracted": "offtake_share_contracted",
                                 "source_url": "offtake_source_url", "source_date": "offtake_source_date", "confidence": "offtake_row_confidence"})
            .drop("_cod", "contract_end", "contract_end_basis", "flag"))


# ---- assembly -----------------------------------------------------------------------------------------------------------------
def assemble_wide(plants: DataFrame, *layers: DataFrame | None) -> DataFrame:
    """Pass and review plants with every layer's columns; a name already present wins."""
    df = plants.filter(F.col("filter_status").isin("pass", "review"))
    for lay in layers:
        if lay is not None:
            df = df.join(lay.select("eia_id", *[c for c in lay.columns if c not in df.columns]), "eia_id", "left")
    return df


# ---- points -------------------------------------------------------------------------------------------------------------------
def metric_points(df: DataFrame, comp: str, cfg: dict, step: float = 0.001) -> Column:
    """Capture or curtailment points over plants with usable metrics: fleet quantile cuts (scalar subqueries over the
    exact distributed quantiles) or fixed bands."""
    s, spec = cfg["scoring"], cfg["scoring"][comp]
    value = F.when(F.col("metrics_status") == "ok", F.col(spec["metric"]))
    if s["breakpoint_mode"] != "quantile":
        return band(value, spec["fixed"])
    names = {f"q{int(p * 100)}": p for p, _ in spec["quantile"]}
    cuts = quantile_row(df.filter("metrics_status = 'ok'"), spec["metric"], names, step)
    # one scalar for all cuts of a metric: the quantiles are computed once
    points = cuts.select(F.struct(*names).alias("cuts")).scalar()
    return quantile_band(value, [points[n] for n in names], spec)


def cf_benchmark(df: DataFrame, cfg: dict) -> DataFrame:
    """Capacity factor used, region, the region's benchmark (fixed or fleet median) and the points below it."""
    b = cfg["benchmarks"]
    sced = F.when(F.col("metrics_status") == "ok", F.col("sced_net_cf"))
    df = (df.withColumn("cf_used", F.coalesce(sced, F.col("net_ac_cf")))
          .withColumn("cf_source", F.when(sced.isNotNull(), "sced").when(F.col("net_ac_cf").isNotNull(), "eia923"))
          .withColumn("region", region_of(F.col("lat"), F.col("lon"), b)))
    med = group_quantiles(df.select("region", "cf_used"), ["region"], "cf_used", {"_med": 0.5}, 0.001)
    fixed = F.lit(None).cast("double")
    for region, v in b["regional_cf"].items():
        if v is not None:
            fixed = F.when(F.col("region") == region, float(v)).otherwise(fixed)
    return (df.join(med, "region", "left").withColumn("cf_benchmark", F.coalesce(fixed, F.col("_med"))).drop("_med")
            .withColumn("cf_below_benchmark_pts", (F.col("cf_benchmark") - F.col("cf_used")) * 100))


def repowering_points(cfg: dict) -> dict[str, Column]:
    r = cfg["scoring"]["repowering"]
    year, tech, trk = F.year("cod_first"), F.coalesce("module_tech", F.lit("")), F.col("tracking_type")
    vintage = F.when(year <= r["poly_until"], 1.0).when(year <= r["mixed_until"], 0.5).when(year.isNotNull(), 0.0)
    mono = F.when(tech.startswith("thin_film"), r["monofacial"]).otherwise(r["monofacial"] * vintage)
    mono = F.when(F.col("bifacial_share").isNotNull(), r["monofacial"] * (1 - F.col("bifacial_share"))).otherwise(mono)
    known = tech != ""
    tracker = (F.when(trk == "fixed", 1.0).when(trk.isin("single_axis", "dual_axis"), vintage)
               .when(trk == "mixed", (1.0 + F.coalesce(vintage, F.lit(0.0))) / 2))
    return {"poly": F.when(known, F.when(tech == "c-Si", r["poly"] * vintage).otherwise(0.0)), "monofacial": F.when(known, mono),
            "tracker": tracker * r["tracker"]}


def parcel_points(cfg: dict) -> dict[str, Column]:
    s = cfg["scoring"]
    ok = is_true(F.col("parcel_status") == "ok") & ~is_true(F.col("parcels_confidence") == "low")
    return {"acres": band(F.when(ok, F.col("acres_per_mw_parcel")), s["acres"]["bands"]),
            "headroom": band(F.when(ok, F.col("headroom_pct_unified")), s["headroom"]["bands"]),
            "land_control": F.when(ok, F.when(F.col("unified_land_control"), s["land_control"]["max"]).when(~F.col("unified_land_control"), 0.0))}


def electrical_points(cfg: dict) -> dict[str, Column]:
    """A null distance beside a present layer is a measured 'none within': the else band, not missing."""
    s = cfg["scoring"]
    lp = s["load_pocket"]
    near = lambda c: F.coalesce(band(F.col(c), lp["bands"]), F.lit(else_points(lp["bands"])))
    dist = F.coalesce(band(F.col("dist_345kv_sub_mi"), s["dist_345"]["bands"]), F.lit(else_points(s["dist_345"]["bands"])))
    pocket = F.greatest(near("dist_load_pocket_firm_mi"), near("dist_load_pocket_announced_mi") * lp["announced_factor"])
    return {"poi_kv": band(F.col("grid_voltage_kv"), s["poi_kv"]["bands"]),
            "dist_345": F.when(F.col("transmission_source").isNotNull(), dist),
            "load_pocket": F.when(F.col("load_pocket_source").isNotNull(), pocket)}


def thermal_points(cfg: dict) -> dict[str, Column]:
    s = cfg["scoring"]
    cols = {"lambda": "soil_lambda_w_mk", "drill": s["drill"]["metric"], "hours25": "hours_below_25c_drybulb", "water": "depth_to_water_ft"}
    return {k: band(F.col(v), s[k]["bands"]) for k, v in cols.items() if k != "lambda" or s["lambda"]["scored"]}


def fixed_cost(cfg: dict) -> dict[str, Column]:
    a = cfg["assumptions"]
    usd = F.lit(float(sum(a["fixed_cost_defaults_usd"].values()))) + F.coalesce(F.col("fiber_lateral_miles") * a["fiber_lateral_cost_per_mile_usd"], F.lit(0.0))
    per_kw = ratio(usd, F.col("firm_it_mw") * 1000)
    return {"fixed_cost_est_usd": usd, "fixed_cost_includes_fiber": F.col("fiber_lateral_miles").isNotNull(), "fixed_cost_per_kw_it": per_kw,
            "pts_fixed_cost": F.coalesce(band(per_kw, cfg["scoring"]["fixed_cost"]["bands"]), F.lit(0.0))}


# Every input a scoring row may lack, with its type.
INPUTS = {"metrics_status": "string", "capture_rate_potential": "double", "curtailment_pct": "double", "sced_net_cf": "double", "net_ac_cf": "double",
          "offtake_pts": "double", "cod_first": "date", "module_tech": "string", "tracking_type": "string", "bifacial_share": "double", "parcel_status": "string",
          "parcels_confidence": "string", "acres_per_mw_parcel": "double", "headroom_pct_unified": "double", "unified_land_control": "boolean",
          "grid_voltage_kv": "double", "transmission_source": "string", "dist_345kv_sub_mi": "double", "load_pocket_source": "string",
          "dist_load_pocket_firm_mi": "double", "dist_load_pocket_announced_mi": "double", "soil_lambda_w_mk": "double", "thick_hard_layer_share": "double",
          "hours_below_25c_drybulb": "double", "depth_to_water_ft": "double", "fiber_lateral_miles": "double", "firm_it_mw": "double", "tier": "string",
          "lat": "double", "lon": "double", "filter_status": "string"}


def component_max(cfg: dict) -> dict[str, float]:
    s, r = cfg["scoring"], cfg["scoring"]["repowering"]
    out = {"capture": s["capture"]["max"], "curtailment": s["curtailment"]["max"], "cf_benchmark": s["cf_benchmark"]["max"], "offtake": cfg["offtake"]["max"],
           "poly": r["poly"], "monofacial": r["monofacial"], "tracker": r["tracker"]}
    for k in ("acres", "headroom", "land_control", "poi_kv", "dist_345", "load_pocket"):
        out[k] = s[k]["max"]
    order = (["lambda"] if s["lambda"]["scored"] else []) + ["hours25", "drill", "water"]
    return out | {k: s[k]["max"] for k in order}


def score(wide: DataFrame, cfg: dict) -> DataFrame:
    """Points per component (missing ones at a neutral share of their maximum), sections, total, completeness, ranks."""
    s = cfg["scoring"]
    df = wide.withColumns({c: F.lit(None).cast(k) for c, k in INPUTS.items() if c not in wide.columns})
    # one row per plant, read by the fleet cuts, every component and three rank joins: written once instead of recomputed
    df = cut_lineage(cf_benchmark(df, cfg), "wide")
    pts = {"capture": metric_points(df, "capture", cfg), "curtailment": metric_points(df, "curtailment", cfg),
           "cf_benchmark": band(F.col("cf_below_benchmark_pts"), s["cf_benchmark"]["bands"]), "offtake": F.col("offtake_pts"),
           **repowering_points(cfg), **parcel_points(cfg), **electrical_points(cfg), **thermal_points(cfg)}
    maxes = component_max(cfg)
    df = cut_lineage(df.withColumns({f"_raw_{c}": pts[c] for c in maxes}), "points")
    raw = {c: F.col(f"_raw_{c}") for c in maxes}
    df = df.withColumns({f"pts_{c}": F.coalesce(raw[c], F.lit(m * s["missing_share"])) for c, m in maxes.items()} | fixed_cost(cfg))
    if "lambda" not in maxes:
        df = df.withColumn("pts_lambda", F.lit(None).cast("double"))
    real = sum((F.when(raw[c].isNotNull(), m).otherwise(0.0) for c, m in maxes.items()), F.lit(0.0))
    lost = F.array_join(F.array_compact(F.array(*[F.when(raw[c].isNull(), c) for c in maxes])), ";")
    df = df.withColumns({f"score_{k}": sum((F.coalesce(f"pts_{c}", F.lit(0.0)) for c in comps), F.lit(0.0)) for k, comps in SECTIONS.items()})
    df = (df.withColumn("score_total", sum((F.col(f"score_{k}") for k in SECTIONS), F.lit(0.0)))
          .withColumn("data_completeness", F.round(real / sum(maxes.values()), 3)).withColumn("missing_inputs", F.when(lost != "", lost))
          .withColumn("thermal_response_test_required", F.col("soil_lambda_w_mk") < s["lambda"]["test_flag_below"]))
    df = df.drop(*[f"_raw_{c}" for c in maxes]).withColumn("_ranked", is_true(F.col("filter_status").isin(s["rank_statuses"])))
    df = cut_lineage(df, "scored")
    return ranks(df, "score_total", "rank_overall", "rank_in_tier").drop("_ranked")


def ranks(df: DataFrame, value: str, overall: str, in_tier: str) -> DataFrame:
    """Descending ranks where _ranked holds, ties sharing the lowest. Ranks come from counts per distinct value: buckets
    of one point carry the totals above them, so no task orders the whole fleet."""
    r = df.filter("_ranked").select(F.round(value, 9).alias("_v"), F.col("tier").alias("_t"))
    cnt = r.groupBy("_t", "_v").agg(F.count(F.lit(1)).alias("_c"))
    out = df.filter("_ranked").withColumn("_v", F.round(value, 9))
    for name, by in ((overall, []), (in_tier, ["_t"])):
        per = cnt.groupBy(*by, "_v").agg(F.sum("_c").alias("_c")).withColumn("_b", F.floor("_v"))
        bins = per.groupBy(*by, "_b").agg(F.sum("_c").alias("_bc"))
        w = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_above", F.coalesce(F.sum("_bc").over(w), F.lit(0)))
        v = Window.partitionBy(*by, "_b").orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)
        placed = per.join(bins, [*by, "_b"]).select(*by, "_v", (F.col("_above") + F.coalesce(F.sum("_c").over(v), F.lit(0)) + 1).alias(name))
        if by:
            out = out.join(placed.filter("_t is not null").withColumnRenamed("_t", "tier"), ["tier", "_v"], "left")
        else:
            out = out.join(placed, "_v", "left")
    # rows without a rank keep out of the joins: they would all meet under one null key
    return out.drop("_v").unionByName(df.filter("not _ranked"), allowMissingColumns=True)


def reweight(df: DataFrame, weights: dict, cfg: dict, out: str = "score_custom") -> DataFrame:
    """Section scores rescaled to other maxima; weights are held to 0-100 and default to the section maximum."""
    mx = cfg["scoring"]["section_max"]
    clamp = lambda k: min(max(float(weights.get(k, mx[k])), 0.0), 100.0)
    return df.withColumn(out, sum((F.col(f"score_{k}") / mx[k] * clamp(k) for k in mx), F.lit(0.0)))


def weighted_rank(df: DataFrame, weights: dict, cfg: dict) -> DataFrame:
    r = reweight(df, weights, cfg).withColumn("_ranked", is_true(F.col("filter_status") == "pass"))
    return ranks(r, "score_custom", "rank_custom", "rank_custom_tier").drop("_ranked")
