"""Hourly climate and soil survey roll-ups."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import ratio, to_number
from ..functions.physics import soil_conductivity, wet_bulb_stull
from ..functions.text import percent_text
from .quantiles import group_quantiles

HOURS = 8760
# Source texts of the published layers.
CLIMATE_SOURCE = "nsrdb psm v4"
SOIL_SOURCE = "usda nrcs ssurgo via soil data access; lambda: cote & konrad (2005) at field capacity"


def published(x: Column, digits: int) -> Column:
    """A published figure: halves go to even. Sums of doubles depend on their order in the last bits, so what is a half on paper
    is first made one at nine digits."""
    return F.bround(F.round(x, 9), digits)


def year_stats(hourly: DataFrame, cfg: dict, keys=("point_id", "year")) -> DataFrame:
    """Hours below and above the thresholds per point and year: share of valid hours times 8,760."""
    c = cfg["layers"]["climate"]
    t, wb = F.col("temp_c"), wet_bulb_stull(F.col("temp_c"), F.col("rh_pct"))
    hours = lambda cond: F.avg(cond.cast("double")) * HOURS
    aggs = [hours(t < x).alias(f"below_{x}c_drybulb") for x in c["drybulb_below_c"]]
    aggs += [hours(wb < x).alias(f"below_{x}c_wetbulb") for x in c["wetbulb_below_c"]]
    aggs.append(hours(t > c["drybulb_above_c"]).alias(f"above_{c['drybulb_above_c']}c_drybulb"))
    pooled = [F.sum(t).alias("_t"), F.count(t).alias("_n"), F.max(t).alias("_mx")]
    return hourly.groupBy(*keys).agg(*aggs, *pooled)


def climate_summary(hourly: DataFrame, cfg: dict, typical: DataFrame | None = None, cells: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """Per point: mean of the years, worst year, pooled design percentiles, the list per year; hours of a typical year,
    the weather cell, source and confidence where those tables are given (typical: hourly rows of the typical year; cells:
    point_id, location_id, lat, lon, elevation_m; points: point_id, geometry_is_point). Halves round to even, as the
    published figures do."""
    c = cfg["layers"]["climate"]
    per = year_stats(hourly, cfg)
    names = [x for x in per.columns if x.startswith(("below_", "above_"))]
    b25 = F.col("below_25c_drybulb")
    item = F.struct("year", F.concat_ws(": ", F.col("year").cast("string"), published(b25, 0).cast("bigint").cast("string")).alias("t"))
    out = per.groupBy("point_id").agg(
        *[published(F.avg(n), 0).alias(f"hours_{n}") for n in names], published(F.min(b25), 0).alias("hours_below_25c_drybulb_min"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), "; ").alias("hours_below_25c_by_year"),
        published(ratio(F.sum("_t"), F.sum("_n")), 2).alias("mean_annual_temp_c"), published(F.max("_mx"), 1).alias("max_drybulb_c"),
        F.when(F.min("year") < F.max("year"), F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string")))
        .otherwise(F.min("year").cast("string")).alias("climate_years"))
    wet = hourly.withColumn("wb", wet_bulb_stull(F.col("temp_c"), F.col("rh_pct")))
    q = c["design_percentile"]
    dry = group_quantiles(wet, ["point_id"], "temp_c", {"_d": q}, 0.5).select("point_id", published(F.col("_d"), 1).alias("design_drybulb_0p4_c"))
    damp = group_quantiles(wet, ["point_id"], "wb", {"_w": q}, 0.5).select("point_id", published(F.col("_w"), 1).alias("design_wetbulb_0p4_c"))
    out = out.join(dry, "point_id", "left").join(damp, "point_id", "left")
    if typical is not None:
        t = year_stats(typical, cfg, ("point_id",)).select("point_id", published(F.col("below_25c_drybulb"), 0).alias("hours_below_25c_drybulb_tmy"))
        out = out.join(t, "point_id", "left")
    if cells is not None:
        out = out.join(cells.select("point_id", *[F.col(k).alias(f"nsrdb_{k}") for k in ("location_id", "lat", "lon", "elevation_m")]), "point_id", "left")
    if points is not None:
        out = out.join(points.select("point_id", F.when(F.col("geometry_is_point"), "low").otherwise("medium").alias("climate_confidence")), "point_id", "left")
    return out.withColumn("climate_source", F.lit(CLIMATE_SOURCE))


def horizon_depth_weight(horizons: DataFrame, cfg: dict) -> DataFrame:
    """Horizons → components: values weighted by thickness inside the depth; rows missing a driver are left out."""
    c = cfg["layers"]["soils"]
    h = horizons.withColumns({k: to_number(F.col(k)) for k in ("hzdept_r", "hzdepb_r", "sandtotal_r", "claytotal_r", "dbthirdbar_r", "wthirdbar_r", "comppct_r")})
    lam = soil_conductivity(F.col("sandtotal_r"), F.col("dbthirdbar_r"), F.col("wthirdbar_r"), c["model"])
    depth = F.lit(c["depth_cm"])
    w = F.greatest(F.least("hzdepb_r", depth) - F.least("hzdept_r", depth), F.lit(0.0))
    h = (h.dropna(subset=["hzdept_r", "hzdepb_r", "sandtotal_r", "dbthirdbar_r", "wthirdbar_r", "comppct_r"]).withColumn("w", w).filter("w > 0")
         .withColumns({"lam": lam["moist"], "lam_dry": lam["dry"], "lam_sat": lam["sat"]}))
    vals = ["lam", "lam_dry", "lam_sat", "sandtotal_r", "claytotal_r", "dbthirdbar_r", "wthirdbar_r"]
    return h.groupBy("mukey", "cokey", "compname", "muname", "comppct_r").agg(*[(F.sum(F.col(v) * F.col("w")) / F.sum("w")).alias(v) for v in vals])


def soil_rollup(mapunits: DataFrame, components: DataFrame, restrictions: DataFrame, cfg: dict, bedrock: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """Per site: area-weighted soil figures. mapunits: eia_id, mukey, a; components: horizon_depth_weight output; bedrock:
    mukey, brockdepmin; points: eia_id, geometry_is_point. Sites without soil data keep their row: status, number of map
    units and a data share of zero, everything else null. Halves round to even, as the published figures do."""
    c = cfg["layers"]["soils"]
    tot = mapunits.groupBy("eia_id").agg(F.sum(F.coalesce("a", F.lit(0.0))).alias("_tot"), F.count(F.lit(1)).alias("n_mapunits"))
    mu = mapunits.join(tot, "eia_id").withColumn("share", F.when(F.col("_tot") > 0, F.coalesce("a", F.lit(0.0)) / F.col("_tot")).otherwise(1.0 / F.col("n_mapunits")))
    comp = mu.join(components, "mukey").withColumn("w", F.col("share") * F.col("comppct_r") / 100.0)
    avg = lambda v, d: published(F.sum(F.col(v) * F.col("w")) / F.sum("w"), d)
    figures = {"soil_lambda_w_mk": ("lam", 3), "soil_lambda_dry_w_mk": ("lam_dry", 3), "soil_lambda_sat_w_mk": ("lam_sat", 3), "soil_sand_pct": ("sandtotal_r", 1),
               "soil_clay_pct": ("claytotal_r", 1), "soil_bulk_density": ("dbthirdbar_r", 2), "soil_theta_fc": ("wthirdbar_r", 1)}
    out = comp.groupBy("eia_id").agg(F.sum("w").alias("_w"), *[avg(v, d).alias(k) for k, (v, d) in figures.items()]).filter("_w > 0")
    names = comp.groupBy("eia_id", "compname").agg(F.sum("w").alias("m"))
    dom = names.groupBy("eia_id").agg(F.min_by(F.struct("compname", "m"), F.struct(-F.round("m", 9), F.col("compname"))).alias("d"))
    dom = dom.select("eia_id", F.concat(F.col("d.compname"), F.lit(" ("), percent_text(F.round("d.m", 9)), F.lit(")")).alias("dominant_soil"))
    unit_name = components.groupBy("mukey").agg(F.min("muname").alias("muname"))
    largest = mu.groupBy("eia_id").agg(F.min_by("mukey", F.struct(-F.round("share", 9), F.col("mukey"))).alias("mukey"))
    dmu = largest.join(unit_name, "mukey", "left").select("eia_id", F.col("muname").alias("dominant_mapunit"))
    r = (mu.join(restrictions.select("mukey", "cokey", F.coalesce(F.col("comppct_r"), F.lit(0.0)).alias("pct"), "reskind", "resdept_r"), "mukey")
         .filter(F.coalesce("resdept_r", F.lit(0.0)) < c["depth_cm"]))
    once = r.groupBy("eia_id", "cokey").agg(F.max(F.col("share") * F.col("pct") / 100).alias("s"), F.min("resdept_r").alias("d"))
    rs = once.groupBy("eia_id").agg(published(F.sum("s"), 3).alias("restriction_share"), F.min("d").alias("restriction_min_depth_cm"))
    # the kinds of restrictive layers are a short list of survey terms
    kinds = r.filter("reskind is not null").groupBy("eia_id").agg(F.array_join(F.array_sort(F.collect_set("reskind")), "; ").alias("restriction_kinds"))
    found = out.join(dom, "eia_id", "left").join(dmu, "eia_id", "left").join(rs, "eia_id", "left").join(kinds, "eia_id", "left")
    found = found.withColumn("restriction_share", F.coalesce("restriction_share", F.lit(0.0)))
    if bedrock is not None:
        rock = mu.join(bedrock.select("mukey", to_number(F.col("brockdepmin")).alias("b")), "mukey").groupBy("eia_id").agg(F.min("b").alias("bedrock_depth_cm_min"))
        found = found.join(rock, "eia_id", "left")
    df = (mapunits.select("eia_id").distinct().join(tot.drop("_tot"), "eia_id").join(found, "eia_id", "left")
          .withColumn("soil_status", F.when(F.col("_w").isNotNull(), "ok").otherwise("no_soil_data"))
          .withColumn("soil_data_share", published(F.coalesce("_w", F.lit(0.0)), 3)).drop("_w").withColumn("soil_source", F.lit(SOIL_SOURCE)))
    if points is not None:
        sure = (F.col("soil_status") == "ok") & (F.col("soil_data_share") >= c["min_data_share_medium"]) & ~F.coalesce("geometry_is_point", F.lit(True))
        df = df.join(points.select("eia_id", "geometry_is_point"), "eia_id", "left").withColumn("soil_confidence", F.when(sure, "medium").otherwise("low")).drop("geometry_is_point")
    return df
