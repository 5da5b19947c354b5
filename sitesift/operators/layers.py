"""Layers measured around each site by distance: lines and substations, gas lines, fibre corridors, load projects,
coverage cells, wells.

Each takes ids (eia_id, lat, lon, geometry_is_point, ...), shapes for the proximity joins and feature tables, and returns
one row per id: nulls beyond the search radius, sources, dates and confidence beside every figure.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..functions.bands import band
from ..functions.nulls import is_true, one_of, to_number
from ..functions.text import label_map
from ..session import cut_lineage
from . import proximity as px
from .rollup import latest_per_key


def _mi(cfg) -> float:
    return cfg["units"]["m_per_mi"]


def provenance(df: DataFrame, prefix: str, source: str, fetched: str, radius: float | None = None,
               confidence: Column | None = None) -> DataFrame:
    """Source, date, radius and confidence columns: low for sites known only as a point, medium otherwise."""
    if confidence is None:
        confidence = F.when(F.col("geometry_is_point"), "low").otherwise("medium")
    if radius is not None:
        df = df.withColumn(f"{prefix}_search_mi", F.lit(radius))
    return (df.withColumn(f"{prefix}_source", F.lit(source)).withColumn(f"{prefix}_fetched", F.lit(fetched))
            .withColumn(f"{prefix}_confidence", confidence))


def _nearest(ids, sites, feats, radius_mi, fid, renames, dist, cfg, points_only):
    near = px.nearest_features(sites, feats, radius_mi * _mi(cfg), fid, list(renames), points_only=points_only)
    return px.nearest_with_radius(ids, near, dist, renames, _mi(cfg))


# ---- transmission --------------------------------------------------------------------------------------------------------
def line_classes_near(ids: DataFrame, sites: DataFrame, segments: DataFrame, cfg: dict) -> DataFrame:
    """Voltage classes and highest voltage on lines near the site, and whether the POI voltage is among them (unknown
    below the mapped range). Pairs reduce to one flag per class before the shuffle."""
    c = cfg["layers"]["transmission"]
    tol, classes = c["class_tolerance"], c["kv_classes"]
    pairs = px.within_pairs(sites, segments, c["near_miles"] * _mi(cfg), "feature_id", points_only=False)
    kv = F.col("voltage_kv")
    seen = pairs.groupBy("eia_id").agg(F.max(kv).alias("max_kv_within_near"),
                                       *[F.max(F.abs(kv - k) <= k * tol).alias(f"_k{k}") for k in classes])
    out = ids.select("eia_id", "grid_voltage_kv").join(seen, "eia_id", "left")
    text = F.concat_ws(";", *[F.when(F.col(f"_k{k}"), F.lit(str(k))) for k in classes])
    poi = F.col("grid_voltage_kv")
    hit = F.lit(False)
    for k in classes:
        hit = hit | (is_true(F.col(f"_k{k}")) & (F.abs(F.lit(float(k)) - poi) <= poi * tol))
    return out.select("eia_id", F.when(text != "", text).alias("kv_classes_within_near"), "max_kv_within_near",
                      F.when(poi >= c["min_kv"], hit).alias("poi_kv_seen"))


def transmission(ids: DataFrame, sites: DataFrame, segments: DataFrame, substations: DataFrame, cfg: dict, source: str,
                 fetched: str) -> DataFrame:
    c = cfg["layers"]["transmission"]
    r = c["search_radius_mi"]
    sub = _nearest(ids, sites, substations.filter("voltage_kv >= 345"), r, "feature_id", {"name": "nearest_345kv_sub_name"},
                   "dist_345kv_sub_mi", cfg, True)
    l345 = _nearest(ids, sites, segments.filter("voltage_kv >= 345"), r, "feature_id", {}, "dist_345kv_line_mi", cfg, False)
    l138 = _nearest(ids, sites, segments.filter("voltage_kv >= 138"), r, "feature_id", {}, "dist_138kv_line_mi", cfg, False)
    out = (ids.select("eia_id", "geometry_is_point").join(sub, "eia_id").join(l345, "eia_id").join(l138, "eia_id")
           .join(line_classes_near(ids, sites, segments, cfg), "eia_id"))
    return provenance(out, "transmission", source, fetched, r).drop("geometry_is_point")


# ---- gas -----------------------------------------------------------------------------------------------------------------
def gas_in_service(lines: DataFrame, cfg: dict) -> DataFrame:
    c = cfg["layers"]["gas_pipelines"]
    return lines.filter((F.col("status") == c["status"]) & F.col("commodity_description").isin(c["commodities"]))


def is_gas_transmission(system_type: Column, cfg: dict) -> Column:
    s, out = F.lower(F.trim(F.coalesce(system_type, F.lit("")))), F.lit(False)
    for p in cfg["layers"]["gas_pipelines"]["transmission_prefixes"]:
        out = out | s.startswith(p.lower())
    return out


def diameter(col: Column) -> Column:
    v = to_number(col)
    return F.when(v > 0, v)


def gas_pipelines(ids: DataFrame, sites: DataFrame, segments: DataFrame, cfg: dict, fetched: str) -> DataFrame:
    """segments: feature_id, operator, system_name, system_type, diameter_in, interstate, x1..y2."""
    c = cfg["layers"]["gas_pipelines"]
    r = c["search_radius_mi"]
    tx = segments.filter(is_gas_transmission(F.col("system_type"), cfg))
    near = _nearest(ids, sites, tx, r, "feature_id",
                    {"operator": "gas_transmission_operator", "system_name": "gas_transmission_system",
                     "diameter_in": "gas_transmission_diameter_in", "interstate": "gas_transmission_interstate"},
                    "dist_gas_transmission_mi", cfg, False)
    anyline = _nearest(ids, sites, segments, r, "feature_id", {}, "dist_gas_any_mi", cfg, False)
    pairs = px.within_pairs(sites, tx.select("feature_id", "diameter_in", "x1", "y1", "x2", "y2"),
                            c["near_miles"] * _mi(cfg), "feature_id", points_only=False)
    count = pairs.groupBy("eia_id").agg(F.countDistinct("feature_id").alias("_n"),
                                        F.max("diameter_in").alias("max_gas_transmission_diameter_near_in"))
    out = (ids.select("eia_id", "geometry_is_point").join(near, "eia_id").join(anyline, "eia_id").join(count, "eia_id", "left")
           .withColumn("n_gas_transmission_near", F.coalesce(F.col("_n"), F.lit(0))).drop("_n"))
    return provenance(out, "gas", "rrc qpipelines (layer 12)", fetched, r).drop("geometry_is_point")


# ---- fibre corridors -----------------------------------------------------------------------------------------------------
def carrier_hotels(ids: DataFrame, cfg: dict) -> DataFrame:
    """Nearest of the configured hotels by great circle, route and round-trip estimates, and the list of all."""
    c = cfg["layers"]["fiber"]
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    per = [F.struct(geo.great_circle_mi(F.col("lat"), F.col("lon"), F.lit(la), F.lit(lo), c["earth_mi"]).alias("mi"),
                    F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(n.split(" (")[0]).alias("short"))
           for i, (n, la, lo) in enumerate(c["hotels"])]
    rtt = lambda mi: mi * c["route_factor"] * c["rtt_ms_per_route_mile"]
    df = ids.select("eia_id", "lat", "lon").withColumn("_h", F.when(known, F.array(*per)))
    best = F.array_min("_h")
    text = F.array_join(F.transform("_h", lambda h: F.format_string("%s ~%.1f ms", h["short"], rtt(h["mi"]))), "; ")
    return df.select("eia_id", best["name"].alias("nearest_carrier_hotel"), best["mi"].alias("carrier_hotel_gc_mi"),
                     (best["mi"] * c["route_factor"]).alias("carrier_hotel_route_mi_est"), rtt(best["mi"]).alias("latency_rtt_ms_est"),
                     text.alias("carrier_hotel_rtt_ms"))


def corridor(df: DataFrame, rail: str = "dist_class1_rail_mi", road: str = "dist_interstate_mi") -> DataFrame:
    """Shorter of the two corridors (rail on a tie) and which it is; both unknown → null."""
    a, b = F.col(rail), F.col(road)
    which = (F.when(a.isNull() & b.isNull(), None)
             .when(a.isNotNull() & (b.isNull() | (a <= b)), "rail").otherwise("interstate"))
    return df.withColumn("fiber_lateral_miles", F.least(a, b)).withColumn("fiber_corridor", which)


def rail_in_scope(rail: DataFrame, cfg: dict) -> DataFrame:
    c = cfg["layers"]["fiber"]
    return rail.filter(F.col("rrowner1").isin(c["rail_owners"]) & F.col("net").isin(c["rail_net"]))


def fiber(ids: DataFrame, sites: DataFrame, rail: DataFrame, roads: DataFrame, cfg: dict, fetched: str) -> DataFrame:
    r = cfg["layers"]["fiber"]["search_radius_mi"]
    a = _nearest(ids, sites, rail, r, "feature_id", {"rrowner1": "nearest_rail_owner", "subdiv": "nearest_rail_subdiv"},
                 "dist_class1_rail_mi", cfg, False)
    b = _nearest(ids, sites, roads, r, "feature_id", {"ref": "nearest_interstate"}, "dist_interstate_mi", cfg, False)
    out = corridor(a.join(b, "eia_id")).join(carrier_hotels(ids, cfg), "eia_id", "left")
    return provenance(out, "fiber", "proxy: ntad class I mainline + osm interstates; peeringdb carrier hotels", fetched, r, F.lit("low"))


# ---- load projects -------------------------------------------------------------------------------------------------------
def qualifying_projects(projects: DataFrame, cfg: dict) -> DataFrame:
    """Live and located, and a data centre of any size or another kind with enough load (unknown load is not enough)."""
    c = cfg["layers"]["load_pocket"]
    live = F.col("status").isin(c["statuses_firm"] + c["statuses_announced"])
    big = (F.col("kind") == "data_center") | (F.col("load_mw") >= c["min_load_mw_non_dc"])
    return projects.filter(live & is_true(big) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def driving_location(firm_pts: Column, ann_pts: Column, firm_loc: Column, ann_loc: Column) -> Column:
    zero = F.lit(0.0)
    return F.when(F.coalesce(firm_pts, zero) >= F.coalesce(ann_pts, zero), firm_loc).otherwise(ann_loc)


def project_list(sites: DataFrame, projects: DataFrame, cfg: dict) -> DataFrame:
    """Count, load and one text of all qualifying projects within the radius, nearest first. The text is the result asked
    for; its source is a hand-kept table."""
    c = cfg["layers"]["load_pocket"]
    mi = F.col("d") / _mi(cfg)
    pairs = px.within_features(sites, px.feature_points(projects).select("project_id", "name", "status", "load_mw", "x1", "y1", "x2", "y2"),
                               c["search_radius_mi"] * _mi(cfg), "project_id")
    load = F.when(F.col("load_mw").isNotNull(), F.concat(F.bround("load_mw", 0).cast("bigint").cast("string"), F.lit(" MW, "))).otherwise("")
    text = F.concat(F.col("name"), F.lit(" ("), F.col("status"), F.lit(", "), load, F.format_string("%.1f mi)", mi))
    return pairs.groupBy("eia_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("load_mw").alias("mw"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "project_id", text.alias("t")))), lambda s: s["t"]), "; ").alias("txt"))


def load_pocket(ids: DataFrame, sites: DataFrame, projects: DataFrame, cfg: dict, table: str, table_date: str) -> DataFrame:
    c, sc = cfg["layers"]["load_pocket"], cfg["scoring"]["load_pocket"]
    r = c["search_radius_mi"]
    q = qualifying_projects(projects, cfg)
    pts = px.feature_points(q)
    out = ids.select("eia_id")
    for group, statuses in (("firm", c["statuses_firm"]), ("announced", c["statuses_announced"])):
        names = {"name": f"nearest_{group}_project", "kind": f"nearest_{group}_kind", "load_mw": f"nearest_{group}_mw",
                 "location_confidence": f"_{group}_loc"}
        if group == "firm":
            names["status"] = "nearest_firm_status"
        near = _nearest(ids, sites, pts.filter(F.col("status").isin(statuses)), r, "project_id", names,
                        f"dist_load_pocket_{group}_mi", cfg, True)
        out = out.join(near, "eia_id")
    out = out.join(project_list(sites, q, cfg), "eia_id", "left")
    firm = band(F.col("dist_load_pocket_firm_mi"), sc["bands"])
    ann = band(F.col("dist_load_pocket_announced_mi"), sc["bands"]) * sc["announced_factor"]
    n = q.agg(F.count(F.lit(1)))
    return (out.withColumn("n_projects_within_search", F.coalesce(F.col("n"), F.lit(0)))
            .withColumn("mw_within_search", F.coalesce(F.col("mw"), F.lit(0.0)))
            .withColumn("projects_within_search", F.col("txt"))
            .withColumn("load_pocket_location_confidence", driving_location(firm, ann, F.col("_firm_loc"), F.col("_announced_loc")))
            .withColumn("load_pocket_search_mi", F.lit(r))
            .withColumn("load_pocket_source", F.format_string("manual: %s (%d qualifying projects)", F.lit(table), n.scalar()))
            .withColumn("load_pocket_table_date", F.lit(table_date)).withColumn("load_pocket_confidence", F.lit("manual"))
            .drop("n", "mw", "txt", "_firm_loc", "_announced_loc"))


# ---- coverage cells ------------------------------------------------------------------------------------------------------
def coverage_reduce(rows: DataFrame, cfg: dict) -> DataFrame:
    """Availability rows of the fibre technology → cell × provider × brand: locations, best speeds, any business."""
    c = cfg["layers"]["fiber_bdc"]
    if "technology" in rows.columns:
        rows = rows.filter(to_number(F.col("technology")) == c["technology_code"])
    business = one_of(F.upper(F.trim(F.col("business_residential_code"))), c["business_codes"])
    return (rows.groupBy(F.lower(F.trim(F.col("h3_res8_id"))).alias("h3"), "provider_id", F.trim(F.col("brand_name")).alias("brand"))
            .agg(F.count(F.lit(1)).alias("locations"), F.max(to_number(F.col("max_advertised_download_speed"))).alias("max_down"),
                 F.max(to_number(F.col("max_advertised_upload_speed"))).alias("max_up"), F.max(business).alias("business")))


def coverage_cell_points(cells: DataFrame, centres: DataFrame) -> DataFrame:
    """One row per cell with its centre, aggregates and sorted brand list. centres: h3, lat, lon (a dimension table)."""
    by = cells.groupBy("h3").agg(F.countDistinct("provider_id").alias("providers"), F.max("locations").alias("locations"),
                                 F.max("max_down").alias("max_down"), F.max("max_up").alias("max_up"), F.max("business").alias("business"),
                                 F.array_join(F.array_sort(F.collect_set("brand")), "; ").alias("brands"))
    return px.feature_points(by.join(centres, "h3"))


def fiber_at_site(nearest_mi: Column, cfg: dict) -> Column:
    return is_true(nearest_mi * cfg["units"]["m_per_mi"] <= cfg["layers"]["fiber_bdc"]["site_cell_m"])


def _coverage_near(sites: DataFrame, cells: DataFrame, pts: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Over the cells within the radius of a site: their number and best figures, the number of providers, and how many cells
    each brand has. Sites and cells that are there once need no pairs: their figures are sums over tiles. With a repeated one,
    whose pairs have to be told apart, or a figure that is no number the pairs are made."""
    repeated = lambda d, k: F.count(F.lit(1)) - F.count_distinct(k)
    odd = pts.agg(repeated(pts, "h3") + F.count_if(F.isnan("max_down") | F.isnan("max_up"))).first()[0] + sites.agg(repeated(sites, "eia_id")).first()[0]
    if odd:
        hits = cut_lineage(px.within_features(sites, pts.select("h3", "max_down", "max_up", "business", "x1", "y1", "x2", "y2"), radius_m, "h3"), "near")
        agg = hits.groupBy("eia_id").agg(F.count(F.lit(1)).alias("cells"), F.max("max_down").alias("bdc_max_down_mbps_near"),
                                         F.max("max_up").alias("bdc_max_up_mbps_near"), F.max("business").alias("biz"))
        served = hits.select("eia_id", "h3").join(cells.select("h3", "provider_id", "brand"), "h3")
        return agg, served.groupBy("eia_id").agg(F.countDistinct("provider_id").alias("provs")), served.groupBy("eia_id", "brand").agg(F.countDistinct("h3").alias("n"))
    best = px.within_totals(sites, pts.select("max_down", "max_up", F.col("business").cast("int").alias("business"), "x1", "y1"), radius_m, maxima=["max_down", "max_up", "business"])
    agg = best.select("eia_id", F.col("n").alias("cells"), F.col("max_down").alias("bdc_max_down_mbps_near"), F.col("max_up").alias("bdc_max_up_mbps_near"), (F.col("business") > 0).alias("biz"))
    kinds = F.array(F.struct(F.lit("provider").alias("kind"), F.col("provider_id").cast("string").alias("label")), F.struct(F.lit("brand").alias("kind"), F.col("brand").alias("label")))
    items = cells.select("h3", F.inline(kinds)).distinct().join(pts.select("h3", "x1", "y1"), "h3")
    held = cut_lineage(px.within_totals(sites, items, radius_m, by=["kind", "label"]), "held")
    provs = held.filter("kind = 'provider' and label is not null").groupBy("eia_id").agg(F.count(F.lit(1)).alias("provs"))
    return agg, provs, held.filter("kind = 'brand'").select("eia_id", F.col("label").alias("brand"), "n")


def coverage(ids: DataFrame, sites: DataFrame, cells: DataFrame, centres: DataFrame, cfg: dict, source: str, release: str | None,
             fetched: str) -> DataFrame:
    c = cfg["layers"]["fiber_bdc"]
    cells = cut_lineage(cells, "cells")  # reduced once, read for the points and for the brands
    pts = cut_lineage(coverage_cell_points(cells, centres), "points")
    near = _nearest(ids, sites, pts, c["search_radius_mi"], "h3", {"brands": "bdc_nearest_brands"}, "bdc_fiber_nearest_mi", cfg, True)
    agg, provs, per = _coverage_near(sites, cells, pts, c["near_miles"] * _mi(cfg))
    # brands of one site: as many as there are brands in the market
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "brand"))), 1, c["top_brands"])
    brands = per.groupBy("eia_id").agg(F.array_join(F.transform(ranked, lambda s: s["brand"]), "; ").alias("bdc_brands_near"))
    out = (ids.select("eia_id", "geometry_is_point").join(near, "eia_id").join(agg, "eia_id", "left").join(provs, "eia_id", "left")
           .join(brands, "eia_id", "left")
           .withColumn("bdc_cells_near", F.coalesce("cells", F.lit(0))).withColumn("bdc_providers_near", F.coalesce("provs", F.lit(0)))
           .withColumn("bdc_business_fiber_near", is_true(F.col("biz")))
           .withColumn("bdc_fiber_at_site", fiber_at_site(F.col("bdc_fiber_nearest_mi"), cfg))
           .withColumn("bdc_status", F.lit("ok")).withColumn("bdc_release", F.lit(release).cast("string")))
    return provenance(out, "bdc", source, fetched, c["search_radius_mi"]).drop("geometry_is_point", "cells", "provs", "biz")


# ---- wells ---------------------------------------------------------------------------------------------------------------
def log_metrics(lith: DataFrame, cfg: dict) -> DataFrame:
    """Driller layers → one row per log: depth, feet of each class within the bore depth, lost circulation."""
    c, p = cfg["layers"]["wells"], cfg["layers"]["wells"]["patterns"]
    depth = F.lit(c["bore_depth_ft"])
    ft = F.greatest(F.least(F.col("bottom_ft"), depth) - F.least(F.col("top_ft"), depth), F.lit(0.0))
    text = F.upper(F.coalesce(F.col("desc"), F.lit("")))
    feet = lambda pattern: F.sum(F.when(text.rlike(pattern), ft).otherwise(0.0))
    return (lith.filter("bottom_ft > top_ft").groupBy("id").agg(
        F.max("bottom_ft").alias("log_depth_ft"), feet(f"{p['caliche']}|{p['gypsum']}").alias("hard_ft"),
        feet(p["caliche"]).alias("caliche_ft"), feet(p["gypsum"]).alias("gypsum_ft"), feet(p["hard_rock"]).alias("rock_ft"),
        F.max(text.rlike(p["lost_circulation"])).alias("lost"))
        .filter(F.col("log_depth_ft") >= c["min_log_depth_ft"]))


def latest_levels(levels: DataFrame, cfg: dict) -> DataFrame:
    """Monitored wells: latest publishable measurement since the configured year."""
    ok = levels.filter((F.lower("status") == "publishable") & F.col("depth_ft").isNotNull()
                       & (F.col("year") >= cfg["layers"]["wells"]["water_level_since"]))
    return latest_per_key(ok.select("swn", "date", "year", "depth_ft"), ["swn"], [F.col("date"), F.col("depth_ft")]).drop("date")


def water_levels(sdr_wells: DataFrame, sdr_levels: DataFrame, gwdb_wells: DataFrame, gwdb_levels: DataFrame) -> DataFrame:
    """Static level of each report and latest level of each monitored well, negative (flowing) ones out."""
    a = (sdr_wells.select("id", "lat", "lon").join(sdr_levels.select("id", "depth_ft", "year"), "id")
         .select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("level_id"), "lat", "lon", "depth_ft", "year", F.lit("sdr").alias("src")))
    b = (gwdb_levels.join(gwdb_wells.select("swn", "lat", "lon"), "swn")
         .select(F.concat(F.lit("g"), F.col("swn").cast("string")).alias("level_id"), "lat", "lon", "depth_ft", "year", F.lit("gwdb").alias("src")))
    return a.unionByName(b).filter("depth_ft >= 0")


def majority_labels(df: DataFrame, key: str, labels: dict[str, str], weight: str | None = None) -> DataFrame:
    """Most common non-blank label per key (lowest on ties) for several label columns at once, counted per label before
    the key is gathered. labels: column → name of the result; weight: how many rows a row stands for, one if not given."""
    items = F.array(*[F.struct(F.lit(out).alias("kind"), F.col(c).alias("label")) for c, out in labels.items()])
    many = F.col(weight) if weight else F.lit(1)
    n = (df.select(key, many.alias("_w"), F.explode(items).alias("_i")).filter(F.trim("_i.label") != "")
         .groupBy(key, F.col("_i.kind").alias("_kind"), F.col("_i.label").alias("_label")).agg(F.sum("_w").alias("_n")))
    best = lambda out: F.min_by("_label", F.when(F.col("_kind") == out, F.struct(-F.col("_n"), F.col("_label")))).alias(out)
    return n.groupBy(key).agg(*[best(out) for out in labels.values()])


def majority_label(df: DataFrame, key: str, label: str, out: str, weight: str | None = None) -> DataFrame:
    return majority_labels(df, key, {label: out}, weight)


# The sources of water levels, in the order in which they are listed.
LEVEL_SOURCES = ("gwdb", "sdr")


def _first_radius(sites: DataFrame, feats: DataFrame, fid: str, need: int, c: dict, cfg: dict, figures: dict) -> DataFrame:
    """Per site: the first radius that holds `need` features, how many there are, and the figures over them; a site that no
    radius settles gets its count within the largest. One radius after the other, a wider one for the sites that are left:
    a dense region is settled by its nearest features and its wider circles are never paired. figures: name → aggregate."""
    radii, mi = c["search_radii_mi"], _mi(cfg)
    feats, left, found = cut_lineage(feats, "around"), sites, None
    for k, radius in enumerate(radii):
        last = k + 1 == len(radii)
        # a hair more than the radius, so that the test in miles decides alone; the widest circle is that of all pairs
        reach = max(radii) * mi if last else radius * mi * (1 + 1e-9)
        pairs = px.within_features(left, feats, reach, fid).filter(F.col("d") / mi <= radius)
        n = pairs.groupBy("eia_id").agg(F.count(F.lit(1)).alias("n"), *[v.alias(name) for name, v in figures.items()])
        held = F.col("n") >= need
        got = cut_lineage((n if last else n.filter(held)).select("eia_id", F.when(held, F.lit(float(radius))).alias("radius_mi"), "n", *[F.when(held, F.col(m)).alias(m) for m in figures]), "settled")
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select("eia_id"), "eia_id", "left_anti")
    return found


def log_layer(ids: DataFrame, sites: DataFrame, wells: DataFrame, lith: DataFrame, cfg: dict) -> DataFrame:
    """Driller-log figures over the first radius that holds enough logs."""
    c = cfg["layers"]["wells"]
    logs = px.feature_points(wells.select("id", "lat", "lon").join(log_metrics(lith, cfg), "id"))
    logs = logs.select("id", "log_depth_ft", "hard_ft", "caliche_ft", "gypsum_ft", "rock_ft", "lost", "x1", "y1", "x2", "y2")
    thick = c["thick_layer_ft"]
    share = lambda cond: F.bround(F.avg(cond.cast("double")), 3)
    at = lambda v, p: F.percentile(F.col(v), F.lit(p))
    figures = {"thick_hard_layer_share": share(F.col("hard_ft") >= thick), "caliche_log_share": share(F.col("caliche_ft") > 0), "gypsum_log_share": share(F.col("gypsum_ft") > 0),
               "hard_rock_log_share": share(F.col("rock_ft") >= thick), "lost_circulation_log_share": share(F.col("lost")),
               "hard_layer_ft_median": at("hard_ft", 0.5), "hard_layer_ft_p90": at("hard_ft", 0.9), "median_log_depth_ft": at("log_depth_ft", 0.5)}
    out = ids.select("eia_id").join(_first_radius(sites, logs, "id", c["min_logs"], c, cfg, figures), "eia_id", "left")
    return out.withColumn("n_logs", F.coalesce("n", F.lit(0))).withColumnRenamed("radius_mi", "logs_radius_mi").drop("n")


def level_layer(ids: DataFrame, sites: DataFrame, levels: DataFrame, cfg: dict) -> DataFrame:
    """Depth to water over the first radius that holds enough levels, and which sources they come from."""
    c = cfg["layers"]["wells"]
    pts = px.feature_points(levels).select("level_id", "depth_ft", "year", "src", "x1", "y1", "x2", "y2")
    at = lambda p: F.percentile(F.col("depth_ft"), F.lit(p))
    sources = [(name, F.count_if(F.col("src") == name)) for name in LEVEL_SOURCES]
    listed = F.concat_ws("; ", *[F.when(n > 0, F.concat_ws(" ", F.lit(name), n.cast("string"))) for name, n in sources])
    figures = {"latest_water_level_year": F.max("year").cast("bigint"), "depth_to_water_ft": at(0.5), "depth_to_water_ft_p25": at(0.25), "depth_to_water_ft_p75": at(0.75),
               "water_level_sources": listed}
    out = ids.select("eia_id").join(_first_radius(sites, pts, "level_id", c["min_levels"], c, cfg, figures), "eia_id", "left")
    return out.withColumn("n_water_levels", F.coalesce("n", F.lit(0))).withColumnRenamed("radius_mi", "water_radius_mi").drop("n")


def wells_layer(ids: DataFrame, sites: DataFrame, src: dict[str, DataFrame], cfg: dict, fetched: str) -> DataFrame:
    """src: sdr_wells, sdr_lithology, sdr_levels, gwdb_wells, gwdb_levels."""
    c = cfg["layers"]["wells"]
    far = max(c["search_radii_mi"]) * _mi(cfg)
    wells, gw = src["sdr_wells"], src["gwdb_wells"]
    logs = log_layer(ids, sites, wells, src["sdr_lithology"], cfg)
    levels = level_layer(ids, sites, water_levels(wells, src["sdr_levels"], gw, src["gwdb_levels"]), cfg)
    bores = px.feature_points(wells.filter(F.lower("use") == c["geothermal_use"])).select("id", "x1", "y1", "x2", "y2")
    n_bores = px.within_features(sites, bores, far, "id").groupBy("eia_id").agg(F.count(F.lit(1)).alias("_nb"))
    around = px.within_features(sites, px.feature_points(gw).select("swn", "aquifer", "gcd", "x1", "y1", "x2", "y2"), far, "swn")
    out = ids.select("eia_id", "geometry_is_point").join(logs, "eia_id").join(levels, "eia_id").join(n_bores, "eia_id", "left")
    out = (out.join(majority_labels(around, "eia_id", {"aquifer": "aquifer_majority", "gcd": "gcd_majority"}), "eia_id", "left")
           .withColumn("n_geothermal_bores", F.coalesce("_nb", F.lit(0))).drop("_nb"))
    sure = is_true(F.col("logs_radius_mi") == c["search_radii_mi"][0]) & ~F.col("geometry_is_point")
    return provenance(out, "wells", "twdb sdr (driller logs, levels) + gwdb (levels, aquifer, gcd)", fetched, None,
                      F.when(sure, "medium").otherwise("low")).drop("geometry_is_point")
