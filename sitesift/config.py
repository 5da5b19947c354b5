"""Default thresholds. Operators take this dict (or a changed copy) and never hold a number of their own."""

import copy

# Thresholds, codes and point tables that results must reproduce.
DEFAULTS = {
    "version": "2026-09-30",
    "assumptions": {
        "it_mw_per_mwdc": 0.5,
        "pue_assumed": 1.15,
        "ilr_default": 1.30,
        "fiber_lateral_cost_per_mile_usd": 100000.0,
        "fixed_cost_defaults_usd": {"ercot_study": 250000.0, "title_and_mineral": 150000.0,
                                    "substation_mod": 1500000.0, "legal_and_transaction": 500000.0},
    },
    "hard_filters": {"min_ac_mw": 10, "cod_from": "2015-01-01", "cod_to": "2022-12-31",
                     "min_acres_per_mw_ac": 5, "min_acres": 60, "footprint_basis": "parcel"},
    "inventory": {"state": "TX", "pv_energy_source": "SUN", "pv_prime_mover": "PV",
                  "storage_energy_source": "MWH", "home_ba_code": "ERCO"},
    "generation": {"pv_prime_mover": "PV", "min_months_for_full_year": 12,
                   "frequency_map": {"M": "monthly", "A": "annual", "AM": "annual"}},
    "market_source": {"unit_key": "UNIT CODE", "solar_fuel_codes": ["SOLAR", "SOL", "PV"],
                      "pv_resource_type": "PVGR"},
    "units": {"m2_per_acre": 4046.8564224, "m_per_mi": 1609.344},
    "tiers": [("T3", 10.0, 25.0), ("T2", 25.0, 75.0), ("T1a", 75.0, "derived_line"), ("T1b", "derived_line", None)],
    "large_load_threshold_mw": 75.0,
    "market_window": {"months": 36, "history_floor": "2023-12-11"},
    "market": {"lag_days": 62, "default_minutes": 5, "max_interval_minutes": 15, "slice_minutes": 180,
               "hub": "HB_HUBAVG", "timezone": "US/Central",
               "extra_locations": ["HB_NORTH", "HB_SOUTH", "HB_WEST", "HB_HOUSTON", "HB_BUSAVG"],
               "min_month_coverage": 0.90, "min_gen_mwh_for_capture": 100.0},
    "crosswalk": {
        "name_high": 85.0, "name_medium": 70.0, "name_min": 55.0, "mw_tolerance_high": 0.10,
        "mw_tolerance_medium": 0.25, "year_tolerance": 1, "phase_penalty": 0.05, "year_penalty": 0.10,
        "max_candidates": 10, "review_score": 50.0, "review_units": 5, "review_mw_error": 0.15,
        "stopwords": ["solar", "energy", "project", "projects", "llc", "lp", "inc", "farm", "pv", "power", "plant",
                      "center", "facility", "the", "park", "station", "generation", "generating", "texas", "tx", "hybrid"],
        "roman": {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6"},
    },
    "benchmarks": {
        "cf_plausible_range": [0.05, 0.40],
        "regions": [("west_texas", {"lon_lt": -100.0}), ("coastal", {"lat_lt": 30.0, "lon_gt": -99.5})],
        "default_region": "central_texas",
        "regional_cf": {"west_texas": None, "central_texas": None, "coastal": None},
    },
    "bbox": {"texas": [-106.7, 25.8, -93.5, 36.6]},
    "layers": {
        "transmission": {"search_radius_mi": 40.0, "near_miles": 3.0, "min_kv": 100.0, "class_tolerance": 0.05,
                         "kv_classes": [138, 230, 345, 500], "bbox_half_deg": 0.9, "bbox_snap_deg": 0.25},
        "gas_pipelines": {"search_radius_mi": 15.0, "near_miles": 5.0, "bbox_half_deg": 0.40, "bbox_snap_deg": 0.25,
                          "status": "In Service",
                          "commodities": ["NATURAL GAS", "NATURAL GAS FWS", "NATURAL GAS OFFSHORE", "OTHER GAS"],
                          "transmission_prefixes": ["Natural/Other Gas Transmission"]},
        "fiber": {"search_radius_mi": 60.0, "rail_owners": ["UP", "BNSF", "CPKC"], "rail_net": ["M"],
                  "interstate_pattern": r"(^|;)\s*I[ -]?(\d+)", "route_factor": 1.5, "rtt_ms_per_route_mile": 0.0158,
                  "earth_mi": 3958.8,
                  "hotels": [("Dallas Infomart (1950 N Stemmons)", 32.800748, -96.819412),
                             ("Houston 1301 Fannin", 29.753242, -95.365882),
                             ("San Antonio 100 Taylor St", 29.429369, -98.486791)]},
        "fiber_bdc": {"technology_code": 50, "business_codes": ["B", "X"], "search_radius_mi": 25.0, "near_miles": 5.0,
                      "site_cell_m": 500.0, "top_brands": 3},
        "flood": {"flag_sfha_share": 0.10, "point_buffer_m": 300.0},
        "climate": {"point_round_deg": 0.02, "drybulb_below_c": [15, 20, 25], "wetbulb_below_c": [20],
                    "drybulb_above_c": 35, "design_percentile": 0.996},
        "wells": {"bore_depth_ft": 500.0, "min_log_depth_ft": 50.0, "thick_layer_ft": 20.0,
                  "search_radii_mi": [3.0, 6.0, 10.0], "min_logs": 5, "min_levels": 3, "water_level_since": 2000,
                  "geothermal_use": "closed-loop geothermal",
                  "patterns": {"caliche": "CAL+[IE]CH|CALECH", "gypsum": "GYP|ANHYD|SELENITE",
                               "hard_rock": "LIME ?STONE|LIME ?ROCK|DOLOM|GRANITE|BASALT|QUARTZITE|HARD ROCK",
                               "lost_circulation": "LOST CIRC|NO RETURN|LOST RETURN|CAVERN|CAVITY|VOID"}},
        "soils": {"depth_cm": 200.0, "point_buffer_m": 300.0, "min_data_share_medium": 0.80,
                  "model": {"particle_density": 2.65, "lambda_quartz": 7.7, "lambda_other_minerals": 2.0,
                            "lambda_other_minerals_low_quartz": 3.0, "lambda_water": 0.6, "chi": 0.75, "eta": 1.2,
                            "kappa_sand": 3.55, "kappa_fine": 1.9, "sand_kappa_min_pct": 50.0}},
        "parcels": {"neighborhood_m": 3000.0, "min_overlap_acres": 1.0, "min_overlap_frac": 0.02,
                    "adjacency_tol_m": 2.0, "max_expansion_rounds": 6, "unified_min_owner_share": 0.90,
                    "main_owner_share": 0.10, "point_buffer_m": 100.0, "medium_cover_below": 0.25,
                    "medium_parcels_above": 12,
                    "owner_stopwords": ["llc", "lp", "llp", "lllp", "inc", "corp", "corporation", "co", "company",
                                        "ltd", "trust", "tr", "et", "al", "ux", "vir", "estate", "of", "the"],
                    "fields": {"owner": ["owner_name", "ownername", "owner", "own_name", "owner1"],
                               "prop_id": ["prop_id", "propid", "geo_id", "geoid", "property_id"],
                               "land_use": ["stat_land_use", "state_cd", "land_use", "loc_land_use", "landuse"],
                               "market_value": ["mkt_value", "market_value", "market", "total_value", "appraised",
                                                "tot_value"],
                               "land_value": ["land_value", "landvalue", "land_val"],
                               "county": ["county", "county_name", "cnty_name", "countyname"],
                               "year": ["tax_year", "taxyear", "year", "data_year", "source_year"]}},
        "load_pocket": {"statuses_firm": ["operating", "under_construction"], "statuses_announced": ["announced"],
                        "min_load_mw_non_dc": 75.0, "search_radius_mi": 50.0,
                        "kinds": ["data_center", "crypto", "hydrogen", "industrial", "other"],
                        "statuses": ["operating", "under_construction", "announced", "cancelled"],
                        "location_confidence": ["site", "city", "county"]},
    },
    "offtake": {"max": 4.0, "merchant": 4.0, "short_contract": 3.0, "short_years": 5.0, "long_contract_ig": 0.0,
                "long_contract_non_ig": 1.0, "long_contract_unknown_credit": 0.5, "utility_owned": 0.0,
                "affiliate": 3.0, "assumed_term_years": {"ppa": 15, "hedge": 12}, "flag_share_below": 0.5,
                "flag_years_near_line": 1, "year_only_end_month": 7,
                "types": ["ppa", "hedge", "affiliate", "utility_owned", "merchant", "unknown"],
                "end_basis": ["published", "computed", "assumed"], "ig": ["yes", "no", "unknown"],
                "confidence": ["high", "medium", "low"]},
    "scoring": {
        "breakpoint_mode": "quantile", "missing_share": 0.5, "rank_statuses": ["pass"],
        "capture": {"metric": "capture_rate_potential", "max": 12.0, "low_is_better": True,
                    "fixed": [("lt", 0.55, 12.0), ("lt", 0.65, 8.0), ("lt", 0.75, 4.0), ("else", None, 0.0)],
                    "quantile": [(0.25, 12.0), (0.50, 8.0), (0.75, 4.0)], "quantile_else": 0.0},
        "curtailment": {"metric": "curtailment_pct", "max": 8.0, "low_is_better": False,
                        "fixed": [("gt", 0.20, 8.0), ("gt", 0.10, 5.0), ("else", None, 2.0)],
                        "quantile": [(0.75, 8.0), (0.50, 5.0)], "quantile_else": 2.0},
        "cf_benchmark": {"max": 6.0, "bands": [("gt", 4.0, 6.0), ("gt", 2.0, 4.0), ("else", None, 1.0)]},
        "repowering": {"poly": 6.0, "monofacial": 5.0, "tracker": 4.0, "poly_until": 2018, "mixed_until": 2020},
        "acres": {"max": 8.0, "bands": [("gt", 14.0, 8.0), ("gt", 10.0, 6.0), ("gt", 7.0, 3.0), ("else", None, 0.0)]},
        "headroom": {"max": 7.0, "bands": [("gt", 0.50, 7.0), ("gt", 0.20, 4.0), ("else", None, 0.0)]},
        "land_control": {"max": 5.0},
        "poi_kv": {"max": 10.0, "distribution_class_max_kv": 34.5,
                   "bands": [("gte", 345.0, 10.0), ("gte", 138.0, 6.0), ("gte", 69.0, 2.0), ("else", None, 0.0)]},
        "dist_345": {"max": 5.0, "bands": [("lt", 5.0, 5.0), ("lt", 15.0, 2.0), ("else", None, 0.0)]},
        "load_pocket": {"max": 5.0, "announced_factor": 0.5,
                        "bands": [("lt", 10.0, 5.0), ("lt", 25.0, 3.0), ("lt", 50.0, 1.0), ("else", None, 0.0)]},
        "lambda": {"scored": False, "max": 6.0, "test_flag_below": 1.0,
                   "bands": [("gte", 2.0, 6.0), ("gte", 1.5, 4.0), ("gte", 1.0, 2.0), ("else", None, 0.0)]},
        "drill": {"max": 4.0, "metric": "thick_hard_layer_share",
                  "bands": [("lt", 0.10, 4.0), ("lt", 0.25, 3.0), ("lt", 0.50, 2.0), ("lt", 0.75, 1.0),
                            ("else", None, 0.0)]},
        "hours25": {"max": 3.0, "bands": [("gte", 6000.0, 3.0), ("gte", 5000.0, 2.0), ("gte", 4000.0, 1.0),
                                          ("else", None, 0.0)]},
        "water": {"max": 2.0, "bands": [("gte", 200.0, 2.0), ("gte", 100.0, 1.0), ("else", None, 0.0)]},
        "fixed_cost": {"bands": [("lt", 100.0, 0.0), ("lt", 250.0, -5.0), ("lt", 450.0, -10.0), ("else", None, -15.0)]},
        "section_max": {"a": 30.0, "b": 15.0, "c": 20.0, "d": 20.0, "e": 9.0, "f": 15.0},
    },
}


def config(**changes) -> dict:
    """A private copy of the defaults; keyword values replace or extend top-level sections."""
    cfg = copy.deepcopy(DEFAULTS)
    for key, value in changes.items():
        if isinstance(value, dict) and isinstance(cfg.get(key), dict):
            cfg[key].update(copy.deepcopy(value))
        else:
            cfg[key] = copy.deepcopy(value)
    return cfg
