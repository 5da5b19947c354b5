"""Point bands, quantile bands, regions and tiers as generated CASE expressions."""

from pyspark.sql import Column, functions as F

_TESTS = {"lt": lambda v, b: v < b, "gt": lambda v, b: v > b, "gte": lambda v, b: v >= b, "lte": lambda v, b: v <= b}


def band(value: Column, bands) -> Column:
    """Points of the first band that holds; null stays null; no band and no else → 0."""
    otherwise, chain = 0.0, None
    for kind, bound, pts in bands:
        if kind == "else":
            otherwise = float(pts)
            break
        test = _TESTS[kind](value, F.lit(float(bound)))
        chain = F.when(test, float(pts)) if chain is None else chain.when(test, float(pts))
    inner = chain.otherwise(otherwise) if chain is not None else F.lit(otherwise)
    return F.when(value.isNotNull(), inner)


def else_points(bands) -> float:
    return next((float(p) for kind, _, p in bands if kind == "else"), 0.0)


def quantile_band(value: Column, cuts, spec: dict) -> Column:
    """Bands between fleet cut points. cuts: one Column per spec entry, in spec order."""
    chain = None
    for cut, (_, pts) in zip(cuts, spec["quantile"]):
        test = value <= cut if spec["low_is_better"] else value >= cut
        chain = F.when(test, float(pts)) if chain is None else chain.when(test, float(pts))
    return F.when(value.isNotNull(), chain.otherwise(float(spec["quantile_else"])))


def region_of(lat: Column, lon: Column, bench: dict) -> Column:
    chain = None
    for name, box in bench["regions"]:
        ok = F.lit(True)
        for key, bound in box.items():
            col = lon if key.startswith("lon") else lat
            ok = ok & _TESTS[key[4:]](col, F.lit(float(bound)))
        chain = F.when(ok, name) if chain is None else chain.when(ok, name)
    return chain.otherwise(bench["default_region"])


def derived_line_mw(cfg: dict) -> float:
    """AC MW at which a plant at the default ratio draws exactly the large-load threshold."""
    a = cfg["assumptions"]
    return cfg["large_load_threshold_mw"] / (a["pue_assumed"] * a["it_mw_per_mwdc"] * a["ilr_default"])


def tier_of(ac_mw: Column, cfg: dict) -> Column:
    line = derived_line_mw(cfg)
    out = F.lit(None).cast("string")
    for name, lo, hi in cfg["tiers"]:
        lo = line if lo == "derived_line" else lo
        hi = line if hi == "derived_line" else hi
        test = ac_mw >= F.lit(float(lo))
        if hi is not None:
            test = test & (ac_mw < F.lit(float(hi)))
        out = F.when(test, name).otherwise(out)
    return out


def order_key(col: Column, order, last: int = 99) -> Column:
    """Sort key of a category list given best first."""
    out = F.lit(last)
    for i, name in enumerate(order):
        out = F.when(col == name, i).otherwise(out)
    return out
