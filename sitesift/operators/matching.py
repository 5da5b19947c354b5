"""Entity resolution: plants against market units by county, name, size and year.

Names are scored once per distinct pair of normalised names. Claiming units one plant at a time, best fit first, is
left to `claims`, the search for sets of free units to `unit_sets`.
"""

import functools
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from ..functions.nulls import blank_to_null, is_true, to_number
from ..session import cut_lineage, spread
from . import claims, unit_sets

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Columns of the published match table, in order.
CROSSWALK_COLUMNS = ["eia_plant_id", "eia_plant_name", "ercot_resource_name", "ercot_settlement_point", "county", "ac_mw_eia",
                     "ac_mw_ercot", "cod_eia", "match_method", "match_confidence", "verified_by", "verified_on", "notes",
                     "cdr_unit_name", "cdr_year", "name_score", "mw_error_pct", "sced_coverage", "sced_max_hsl_mw"]


#: plants of a county that one task joins with its units, plants of one name that are scored as one
COUNTY_PART, NAMESAKES = 5_000, 100
#: names with one letter pair that a task joins
NAMES_PART = 1_000


# ---- name score ------------------------------------------------------------------------------------------------------------
def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per row (Hyyrö's bit-parallel recurrence)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def token_set_score(a: str | None, b: str | None, floor: float = 0.0) -> float:
    """0-100: best agreement among shared words against each name and of the two names' remainders; empty → 0. Below
    `floor` the caller does not care: a score that lengths alone keep under it is returned as 0."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (both == x or both == y):
        return 100.0
    s, p, q = (" ".join(sorted(v)) for v in (both, x - y, y - x))
    gap = 1 if s else 0
    len_p, len_q = len(s) + gap + len(p), len(s) + gap + len(q)
    shared = max(1 - (gap + len(p)) / (len(s) + len_p), 1 - (gap + len(q)) / (len(s) + len_q)) if s else 0.0
    if 100.0 * max(shared, 1 - abs(len(p) - len(q)) / (len_p + len_q)) < floor - 1e-9:
        return 0.0
    return 100.0 * max(shared, 1 - (len(p) + len(q) - 2 * _lcs(p, q)) / (len_p + len_q))


def name_score(a: Column, b: Column, floor: float = 0.0) -> Column:
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([token_set_score(p, q, floor) for p, q in zip(x, y)], dtype=float)
    return F.pandas_udf(scored, "double")(a, b)


# ---- inputs ----------------------------------------------------------------------------------------------------------------
def market_units(raw: DataFrame, c: dict, ordinal: str = "ordinal") -> DataFrame:
    """Published unit rows → one row per unit code (the first), with normalised names, county, MW and year."""
    u = raw.select(F.trim("unit_code").alias("unit_code"), "unit_name", "county", to_number(F.col("installed_mw")).alias("mw"),
                   text.year_of(F.col("in_service_year")).alias("year"), F.col(ordinal).alias("ord"))
    rest = [x for x in u.columns if x != "unit_code"]
    return (u.groupBy("unit_code").agg(F.min_by(F.struct(*rest), F.col("ord")).alias("_r"))
            .select("unit_code", *[F.col(f"_r.{x}").alias(x) for x in rest])
            .withColumn("county_n", text.norm_county(F.col("county")))
            .withColumn("name_n", text.norm_name(F.col("unit_name"), c)).withColumn("code_n", text.norm_name(F.col("unit_code"), c))
            .withColumn("digits", text.phase_digits(F.col("unit_name"), c)))


def plant_names(plants: DataFrame, c: dict) -> DataFrame:
    return (plants.select("eia_id", "plant_name", "county", "ac_mw", "cod_first", "cod_last")
            .withColumn("county_n", text.norm_county(F.col("county"))).withColumn("plant_n", text.norm_name(F.col("plant_name"), c))
            .withColumn("want", text.phase_digits(F.col("plant_name"), c)))


def node_map(mapping: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """resource → settlement node: '<substation>_<unit>' before the bare unit name, the first row of each kind."""
    unit = blank_to_null(F.col("unit_name"))
    exact = mapping.filter(blank_to_null(F.col("unit_substation")).isNotNull() & unit.isNotNull()).select(
        F.upper(F.concat_ws("_", "unit_substation", "unit_name")).alias("resource"), "resource_node", F.lit(0).alias("p"), F.col(ordinal).alias("o"))
    bare = mapping.filter(unit.isNotNull()).select(F.upper("unit_name").alias("resource"), "resource_node", F.lit(1).alias("p"), F.col(ordinal).alias("o"))
    return exact.union(bare).groupBy("resource").agg(F.min_by("resource_node", F.struct("p", "o")).alias("node"))


# ---- candidates ------------------------------------------------------------------------------------------------------------
def _score_pairs(pairs: DataFrame) -> DataFrame:
    """Adds name_score = the better of unit name and unit code against the plant name, each distinct pair scored once."""
    longs = pairs.select("plant_n", F.explode(F.array("name_n", "code_n")).alias("other")).distinct()
    scored = spread(longs, "plant_n", "other").withColumn("s", name_score(F.col("plant_n"), F.col("other")))
    by_name, by_code = (scored.select("plant_n", F.col("other").alias(k), F.col("s").alias(f"_{k}")) for k in ("name_n", "code_n"))
    return (pairs.join(by_name, ["plant_n", "name_n"]).join(by_code, ["plant_n", "code_n"])
            .withColumn("name_score", F.greatest("_name_n", "_code_n")).drop("_name_n", "_code_n"))


def county_pairs(plants: DataFrame, units: DataFrame) -> DataFrame:
    """Plants with the units of their county, a plant's pairs one after another. Plants and units alone are shuffled; a
    county of more than COUNTY_PART plants is dealt to several tasks, its units to each of them."""
    parts = plants.groupBy("county_n").agg(F.ceil(F.count(F.lit(1)) / COUNTY_PART).cast("int").alias("_parts"))
    p = plants.join(parts, "county_n").withColumn("_part", F.pmod(F.xxhash64(*plants.columns), F.col("_parts")).cast("int")).drop("_parts")
    u = (units.withColumnsRenamed({"county": "unit_county"}).join(parts, "county_n")
         .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"))
    both = ["county_n", "_part"]
    return spread(p, *both).join(spread(u, *both).hint("merge"), both).drop("_part").withColumn("same_county", F.lit(True))


def scored_pairs(plants: DataFrame, units: DataFrame) -> DataFrame:
    """county_pairs with name_score, found where a pair is made. Plants of one name and county are scored as one, NAMESAKES at a time."""
    rest = [c for c in plants.columns if c not in ("county_n", "plant_n")]
    namesakes = Window.partitionBy("county_n", "plant_n").orderBy("eia_id")
    some = (plants.withColumn("_k", F.floor((F.row_number().over(namesakes) - 1) / NAMESAKES)).groupBy("county_n", "plant_n", "_k")
            .agg(F.collect_list(F.struct(*rest)).alias("_p")).drop("_k"))

    @F.pandas_udf("double")
    def better(plant: pd.Series, name: pd.Series, code: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        for pair in {*zip(plant, name), *zip(plant, code)}:
            known[pair] = token_set_score(*pair)
        return pd.Series([max(known[p, n], known[p, k]) for p, n, k in zip(plant, name, code)], dtype=float)

    scored = county_pairs(some, units).withColumn("name_score", better("plant_n", "name_n", "code_n"))
    kept = [c for c in scored.columns if c != "_p"]
    return scored.select(F.explode("_p").alias("_p"), *kept).select(*[F.col(f"_p.{c}").alias(c) for c in rest], *kept)


def _rare_keys(names: DataFrame, score: float) -> DataFrame:
    """(name, k, lead): words and letter pairs of distinct names, lead marking the rare ones that suffice for blocking.

    A pair of names reaching the score either shares words that make up most of one name's length, or is alike letter by
    letter and then keeps a known share of its letter pairs. Either way one of the rarest keys of a name must be shared,
    so frequent words never have to be joined with each other."""
    h = score / 100.0
    spare = 2 * (1 - h) / h
    kept = h / (2 - h)
    lost = 2 - 1.5 * h - (1.5 * h - 1) * kept
    words = F.array_distinct(F.split(F.col("name"), " "))
    joined = F.array_join(F.array_sort(words), " ")
    letters = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(joined) - 1), lambda i: F.concat(F.lit("~"), F.substring(joined, i, F.lit(2)))))
    base = names.withColumn("_n", F.length(joined))
    keys = base.select("name", "_n", F.explode(words).alias("k")).unionByName(base.filter("_n > 1").select("name", "_n", F.explode(letters).alias("k")))
    seen = keys.groupBy("k").agg(F.count(F.lit(1)).alias("f"))
    w = Window.partitionBy("name", "_pair").orderBy("f", "k")   # one name's own keys
    ranked = (keys.join(seen, "k").withColumn("_pair", F.col("k").startswith("~"))
              .withColumn("_pos", F.row_number().over(w))
              .withColumn("_before", F.sum(F.length("k") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    lead = F.when(F.col("_pair"), F.col("_pos") <= F.floor(lost * F.col("_n")) + 1).otherwise(
        F.coalesce("_before", F.lit(0)) <= spare / (1 + spare) * (F.col("_n") + 1))
    return ranked.select("name", "_n", "k", "_pair", lead.alias("lead"))


#: letters of normalised names
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: occurrences of a letter that have a bit of their own
RUN = 5


def _joined(column: str) -> Column:
    """A name's distinct words in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.col(column), " "), lambda w: w != ""))), " ")


def _bag(joined: Column) -> Column:
    """How often each letter occurs, as bits: the first RUN of a letter set one bit each, twelve letters to a number; last, how many more there are."""
    seen = [F.length(joined) - F.length(F.replace(joined, F.lit(x), F.lit(""))) for x in LETTERS]
    bits = [(F.pow(F.lit(2), F.least(n, F.lit(RUN))).cast("long") - 1) * F.lit(1 << RUN * (i % 12)) for i, n in enumerate(seen)]
    numbers = [functools.reduce(lambda x, y: x + y, bits[i:i + 12]) for i in range(0, len(LETTERS), 12)]
    more = functools.reduce(lambda x, y: x + y, [F.greatest(n - RUN, F.lit(0)) for n in seen])
    return F.array(*numbers, more.cast("long"))


def _common(a: str, b: str) -> Column:
    """No fewer than the letters two bags have in common; as many unless a letter occurs more than RUN times in both."""
    n = (len(LETTERS) + 11) // 12
    return functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[k].bitwiseAND(F.col(b)[k])) for k in range(n)]) + F.least(F.col(a)[n], F.col(b)[n])


def _dealt(p: DataFrame, o: DataFrame, name: str, *keys: str) -> DataFrame:
    """p and o joined on the keys. A key of more than NAMES_PART rows of o goes to several tasks, its rows of p to each of them."""
    parts = o.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / NAMES_PART).cast("int").alias("_parts"))
    mine = p.join(parts, [*keys]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    theirs = o.join(parts, [*keys]).withColumn("_part", F.pmod(F.xxhash64(name), F.col("_parts")).cast("int")).drop("_parts")
    both = [*keys, "_part"]
    return spread(mine, *both).join(spread(theirs, *both).hint("merge"), both).drop("_part")


def strong_names(plants: DataFrame, units: DataFrame, c: dict) -> DataFrame:
    """(plant_n, unit_code, name_score) of distinct plant names and the units whose name or code reaches the high score."""
    mine = plants.select(F.col("plant_n").alias("name")).filter("name != ''").distinct().withColumn("_mine", F.lit(True))
    theirs = units.select(F.explode(F.array("name_n", "code_n")).alias("name")).filter("name != ''").distinct()
    keys = cut_lineage(_rare_keys(mine.select("name").union(theirs).distinct(), c["name_high"]), "keys")
    p = keys.join(mine.select("name"), "name").select(F.col("name").alias("plant_n"), F.col("_n").alias("la"), "k", "_pair", F.col("lead").alias("pl"), _bag(_joined("name")).alias("pb"))
    o = keys.join(theirs, "name").select(F.col("name").alias("other"), F.col("_n").alias("lb"), "k", F.col("lead").alias("ol"), _bag(_joined("name")).alias("ob"))
    like = 200.0 * F.least("la", "lb") / (F.col("la") + F.col("lb")) >= c["name_high"]
    # the lengths that `like` allows, so that a letter pair of many names does not join names of other lengths; common letters in any
    # order bound those in order (alike_pairs), so names that merely look alike in parts are not scored
    h = c["name_high"] / 100.0
    reach = F.sequence(F.ceil(F.col("la") * h / (2 - h) - 1e-9).cast("int"), F.floor(F.col("la") * (2 - h) / h + 1e-9).cast("int"))
    # frequent keys are nobody's rare ones: dropping them before the join is what keeps it small
    joint = [p.filter("not _pair and pl").join(o, "k"), p.filter("not _pair").join(o.filter("ol"), "k"),
             _dealt(p.filter("_pair and pl").withColumn("lb", F.explode(reach)), o.filter("ol"), "other", "k", "lb").filter(like & (2.0 * _common("pb", "ob") >= h * (F.col("la") + F.col("lb")) - 1e-9))]
    names = (joint[0].select("plant_n", "other").union(joint[1].select("plant_n", "other")).union(joint[2].select("plant_n", "other")).distinct()
             .transform(lambda d: spread(d, "plant_n", "other")).withColumn("s", name_score(F.col("plant_n"), F.col("other"), c["name_high"])).filter(F.col("s") >= c["name_high"]))
    hits = [names.select("plant_n", F.col("other").alias(k), "s").join(units, k).select("plant_n", "unit_code", "s") for k in ("name_n", "code_n")]
    return hits[0].union(hits[1]).groupBy("plant_n", "unit_code").agg(F.max("s").alias("name_score"))


def far_pairs(plants: DataFrame, units: DataFrame, c: dict, names: DataFrame | None = None) -> DataFrame:
    """Units of other counties whose name reaches the high score. Blocking and scoring run on distinct names."""
    u = units.withColumnsRenamed({"county": "unit_county", "county_n": "unit_county_n"})
    return (plants.join(strong_names(plants, units, c) if names is None else names, "plant_n").join(u, "unit_code").filter(F.col("county_n") != F.col("unit_county_n"))
            .drop("unit_county_n").withColumn("same_county", F.lit(False)))


def alike_pairs(mine: DataFrame, theirs: DataFrame, score: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, plant_n, other): pairs of distinct names (mine: *keys, plant_n; theirs: *keys, other) that can reach a score too low
    for shared words or letter pairs to be certain.

    A score is a share of common letters in order, or of shared words in one of the names. Common letters are at most those the
    two names have in common in any order, so with h = score / 100: twice the common letters are at least h of both lengths, and
    neither name is longer than (2 - h) / h times the other. Names are dealt by length, each to the lengths it can reach,
    and the letters are compared as counts before any name is scored. For shared words the rare words of a name suffice."""
    h = score / 100.0

    def sized(names, column):
        joined = _joined(column)
        return names.filter(F.col(column) != "").distinct().select(*keys, column, F.length(joined).alias(f"n_{column}"), _bag(joined).alias(f"bag_{column}"))

    reach = F.sequence(F.ceil(F.col("n_plant_n") * h / (2 - h) - 1e-9), F.floor(F.col("n_plant_n") * (2 - h) / h + 1e-9))
    p, o = sized(mine, "plant_n").withColumn("n_other", F.explode(reach)), sized(theirs, "other").withColumn("n_other", F.col("n_other").cast("long"))
    by_letters = p.join(o.hint("merge"), [*keys, "n_other"]).filter(2.0 * _common("bag_plant_n", "bag_other") >= h * (F.col("n_plant_n") + F.col("n_other")) - 1e-9).select(*keys, "plant_n", "other")
    names = mine.select(F.col("plant_n").alias("name")).union(theirs.select("other")).filter("name != ''").distinct()
    rare = cut_lineage(_rare_keys(names, score).filter("not _pair").select("name", "k", "lead"), "keys")
    w = mine.distinct().join(rare.select(F.col("name").alias("plant_n"), "k", F.col("lead").alias("pl")), "plant_n")
    v = theirs.distinct().join(rare.select(F.col("name").alias("other"), "k", F.col("lead").alias("ol")), "other")
    by_words = [w.filter("pl").join(v, [*keys, "k"]), w.join(v.filter("ol"), [*keys, "k"])]
    return by_letters.union(by_words[0].select(*keys, "plant_n", "other")).union(by_words[1].select(*keys, "plant_n", "other")).distinct()


def alike_names(mine: DataFrame, theirs: DataFrame, score: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, plant_n, other, s): the pairs of distinct names that reach the score."""
    pairs = spread(alike_pairs(mine, theirs, score, keys), "plant_n", "other")
    return pairs.withColumn("s", name_score(F.col("plant_n"), F.col("other"), score)).filter(F.col("s") >= score)


def _unit_names(units: DataFrame, *keys: str) -> DataFrame:
    return units.select(*keys, F.explode(F.array("name_n", "code_n")).alias("other")).distinct()


def named_in_county(plants: DataFrame, units: DataFrame, score: float) -> DataFrame:
    """(eia_id, unit_code, name_score): units of a plant's county whose name or code reaches the score."""
    near = cut_lineage(alike_names(plants.select("county_n", "plant_n"), _unit_names(units, "county_n"), score, ("county_n",)), "near")
    hits = [near.withColumnRenamed("other", k).join(units.select("county_n", k, "unit_code"), ["county_n", k]).select("county_n", "plant_n", "unit_code", "s") for k in ("name_n", "code_n")]
    best = hits[0].union(hits[1]).groupBy("county_n", "plant_n", "unit_code").agg(F.max("s").alias("name_score"))
    return plants.select("eia_id", "county_n", "plant_n").join(best.hint("merge"), ["county_n", "plant_n"]).select("eia_id", "unit_code", "name_score")


def sized_in_county(plants: DataFrame, units: DataFrame, c: dict) -> DataFrame:
    """(eia_id, unit_code): units of a plant's county with fitting MW, by MW buckets a tenth wide, and year; an unknown year fits all."""
    tol, step = c["mw_tolerance_high"], math.log(1.1)
    bucket = lambda x: F.floor(F.log(x) / step)
    near = lambda d: F.transform(F.sequence(F.lit(-c["year_tolerance"]), F.lit(c["year_tolerance"])), lambda k: F.year(d) + k)
    years = F.array_distinct(F.array_compact(F.flatten(F.array(F.array(F.lit(-1)), F.coalesce(near("cod_first"), F.array().cast("array<int>")), F.coalesce(near("cod_last"), F.array().cast("array<int>"))))))
    p = (plants.filter("ac_mw > 0").select("eia_id", "county_n", "ac_mw", F.explode(years).alias("y"))
         .withColumn("b", F.explode(F.sequence(bucket(F.col("ac_mw") * (1 - tol) * (1 - 1e-9)), bucket(F.col("ac_mw") * (1 + tol) * (1 + 1e-9))))))
    u = units.filter("mw > 0").select("unit_code", "county_n", "mw", F.coalesce(F.col("year").cast("int"), F.lit(-1)).alias("y"), bucket(F.col("mw")).alias("b"))
    # no broadcast of plants, each of which has become a row for every year and bucket it reaches
    return p.join(u.hint("merge"), ["county_n", "y", "b"]).filter(F.abs(F.col("mw") - F.col("ac_mw")) / F.col("ac_mw") <= tol).select("eia_id", "unit_code")


def _phase_ok() -> Column:
    overlap = F.arrays_overlap("want", "digits")
    only_first = F.size(F.array_except("digits", F.array(F.lit("1")))) == 0
    return F.when(F.size("want") > 0, F.coalesce(overlap, F.lit(False))).otherwise(only_first)


def annotate(pairs: DataFrame, c: dict) -> DataFrame:
    """phase_ok and year_ok of a plant / unit pair."""
    cods = F.array_compact(F.array(F.year("cod_first"), F.year("cod_last")))
    near = F.exists(cods, lambda y: F.abs(F.col("year") - y) <= c["year_tolerance"])
    return (pairs.withColumn("phase_ok", _phase_ok())
            .withColumn("year_ok", F.when(F.col("year").isNotNull() & (F.size(cods) > 0), near).otherwise(F.col("year").isNull())))


_CANDIDATE = ["eia_id", "ac_mw", "unit_code", "unit_name", "mw", "year", "ord", "name_score", "phase_ok", "year_ok", "same_county", "tier"]


def home_candidates(plants: DataFrame, units: DataFrame, c: dict) -> DataFrame:
    """County pairs that can matter: tier 1 by a good name, tier 2 by a weak name or by fitting size and year. Only such pairs
    are made, not the county's plants times its units."""
    ids = cut_lineage(named_in_county(plants, units, c["name_min"]).select("eia_id", "unit_code").union(sized_in_county(plants, units, c)).distinct(), "ids")
    u = units.drop("county_n").withColumnsRenamed({"county": "unit_county", "unit_code": "_u"})
    pairs = (plants.join(ids.hint("merge"), "eia_id").join(u.hint("merge"), F.col("unit_code").eqNullSafe(F.col("_u"))).drop("_u").withColumn("same_county", F.lit(True)))
    pairs = annotate(_score_pairs(pairs), c)
    fit = is_true((F.abs(F.col("mw") - F.col("ac_mw")) / F.col("ac_mw") <= c["mw_tolerance_high"]) & F.col("year_ok"))
    tier = F.when(F.col("name_score") >= c["name_medium"], 1).when((F.col("name_score") >= c["name_min"]) | fit, 2)
    return pairs.withColumn("tier", tier).filter("tier is not null").select(*_CANDIDATE)


def far_candidates(plants: DataFrame, units: DataFrame, c: dict, names: DataFrame | None = None) -> DataFrame:
    """Tier 3: a strong name in another county."""
    return annotate(far_pairs(plants, units, c, names), c).withColumn("tier", F.lit(3)).select(*_CANDIDATE)


# ---- subset of one plant's candidates ------------------------------------------------------------------------------------------
#: plants whose subsets are held at a time
PLANTS = 2_048


def best_subset(c: dict) -> Column:
    """Over the array column k (known MW, at most ten, best name first): the subset with least MW error plus penalties;
    on equal objective fewer units, then earlier ones. Row-local: at most 1023 masks, -o as a number; plants with as many units at once."""
    best_of = claims.best_subsets

    def best(mw: pd.Series, pen: pd.Series, ac_mw: pd.Series) -> pd.DataFrame:
        sizes, own = mw.map(len, na_action="ignore").fillna(0).to_numpy(int), ac_mw.to_numpy(float)
        o, err = np.zeros(len(mw), "int32"), np.full(len(mw), np.nan)
        for k in set(sizes.tolist()) - {0}:
            rows = np.flatnonzero(sizes == k)
            for part in np.array_split(rows, -(-len(rows) // PLANTS)):
                masks, err[part] = best_of(np.stack(mw.iloc[part].tolist()).astype(float), np.stack(pen.iloc[part].tolist()).astype(float), own[part])
                o[part] = -masks
        return pd.DataFrame({"o": o, "err": err})

    fined = F.transform("k", lambda s: F.when(s["phase_ok"], 0.0).otherwise(c["phase_penalty"]) + F.when(s["year_ok"], 0.0).otherwise(c["year_penalty"]))
    found = F.pandas_udf(best, "o int, err double")(F.transform("k", lambda s: s["mw"].cast("double")), fined, F.col("ac_mw").cast("double"))
    return F.when(F.size("k") > 0, found)


def _rank(groups: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many rows of its group stand strictly before a row."""
    order = np.lexsort((*keys[::-1], *groups))
    changed = lambda arrays: np.logical_or.reduce([np.r_[True, x[order][1:] != x[order][:-1]] for x in arrays])
    at, starts = np.arange(len(order)), changed(groups)
    last = lambda flags: np.maximum.accumulate(np.where(flags, at, 0))
    rank = np.empty(len(order), int)
    rank[order] = last(starts | changed(keys)) - last(starts)
    return rank


def _can_lead(n: int) -> Column:
    """False for a row behind n others of its plant and tier in the same Arrow batch: it has no place among the first n. Ties stay."""
    def near_top(plant: pd.Series, kind: pd.Series, score: pd.Series, gap: pd.Series, place: pd.Series) -> pd.Series:
        keys = [np.nan_to_num(x.to_numpy(float), nan=np.inf, posinf=np.inf, neginf=-np.inf) for x in (score, gap, place)]
        return pd.Series(_rank([plant.to_numpy(), kind.to_numpy()], keys) < n) if len(plant) else pd.Series([], dtype=bool)
    first = F.lit(float("-inf"))
    return F.pandas_udf(near_top, "boolean")(
        F.coalesce(F.col("eia_id").cast("long"), F.lit(0)), F.coalesce(F.col("tier").cast("long"), F.lit(-1)) * 2 + F.col("eia_id").isNull().cast("long"),
        F.coalesce(-F.col("name_score"), first), F.coalesce(F.abs(F.col("mw") - F.col("ac_mw")), F.lit(float("inf"))), F.coalesce(F.col("ord").cast("double"), first))


def top_candidates(cands: DataFrame, c: dict) -> DataFrame:
    """The ten best names of a plant and tier, nearest MW first among equal names, with their `place` and the `item` that
    orders them. Rows that can't be among the ten go batch by batch, before anything is sorted: pairs come plant by plant
    (county_pairs), so some tens of a plant are left for the sort and the shuffle, however many pairs it has."""
    item = F.struct((-F.col("name_score")).alias("o"), F.coalesce(F.abs(F.col("mw") - F.col("ac_mw")), F.lit(float("inf"))).alias("e"), "ord", "unit_code", "unit_name", "mw",
                    "year", "name_score", "phase_ok", "year_ok")
    w = Window.partitionBy("eia_id", "tier").orderBy("item")
    few = cands.withColumn("_lead", _can_lead(c["max_candidates"])).filter("_lead").drop("_lead")
    return few.withColumn("item", item).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= c["max_candidates"])


def choose(cands: DataFrame, c: dict) -> DataFrame:
    """Per plant: tier rule, top ten names, best subset → (eia_id, tier, chosen array, err). err is null when no MW is
    known. Plants without candidates are absent."""
    ten = top_candidates(cands, c)
    per_tier = ten.groupBy("eia_id", "tier").agg(F.first("ac_mw").alias("ac_mw"), F.array_sort(F.collect_list("item")).alias("top"))
    first = per_tier.groupBy("eia_id").agg(F.min_by(F.struct("tier", "ac_mw", "top"), F.col("tier")).alias("f"))
    df = first.select("eia_id", F.col("f.tier").alias("tier"), F.col("f.ac_mw").alias("ac_mw"), F.col("f.top").alias("top"))
    df = df.withColumn("top", F.when(F.col("tier") == 2, F.slice("top", 1, 1)).otherwise(F.col("top")))
    df = df.withColumn("k", F.filter("top", lambda s: s["mw"].isNotNull())).withColumn("b", best_subset(c))
    clean = F.filter("top", lambda s: s["phase_ok"] & s["year_ok"])
    unknown = F.when(F.size(clean) > 0, clean).otherwise(F.col("top"))
    picked = F.expr("filter(transform(k, (s, i) -> if(shiftright(-b.o, size(k) - 1 - i) & 1 = 1, s, null)), s -> s is not null)")
    return df.select("eia_id", "tier", F.when(F.size("k") > 0, picked).otherwise(unknown).alias("chosen"), F.col("b.err").alias("err"))



# ---- claiming --------------------------------------------------------------------------------------------------------------
def standing(home: DataFrame, plants: DataFrame, units: DataFrame, c: dict, names: DataFrame | None = None) -> DataFrame:
    """(eia_id, line): the order in which plants claim, by the error of their best subset among the given units; plants
    without candidates or with units of unknown size come last, ties go by id."""
    lookers = plants.join(home.select("eia_id"), "eia_id", "left_anti")
    lead = choose(home.unionByName(far_candidates(lookers, units, c, names)), c).select("eia_id", F.col("err").alias("_e"))
    order = F.struct(F.col("_e").isNull().alias("n"), F.coalesce("_e", F.lit(0.0)).alias("e"), F.col("eia_id").alias("i"))
    return cut_lineage(plants.select("eia_id").join(lead, "eia_id", "left").select("eia_id", order.alias("line")), "line")


def assign(home: DataFrame, plants: DataFrame, units: DataFrame, c: dict, line: DataFrame | None = None, block: int = claims.BLOCK) -> DataFrame:
    """Best-fitting plants claim first. plants: plant_names output. Returns (eia_id, line, tier, chosen, err) for every
    plant; chosen is null when nothing was left. line: the order of claims where it rests on more units than can be
    claimed (`standing` over all of them).

    A plant looks at other counties when none of its own county's candidates is free. Units of other counties are kept by name, not
    for each plant: far pairs are made for those that are chosen alone. Strong names are found once, on distinct names."""
    names = cut_lineage(strong_names(plants, units, c), "names")
    line = standing(home, plants, units, c, names) if line is None else line
    decide = claims.one_by_one
    looking, far = _far_units(plants, units, names)
    taken = claims.settled(line.select(F.col("line.n").alias("late"), F.col("line.e").alias("lead"), "eia_id"), preferences(home, line), looking, far,
                           lambda g, plants, far: decide(g, c | {"plants": plants, "far": far}), block)[0]
    item = F.struct((-F.col("name_score")).alias("o"), F.coalesce(F.abs(F.col("mw") - F.col("ac_mw")), F.lit(float("inf"))).alias("e"), "ord", "unit_code", "unit_name", "mw",
                    "year", "name_score", "phase_ok", "year_ok")
    codes = taken.select("eia_id", "tier", F.explode("codes").alias("_c")).select("eia_id", "tier", claims.unit_key(F.col("_c")).alias("u"))
    away = codes.filter("tier = 3").select("eia_id", "u").distinct()
    picked = annotate(plants.join(away, "eia_id").join(names.withColumn("u", claims.unit_key(F.col("unit_code"))), ["plant_n", "u"]).drop("u")
                      .join(units.drop("county_n").withColumnsRenamed({"county": "unit_county"}), "unit_code").withColumn("same_county", F.lit(False)), c)
    pairs = home.unionByName(picked.withColumn("tier", F.lit(3)).select(*_CANDIDATE))
    chosen = pairs.withColumn("u", claims.unit_key(F.col("unit_code"))).join(codes, ["eia_id", "tier", "u"]).groupBy("eia_id").agg(F.array_sort(F.collect_list(item)).alias("chosen"))
    return cut_lineage(line.join(taken.select("eia_id", "tier", "err"), "eia_id", "left").join(chosen, "eia_id", "left").select("eia_id", "line", "tier", "chosen", "err"), "picks")


def _far_units(plants: DataFrame, units: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What plants look for in other counties, and the units there, once for each name (with its phase digits)."""
    name = F.concat_ws("|", F.array_join("want", ","), F.col("plant_n"))
    looking = plants.filter("county_n is not null and plant_n is not null").select("eia_id", name.alias("name"), F.col("county_n").alias("county"), F.col("ac_mw").cast("double").alias("ac_mw"), F.year("cod_first").alias("first_year"), F.year("cod_last").alias("last_year"))
    theirs = (plants.select("plant_n", "want", name.alias("name")).distinct().join(names, "plant_n").join(units, "unit_code").filter("county_n is not null")
              .select(claims.unit_key(F.col("unit_code")).alias("u"), "name", "unit_code", "name_score", F.col("county_n").alias("county"), F.col("mw").cast("double").alias("mw"), "ord",
                      F.coalesce(_phase_ok(), F.lit(False)).alias("phase_ok"), "year"))
    return looking, theirs


def preferences(pairs: DataFrame, line: DataFrame) -> DataFrame:
    """Every plant's candidates in the order in which it would take them, with its place in the line of claims."""
    gap = F.coalesce(F.nanvl(F.abs(F.col("mw") - F.col("ac_mw")), F.lit(float("inf"))), F.lit(float("inf")))
    order = Window.partitionBy("eia_id").orderBy(F.col("tier"), F.col("name_score").desc(), gap, F.col("ord").asc_nulls_last(), F.col("unit_code").asc_nulls_last())
    return (pairs.join(line.select("eia_id", F.col("line.n").alias("late"), F.col("line.e").alias("lead")), "eia_id").withColumn("place", F.row_number().over(order))
            .select("eia_id", "late", "lead", "place", claims.unit_key(F.col("unit_code")).alias("u"), "unit_code", "tier", "mw", "ac_mw", "phase_ok", "year_ok"))


def shared_units(picks: DataFrame, cands: DataFrame, plants: DataFrame, c: dict) -> DataFrame:
    """Plants left without a unit that stand behind a county unit another plant holds: strong name and joint MW that fits.
    One row per such plant: (eia_id, holder, unit, err, note)."""
    empty = picks.filter("chosen is null").select("eia_id", "line")
    held = picks.filter("chosen is not null").select(F.col("eia_id").alias("holder"), F.explode("chosen.unit_code").alias("unit_code"))
    mw = plants.select(F.col("eia_id").alias("holder"), F.col("ac_mw").alias("holder_mw"))
    hit = (cands.filter((F.col("same_county")) & (F.col("name_score") >= c["name_high"])).join(empty, "eia_id").join(held, "unit_code").join(mw, "holder")
           .withColumn("err", F.abs(F.col("ac_mw") + F.col("holder_mw") - F.col("mw")) / F.col("mw"))
           .filter(F.col("err") <= c["mw_tolerance_medium"]))
    pair = F.array_join(F.transform(F.array_sort(F.array("eia_id", "holder")), lambda v: v.cast("string")), ", ")
    g = lambda v: F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    note = F.concat(F.lit("one ERCOT unit shared by EIA plants ["), pair, F.lit("] ("), g(F.col("ac_mw")), F.lit(" + "), g(F.col("holder_mw")),
                    F.lit(" MW vs "), g(F.col("mw")), F.lit(" MW)"))
    unit = F.struct("unit_code", "unit_name", "mw", "year", "name_score", "phase_ok", "year_ok")
    return (hit.withColumn("note", note).groupBy("eia_id").agg(F.min_by(F.struct("line", "holder", unit.alias("unit"), "err", "note"), F.col("ord")).alias("s"))
            .select("eia_id", "s.*"))


def match_confidence(best_name: Column, err: Column, county_ok: Column, all_years: Column, c: dict) -> Column:
    e = F.coalesce(err, F.lit(float("inf")))
    high = county_ok & (best_name >= c["name_high"]) & (e <= c["mw_tolerance_high"])
    medium = county_ok & (((best_name >= c["name_medium"]) & (e <= c["mw_tolerance_medium"])) | (all_years & (e <= c["mw_tolerance_high"])))
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def crosswalk(plants: DataFrame, raw_units: DataFrame, cfg: dict, telemetry: DataFrame | None = None, nodes: DataFrame | None = None,
              existing: DataFrame | None = None) -> DataFrame:
    """The whole match table. Verified rows are kept as they are, their plants skipped and their units taken."""
    c = cfg["crosswalk"]
    todo = plants.filter(F.col("filter_status").isin("pass", "review"))
    units = cut_lineage(market_units(raw_units, c), "units")
    if existing is not None:
        verified = existing.filter(blank_to_null(F.col("verified_by")).isNotNull())
        todo = todo.join(verified.select(F.col("eia_plant_id").try_cast("bigint").alias("eia_id")), "eia_id", "left_anti")
        free_units = units.join(verified.select(F.col("ercot_resource_name").alias("unit_code")), "unit_code", "left_anti")
    else:
        verified, free_units = None, units
    named = cut_lineage(plant_names(todo, c), "names")
    cands = cut_lineage(home_candidates(named, free_units, c), "cands")
    # plants stand in line by their fit among all units, verified ones included; they claim from what is free
    line = None if verified is None else standing(cut_lineage(home_candidates(named, units, c), "all-cands"), named, units, c)
    picks = assign(cands, named, free_units, c, line)
    shared = cut_lineage(shared_units(picks, cands, plants, c), "shared")
    # the holder's row takes error and note of the last plant that joined it
    holder = shared.groupBy("holder").agg(F.max_by(F.struct("err", "note"), F.col("line")).alias("h")).select(F.col("holder").alias("eia_id"), F.col("h.err").alias("h_err"), F.col("h.note").alias("h_note"))
    s = shared.select("eia_id", F.col("unit").alias("s_unit"), F.col("err").alias("s_err"), F.col("note").alias("s_note"))
    methods = {1: "auto:name+county", 2: "auto:mw+year+county", 3: "auto:name(no county match)"}
    method = F.when(F.col("s_unit").isNotNull(), "auto:shared unit")
    for tier, label in methods.items():
        method = method.when(F.col("tier") == tier, label)
    own = F.transform("chosen", lambda x: F.struct(x["unit_code"].alias("unit_code"), x["unit_name"].alias("unit_name"), x["mw"].alias("mw"), x["year"].alias("year"),
                                                   x["name_score"].alias("name_score"), x["phase_ok"].alias("phase_ok"), x["year_ok"].alias("year_ok")))
    df = (todo.select("eia_id", "plant_name", "county", "ac_mw", "cod_first").join(picks.drop("line"), "eia_id").join(holder, "eia_id", "left").join(s, "eia_id", "left")
          .withColumn("units", F.when(F.col("s_unit").isNotNull(), F.array("s_unit")).otherwise(own))
          .withColumn("err", F.coalesce("s_err", "h_err", "err")).withColumn("note", F.coalesce("s_note", "h_note"))
          .withColumn("match_method", method.otherwise("no candidate")))
    conf = match_confidence(F.array_max(F.col("units.name_score")), F.col("err"), (F.col("tier") != 3) | F.col("s_unit").isNotNull(),
                            F.forall("units", lambda u: u["year_ok"]), c)
    df = df.withColumn("match_confidence", F.when(F.col("units").isNull(), "none").when(F.col("note").isNotNull() & (conf == "high"), "medium").otherwise(conf))
    rows = df.withColumn("u", F.explode_outer("units")).withColumn("_key", F.upper(F.col("u.unit_code")))
    if telemetry is not None:
        t = telemetry.select(F.upper("resource_name").alias("_key"), "max_hsl_mw").withColumn("_seen", F.lit(True))
        rows = rows.join(t, "_key", "left")
        seen = F.when(F.col("u").isNotNull(), F.coalesce("_seen", F.lit(False)))
        missing = F.when(~seen, "not in SCED PVGR list")
        rows = rows.withColumn("sced_coverage", seen).withColumn("sced_max_hsl_mw", F.col("max_hsl_mw")).withColumn("note", blank_to_null(F.concat_ws("; ", "note", missing)))
    else:
        rows = rows.withColumn("sced_coverage", F.lit(None).cast("boolean")).withColumn("sced_max_hsl_mw", F.lit(None).cast("double"))
    if nodes is not None:
        rows = rows.join(nodes.select(F.col("resource").alias("_key"), F.col("node").alias("_node")), "_key", "left")
    else:
        rows = rows.withColumn("_node", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    new = rows.select(
        F.col("eia_id").cast("bigint").alias("eia_plant_id"), F.col("plant_name").alias("eia_plant_name"), F.col("u.unit_code").alias("ercot_resource_name"),
        F.col("_node").alias("ercot_settlement_point"), "county", F.col("ac_mw").alias("ac_mw_eia"), F.col("u.mw").alias("ac_mw_ercot"),
        F.date_format("cod_first", "yyyy-MM-dd").alias("cod_eia"), "match_method", "match_confidence", none.alias("verified_by"), none.alias("verified_on"),
        F.col("note").alias("notes"), F.col("u.unit_name").alias("cdr_unit_name"), F.col("u.year").cast("double").alias("cdr_year"),
        F.bround("u.name_score", 1).alias("name_score"), F.when(F.col("u").isNotNull(), F.bround(100 * F.col("err"), 1)).alias("mw_error_pct"), "sced_coverage", "sced_max_hsl_mw")
    if verified is None:
        return new
    kinds = dict(new.dtypes)
    have = set(verified.columns)
    kept = verified.select(*[(F.col(x).try_cast(kinds[x]) if x in have else F.lit(None).cast(kinds[x])).alias(x) for x in CROSSWALK_COLUMNS])
    return kept.unionByName(new)


# ---- review ------------------------------------------------------------------------------------------------------------------
def held_by(pairs: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Adds held_by: the plant with the least id that holds the unit in the match table."""
    holders = (xwalk.filter("ercot_resource_name is not null").groupBy(F.col("ercot_resource_name").alias("unit_code"))
               .agg(F.min_by("eia_plant_name", F.struct(F.col("eia_plant_id").try_cast("bigint").alias("i"), F.col("eia_plant_id").cast("string").alias("t"))).alias("held_by")))
    return pairs.join(holders, "unit_code", "left")


def candidate_review(asked: DataFrame, raw_units: DataFrame, xwalk: DataFrame, cfg: dict, telemetry: DataFrame, nodes: DataFrame) -> DataFrame:
    """For the plants asked about (rows of the plants table, few or all): units of their county or with a similar name; who
    holds each, its peak and node."""
    c = cfg["crosswalk"]
    keep = ["eia_id", "plant_name", "ac_mw", "unit_code", "unit_name", "unit_county", "mw", "year", "name_score", "county_match"]
    named = cut_lineage(plant_names(asked, c), "asked")
    units = cut_lineage(market_units(raw_units, c), "units")
    home = scored_pairs(named, units).withColumn("county_match", F.lit(True))
    alike = cut_lineage(alike_names(named.select("plant_n"), _unit_names(units), c["review_score"]), "alike")
    u = units.withColumnsRenamed({"county": "unit_county", "county_n": "unit_county_n"})
    hits = [alike.select("plant_n", F.col("other").alias(k), "s").join(u, k).select("plant_n", "unit_code", "s") for k in ("name_n", "code_n")]
    best = hits[0].union(hits[1]).groupBy("plant_n", "unit_code").agg(F.max("s").alias("name_score"))
    away = (named.join(best, "plant_n").join(u, "unit_code").withColumn("county_match", F.col("county_n") == F.col("unit_county_n"))
            .filter("county_match is null or not county_match"))
    return (held_by(home.select(*keep).unionByName(away.select(*keep)), xwalk)
            .join(telemetry.select(F.col("resource_name").alias("unit_code"), F.col("max_hsl_mw").alias("sced_peak_mw")), "unit_code", "left")
            .withColumn("_k", F.upper("unit_code")).join(nodes.select(F.col("resource").alias("_k"), "node"), "_k", "left").drop("_k"))


def free_unit_sets(review: DataFrame, c: dict, first: int = 6) -> DataFrame:
    """(eia_id, place, n_units, total_mw, err, codes): for each plant asked about, the best sets of up to `review_units` free
    units whose MW fits within `review_mw_error`. Free: held by nobody or by the plant itself, with known MW."""
    free = review.filter((F.col("held_by").isNull() | (F.col("held_by") == F.col("plant_name"))) & (F.col("mw") > 0)).select("eia_id", "ac_mw", "unit_code", "mw")
    return unit_sets.free_unit_sets(free, c["review_units"], c["review_mw_error"], first)


def apply_decisions(xwalk: DataFrame, decisions: DataFrame, initials: str, today: str) -> DataFrame:
    """A table of decisions (action, key, value, note) applied to the match table: accept_high, accept_medium, accept, set,
    no_resource, set_node, undo. Accepting, setting and undoing follow that order; ids that do not exist are an error the
    caller finds with unknown_decisions."""
    d = decisions.select("action", F.trim("key").alias("k"), "value", "note")
    by = lambda action: d.filter(F.col("action") == action)
    flag = lambda action: by(action).agg(F.count(F.lit(1)) > 0).scalar()
    x = xwalk.withColumn("_id", F.col("eia_plant_id").cast("string"))
    unverified = blank_to_null(F.col("verified_by")).isNull()
    level = (((F.col("match_confidence") == "high") & flag("accept_high")) | ((F.col("match_confidence") == "medium") & flag("accept_medium")))
    acc = by("accept").select(F.col("k").alias("_id")).distinct().withColumn("_acc", F.lit(True))
    x = x.join(acc, "_id", "left")
    stamp = is_true((level & F.col("ercot_resource_name").isNotNull() & unverified) | F.col("_acc"))
    x = x.withColumn("verified_by", F.when(stamp, initials).otherwise(F.col("verified_by"))).withColumn("verified_on", F.when(stamp, today).otherwise(F.col("verified_on"))).drop("_acc")
    node = by("set_node").groupBy("k").agg(F.max("value").alias("_node"))
    sets = by("set").groupBy("k").agg(F.max("value").alias("_codes"), F.max("note").alias("_note"))
    none = by("no_resource").groupBy("k").agg(F.max(F.coalesce("note", F.lit("no ERCOT resource"))).alias("_none"))
    x = x.join(sets, F.col("_id") == sets["k"], "left").drop("k").join(none, F.col("_id") == none["k"], "left").drop("k")
    keep = x.filter("_codes is null and _none is null")
    rest = [c for c in CROSSWALK_COLUMNS if c in xwalk.columns]
    base = (x.filter("_codes is not null or _none is not null").groupBy("_id", "_codes", "_note", "_none")
            .agg(F.min_by(F.struct(*rest), F.coalesce("ercot_resource_name", F.lit(""))).alias("_r")).select("_id", "_codes", "_note", "_none", "_r.*"))
    manual = base.filter("_codes is not null").withColumn("ercot_resource_name", F.explode(F.filter(F.transform(F.split("_codes", r"\+"), lambda v: F.trim(v)), lambda v: v != "")))
    kinds = dict(xwalk.dtypes)
    wiped = ["ercot_settlement_point", "ac_mw_ercot", "cdr_unit_name", "cdr_year", "name_score", "mw_error_pct", "sced_coverage", "sced_max_hsl_mw"]
    manual = manual.withColumns({w: F.lit(None).cast(kinds[w]) for w in wiped if w in kinds})
    manual = manual.withColumn("match_confidence", F.lit("high")).withColumn("notes", F.coalesce("_note", F.lit("manual match")))
    gone = (base.filter("_none is not null and _codes is null").withColumn("ercot_resource_name", F.lit(None).cast("string"))
            .withColumn("ercot_settlement_point", F.lit(None).cast("string")).withColumn("match_confidence", F.lit("none")).withColumn("notes", F.col("_none")))
    made = manual.unionByName(gone).withColumn("match_method", F.lit("manual")).withColumn("verified_by", F.lit(initials)).withColumn("verified_on", F.lit(today))
    out = keep.select("_id", *rest).unionByName(made.select("_id", *rest))
    out = out.join(node, out["ercot_resource_name"] == node["k"], "left").drop("k").withColumn("ercot_settlement_point", F.coalesce("_node", "ercot_settlement_point"))
    undo = by("undo").select(F.col("k").alias("_id")).distinct().withColumn("_undo", F.lit(True))
    out = out.join(undo, "_id", "left")
    clear = lambda col: F.when(F.col("_undo"), None).otherwise(F.col(col)).alias(col)
    return out.select(*[clear(r) if r in ("verified_by", "verified_on") else F.col(r) for r in rest])


def unknown_decisions(xwalk: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that name a plant or resource the match table does not have."""
    ids = xwalk.select(F.col("eia_plant_id").cast("string").alias("key")).union(xwalk.select(F.col("ercot_resource_name"))).distinct()
    return decisions.filter(~F.col("action").isin("accept_high", "accept_medium")).join(ids, "key", "left_anti")


def crosswalk_status(xwalk: DataFrame, plants: DataFrame) -> DataFrame:
    """Plants verified and to review, and the share verified among passing plants of the upper tiers: one row."""
    per = xwalk.groupBy(F.col("eia_plant_id").cast("bigint").alias("eia_id")).agg(F.min(blank_to_null(F.col("verified_by")).isNotNull()).alias("v"))
    j = per.join(plants.select("eia_id", "tier", "filter_status"), "eia_id", "left")
    top = is_true(F.col("tier").isin("T1b", "T1a", "T2") & (F.col("filter_status") == "pass"))
    return j.agg(F.count(F.lit(1)).alias("plants"), F.count_if("v").alias("verified"), F.count_if(~F.col("v")).alias("to_review"), F.count_if(top).alias("top_tier"),
                 F.count_if(top & F.col("v")).alias("top_tier_verified"))
