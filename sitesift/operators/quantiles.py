"""Exact group quantiles that never sit in one task.

Equal values collapse first (counts with map-side partials). A coarse bucket of the value gives per-group bucket totals;
their running sums say which buckets hold the wanted ranks, and only those buckets' values are ordered. A group that holds
most of the data is thus spread over its buckets, and the answer is still the exact linear interpolation.
"""

from pyspark.sql import DataFrame, Window, functions as F


def group_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float], step: float) -> DataFrame:
    """keys + one column per entry of probs (name → probability). `step` is the bucket width: a unit fine enough that one
    bucket's distinct values are few; it moves work around, never the result. Groups without a known value are absent."""
    keys = list(keys)
    alone = not keys
    src = df.filter(F.col(value).isNotNull())
    if alone:
        keys, src = ["_g"], src.withColumn("_g", F.lit(0))
    counts = (src.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_b", F.floor(F.col("_v") / step)))
    running = Window.partitionBy(*keys).orderBy("_b")
    buckets = (counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
               .withColumn("_end", F.sum("_bc").over(running.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("_n", F.sum("_bc").over(Window.partitionBy(*keys)))
               .withColumn("_start", F.col("_end") - F.col("_bc")))
    marks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    wanted = (buckets.withColumn("_q", F.explode(marks))
              .withColumn("_pos", F.col("_q.p") * (F.col("_n") - 1))
              .withColumn("_lo", F.floor("_pos"))
              .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
              .filter("(_lo >= _start and _lo < _end) or (_hi >= _start and _hi < _end)")
              .groupBy(*keys, "_b", "_start")
              .agg(F.collect_list(F.struct(F.col("_q.name").alias("name"), "_pos", "_lo", "_hi")).alias("_qs")))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counts.join(wanted, [*keys, "_b"])
              .withColumn("_to", F.col("_start") + F.sum("_c").over(inside))
              .withColumn("_from", F.col("_to") - F.col("_c"))
              .withColumn("_q", F.explode("_qs")))
    at = lambda r: F.when((F.col(f"_q.{r}") >= F.col("_from")) & (F.col(f"_q.{r}") < F.col("_to")), F.col("_v"))
    frac = F.col("_q._pos") - F.col("_q._lo")
    out = ranked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_q.name") == n, at("_lo"))).alias(f"_lo_{n}") for n in probs], *[
        F.max(F.when(F.col("_q.name") == n, at("_hi"))).alias(f"_hi_{n}") for n in probs], *[
        F.max(F.when(F.col("_q.name") == n, frac)).alias(f"_fr_{n}") for n in probs])
    cols = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n) for n in probs]
    return out.select(*([] if alone else keys), *cols)


def quantile_row(df: DataFrame, value: str, probs: dict[str, float], step: float) -> DataFrame:
    """Whole-table quantiles: at most one row."""
    return group_quantiles(df, [], value, probs, step)
