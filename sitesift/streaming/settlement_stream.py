"""New telemetry files → stored rows by day → 15-minute energy, re-settled for the days that changed."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.settlement import interval_energy, pv_telemetry
from ..sources.publish import children_of

SPREAD = 16  # writers of one day: a day is never one task's work
DIGEST = "operating_day date, delivery string, state string"


def stored_rows(rows: DataFrame) -> DataFrame:
    """Of a resource and instant only the rows of the latest batch that brought it."""
    newest = rows.groupBy("resource_name", "utc").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["resource_name", "utc", "batch"], "left_semi")


def day_rows(spark: SparkSession, raw: str, schema, days: list[str], batch: str = "") -> DataFrame:
    """Stored rows of the named days alone: other days' folders are neither listed nor opened."""
    paths = [f"{raw}/operating_day={d}{batch}" for d in days]
    return spark.read.schema(schema).option("basePath", raw).parquet(*paths)


def day_digests(rows: DataFrame, name: str) -> DataFrame:
    """(operating_day, digest) as text: count and sum of row hashes, the same for every order of the rows."""
    cols = sorted(c for c in rows.columns if c not in ("operating_day", "batch"))
    total = F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))
    return rows.groupBy("operating_day").agg(F.concat_ws("/", F.count(F.lit(1)).cast("string"), total.cast("string")).alias(name))


def _days_of(spark: SparkSession, raw: str, number: int) -> list[str]:
    """Days in which a batch stored rows, by the names of their folders. Rows without a day have none and are not settled."""
    found = (c.getPath().getParent().getName() for c in children_of(spark, f"{raw}/operating_day=*", f"batch={number}"))
    return sorted(d.partition("=")[2] for d in found if "__HIVE_DEFAULT" not in d)


def settle_days(spark: SparkSession, source: str, schema, out: str, checkpoint: str, cfg: dict):
    """File stream of telemetry. A batch's rows are stored under its number, so a replayed batch overwrites only itself; then
    every day whose rows it changed is settled again from all stored rows of the day. Files of one day may so arrive in any
    number of batches, a corrected row replaces the earlier one, and days that a file repeats unchanged are left alone.

    Beside the rows stands a small table of digests, a row a day, a version a batch: what the day's latest delivery held, and
    from which rows it was settled. A day that repeats its latest delivery is known by the first and its earlier rows are not
    read; for any other day of the batch the rows that now count are compared with the second. Only the batch's own days are
    read. The version is written last: a batch that was broken off is done again, and a missing version costs only work."""
    raw, seen = f"{out.rstrip('/')}_rows", f"{out.rstrip('/')}_digests"

    def settle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = pv_telemetry(batch, cfg).withColumn("operating_day", F.to_date("operating_day"))
        spread = lambda df: df.repartition("operating_day", F.pmod(F.xxhash64("resource_name"), F.lit(SPREAD)))
        put = lambda df, path, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        put(spread(rows.withColumn("batch", F.lit(number).cast("long"))), raw, "operating_day", "batch")
        stored = rows.schema.add("batch", "long")
        days = _days_of(session, raw, number)
        before = f"{seen}/batch={number - 1}"
        old = session.read.schema(DIGEST).parquet(before) if children_of(session, before, "_SUCCESS") else session.createDataFrame([], DIGEST)
        if not days:
            old.coalesce(1).write.mode("overwrite").parquet(f"{seen}/batch={number}")
            return
        delivered = (day_digests(day_rows(session, raw, stored, days, f"/batch={number}"), "delivery")
                     .join(old.withColumnsRenamed({"delivery": "_delivery", "state": "_state"}), "operating_day", "left"))
        last = {str(r[0]): r for r in delivered.collect()}  # a row for each calendar day of the batch
        asked = [d for d, r in last.items() if r["delivery"] != r["_delivery"]]
        state = {d: r["_state"] for d, r in last.items()}
        if asked:
            now = lambda which: stored_rows(day_rows(session, raw, stored, which))
            state |= {str(r[0]): r[1] for r in day_digests(now(asked), "state").collect()}
            changed = [d for d in asked if state[d] != last[d]["_state"]]
            if changed:
                put(spread(interval_energy(now(changed).drop("batch"), cfg)), out, "operating_day")
        mine = session.createDataFrame([(r[0], r["delivery"], state[d]) for d, r in last.items()], DIGEST)
        (old.join(mine.select("operating_day"), "operating_day", "left_anti").unionByName(mine).coalesce(1)
         .write.mode("overwrite").parquet(f"{seen}/batch={number}"))

    return (spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(settle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
