"""Typed, checked, versioned publishing to shared storage."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.nulls import nan_to_null


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns and types of the schema; absent ones null, NaN null."""
    have = set(df.columns)
    return nan_to_null(df).select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def domain_violations(df: DataFrame, domains: dict[str, list], required=()) -> DataFrame:
    """(column, value) of every value outside its allowed list and every missing required value, counted."""
    tests = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, v in domains.items()]
    tests += [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"))) for c in required]
    return (df.select(F.explode(F.array_compact(F.array(*tests))).alias("v")).groupBy("v.column", "v.value").agg(F.count(F.lit(1)).alias("n_rows")))


def publish(df: DataFrame, path: str, key: str, run_id: str) -> int:
    """Write the run beside earlier ones, verify key uniqueness and count, then add a pointer of its own: pointers are
    numbered and never overwritten, so at every moment readers find either the old run or the new one."""
    spark = df.sparkSession
    target = f"{path}/run_id={run_id}"
    df.write.mode("overwrite").parquet(target)
    n, keys = spark.read.parquet(target).agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    if n != keys:
        raise ValueError(f"{path}: {n} rows but {keys} distinct {key} in run {run_id}")
    taken = [c.getPath().getName() for c in _status(spark, f"{path}_pointers")[1]]  # half-written ones of a lost driver too
    version = max([int(c[len("version="):]) for c in taken if c.startswith("version=")], default=0) + 1
    row = spark.createDataFrame([(run_id, n)], "run_id string, n_rows bigint").coalesce(1)
    row.write.mode("errorifexists").parquet(f"{path}_pointers/version={version:09d}")
    return n


def _status(spark: SparkSession, path: str):
    """(file system, children) of a folder in any store Spark reads; no children where there is no folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, (list(fs.listStatus(place)) if fs.exists(place) else [])


def children_of(spark: SparkSession, pattern: str, name: str) -> list:
    """File statuses of the entry `name` in every folder that a glob pattern names; none where there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/{name}")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return list(found) if found else []


def pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, folder) of the complete pointers, ascending: those whose writer has committed."""
    found = []
    fs, children = _status(spark, f"{path}_pointers")
    for child in children:
        name = child.getPath().getName()
        if name.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(child.getPath(), "_SUCCESS")):
            found.append((int(name[len("version="):]), child.getPath().toString()))
    return sorted(found)


def current(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest published run. Their count was verified before its pointer was written."""
    found = pointers(spark, path)
    if not found:
        raise FileNotFoundError(f"{path}: nothing is published")
    run_id = spark.read.parquet(found[-1][1]).first()["run_id"]
    return spark.read.parquet(f"{path}/run_id={run_id}").withColumn("run_id", F.lit(run_id))


def drop_stale_runs(spark: SparkSession, path: str) -> int:
    """Remove every run but the published one, as a load that replaces earlier rows does."""
    keep = f"run_id={spark.read.parquet(pointers(spark, path)[-1][1]).first()['run_id']}"
    fs, children = _status(spark, path)
    gone = [c.getPath() for c in children if c.getPath().getName() != keep]
    return sum(bool(fs.delete(p, True)) for p in gone)


def plant_rows(plants: DataFrame, columns: list[str], metrics: DataFrame | None = None, metric_columns=()) -> DataFrame:
    """Pass and review plants in the published columns. Metric columns appear only where metrics are given, and then come
    from them alone; a wanted column that no table has is null."""
    p = plants.filter(F.col("filter_status").isin("pass", "review"))
    wanted = list(columns)
    if metrics is not None:
        have = [c for c in metric_columns if c in metrics.columns]
        p = p.drop(*[c for c in metric_columns if c in p.columns]).join(metrics.select("eia_id", *have), "eia_id", "left")
        wanted += list(metric_columns)
    return p.select(*[F.col(c) if c in p.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def write_layer(df: DataFrame, root: str, name: str) -> str:
    """One Parquet table per layer."""
    path = f"{root}/layers/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def manifest(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(name, n_rows, checksum) of stored tables; the checksum does not depend on the order of rows."""
    rows = []
    for name in names:
        t = spark.read.parquet(f"{root}/{name}")
        rows.append(t.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")).cast("string").alias("checksum")).select(F.lit(name).alias("name"), "n_rows", "checksum"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def changed_since(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Tables that are missing or differ from a stored manifest."""
    n = now.withColumnsRenamed({"n_rows": "_n", "checksum": "_c"})
    return stored.join(n, "name", "left").filter("not (n_rows <=> _n and checksum <=> _c)").select("name")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
