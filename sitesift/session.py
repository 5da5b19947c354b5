"""Session settings and the two places where the library touches shared storage."""

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_SCRATCH: set[str] = set()


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "sitesift") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", shuffle_partitions)
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: instants are read and shown in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names in spark.checkpoint.dir.

    A session on one machine (tests, the bench) may leave it unset and gets a folder of its own; on a cluster an unset
    folder is an error, since files on one machine's disk are lost to all others.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sitesift-local-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's own part of the shared folder; the part goes when the driver ends."""
    app = re.sub(r"\W", "-", spark.sparkContext.applicationId)
    base = f"{shared_dir(spark).rstrip('/')}/sitesift/{app}"
    if base not in _SCRATCH:
        _SCRATCH.add(base)
        atexit.register(clear_scratch, spark, base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession, base: str) -> None:
    """Delete what one application wrote; files that cannot be reached any more are left to the folder's own clean-up."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as gone:  # the JVM has ended before this hook
        print(f"scratch folder {base} stays: {type(gone).__name__}")
    _SCRATCH.discard(base)


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write once to shared storage and read back: a lost executor costs a re-read, not a replay of the plan, and the
    plan is computed once (a checkpoint would run it twice)."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Partition by cols for work that is heavy per row: few bytes can still mean much computing, so the number of parts
    is set by the cores (or the configured shuffle width where that is more) and is not merged again by size."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *cols)
