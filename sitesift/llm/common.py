"""What the operators share: small Arrow batches, per-worker caches, tables written once to the shared folder."""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage, prepare, shared_dir

# tasks get these helpers with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_ROWS, BATCH_BYTES = 1000, "16m"


def ready(spark: SparkSession) -> SparkSession:
    """Pin UTC and bound the memory of an Arrow batch, however long its texts are."""
    prepare(spark)
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The table once written to the shared folder and read again: computed once, and lost executors cost a re-read."""
    shared_dir(df.sparkSession)
    return cut_lineage(df, f"llm-{label}")


def per_worker(name: str, make):
    """make() once in a Python worker: functions arrive anew with each task, the worker stays."""
    store = sys.__dict__.setdefault("_sitesift_llm", {})
    if name not in store:
        store[name] = make()
    return store[name]


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def out(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """One 64-bit key for an id and its text: rows that share an id keep apart, repeated rows fall together."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")))
