"""A corpus pipeline of five stages over `documents`; each stage's result is written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents, the last
one the encoded corpus.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sitesift.llm import bpe, decontam, langid, simhash, suffixes
from sitesift.llm.common import ready, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: null, without letters, or fitting two languages equally well."""
    ready(spark)
    return langid.accepted(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the least id; repeated rows of it become one. Rows without an
    id stay unless a row with an id has the same text; equal ones become one."""
    ready(spark)
    docs = docs.select(COLUMNS)
    ids = simhash.near_duplicates(docs).where("doc_id = component_id OR component_id IS NULL").select("doc_id")
    kept = docs.join(ids.where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    nameless = docs.where("doc_id IS NULL").join(docs.where("doc_id IS NOT NULL").select("text").distinct(), "text", "left_anti")
    return kept.unionByName(nameless.select(COLUMNS)).dropDuplicates()


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more stay where they occur first and are cut elsewhere; n_chars follows the text."""
    ready(spark)
    cut = suffixes.without_repeats(docs.select(COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontam.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    ready(spark)
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select(F.col("id").alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_free", benchmark_free), ("encoded", encoded)]

#: compression, SimHash and BPE cannot be said in SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
