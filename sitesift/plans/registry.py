"""Registered queries: a Spark plan over the driver tables next to the SQL that must give the same rows.

A view is a SELECT in the SQL that Spark and DuckDB share; both sides read the same derived input through it.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()
VIEWS: dict[str, str] = {}
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def _needs(sql: str) -> list[str]:
    """Views a text mentions, dependencies first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            for n in [*_needs(VIEWS[name]), name]:
                if n not in out:
                    out.append(n)
    return out


def with_views(sql: str) -> str:
    """The text behind a WITH clause holding every view it mentions; a leading WITH of its own is kept."""
    parts = [f"{n} AS (\n{VIEWS[n]}\n)" for n in _needs(sql)]
    body = sql.strip()
    if not parts:
        return body
    recursive = re.match(r"(?is)with\s+recursive\s+", body)
    plain = re.match(r"(?is)with\s+", body)
    head = "WITH RECURSIVE " if recursive else "WITH "
    lead = recursive or plain
    joint = ",\n".join(parts)
    return f"{head}{joint}" + (",\n" + body[lead.end():] if lead else "\n" + body)


class Tables:
    """Base tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        for t in BASE:
            if re.search(rf"\b{t}\b", full):
                self[t].createOrReplaceTempView(t)
        return self.spark.sql(full)


def query(name: str, sql: str | None = None):
    """Register fn(tables) under a name, with its oracle SQL where one exists."""
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def oracle() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLE.items()}
