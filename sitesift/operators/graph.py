"""Connected components of an edge table by alternating large-star and small-star steps, all in Spark."""

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b: long) to (node, label): label is the smallest node of the component.

    Every step links nodes to the smallest one they know, so the edges end as stars round the smallest node, after a
    number of rounds that grows with the logarithm of the graph, not with its longest path. A round's edges are written
    to the shared folder; only their count and checksum reach the driver. Self-loops and nulls are left out; an empty
    table gives an empty one. Degrees are met by a minimum with partial aggregation and a join that Spark can split.
    """
    edges = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut_lineage(large.join(low, "a").select(F.explode(pair).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "edges")
        after = _state(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
