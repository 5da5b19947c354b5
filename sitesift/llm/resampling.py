"""Resampling towards a target: hashed n-gram counts of a corpus and of target texts, their log ratios, a weighted draw.

Separators collapse to single spaces; then one regular expression per length, matched overlapped and bounded by lookarounds,
gives the span of every run of words, and the span's bytes are counted under their CRC's bucket. Texts are scanned once: each row's
bucket counts are written and serve both the corpus totals and the row's own weight.

The draw adds Gumbel noise from a hash of the id to the weight and keeps the highest scores, which is drawing without
replacement in proportion to exp(weight / 1000). The cut is found from counts per score; only rows at or above it are ordered,
dealt by range.
"""

import collections
import sys
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..operators.serve import positions
from .common import out, row_key, utf8, written
from .words import LOWER, WORD_BYTES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHORTEST, LONGEST, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 1, 10_000, 2024, 10, 20
_APART = bytes(LOWER[c] if WORD_BYTES[c] else 32 for c in range(256))


def gram_pattern(n: int):
    """n consecutive words of a text whose separators are single spaces."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def gram_buckets(texts: DataFrame, id_col: str, text_col: str, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(id, rid, n_words, n_features, counts): each row's words, runs of words, and how many of them fall in which bucket."""
    if not 1 <= shortest <= longest or buckets < 1:
        raise ValueError("1 <= shortest <= longest and a bucket are needed")
    pair = pa.struct([("bucket", pa.int32()), ("times", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("counts", pa.list_(pair))])

    def run(batches):
        patterns = [gram_pattern(n) for n in range(shortest, longest + 1)]
        for b in batches:
            n_words, n_features, bucket, times, ends = [], [], [], [], [0]
            for t in utf8(b, "text"):
                words = t.translate(_APART).split()
                line = b" ".join(words)
                seen = collections.Counter(m[0] for p in patterns for m in p.finditer(line, overlapped=True))
                tally: dict[int, int] = {}
                for gram, n in seen.items():
                    k = zlib.crc32(gram) % buckets
                    tally[k] = tally.get(k, 0) + n
                n_words.append(len(words)), n_features.append(seen.total())
                bucket += tally.keys()
                times += tally.values()
                ends.append(len(bucket))
            pairs = pa.StructArray.from_arrays([pa.array(bucket, pa.int32()), pa.array(times, pa.int64())], fields=list(pair))
            yield out(schema, id=b.column("id"), rid=b.column("rid"), n_words=n_words, n_features=n_features, counts=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))

    base = texts.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "id long, rid long, n_words long, n_features long, counts array<struct<bucket:int,times:long>>")


def bucket_totals(counted: DataFrame) -> DataFrame:
    return counted.select(F.explode("counts").alias("c")).groupBy("c.bucket").agg(F.sum("c.times").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the log of the target's share over the corpus's, each with one feature more
    in every bucket, rounded down."""
    share = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = share.join(bucket_totals(corpus).withColumnRenamed("n", "s"), "bucket", "left").join(bucket_totals(target).withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    s_all, t_all = (F.lit(x.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0]).cast("double") for x in (corpus, target))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    return both.select("bucket", F.floor(1000 * F.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))).cast("long").alias("gain"))


def weighted(counted: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, rid, n_words, n_features, weight): the mean gain of a row's features, rounded down; 0 without any."""
    shared = counted.sparkSession.sparkContext.broadcast(gains)
    schema = pa.schema([(c, pa.int64()) for c in ("id", "rid", "n_words", "n_features", "weight")])

    def run(batches):
        for b in batches:
            lists = b.column("counts")
            pairs = lists.flatten()
            part = shared.value[pairs.field("bucket").to_numpy()] * pairs.field("times").to_numpy()
            total = np.append(0, np.cumsum(part))
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            n = b.column("n_features").to_numpy()
            weight = np.where(n > 0, (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1), 0)
            yield out(schema, weight=weight, **{c: b.column(c) for c in schema.names[:-1]})

    return counted.mapInArrow(run, "id long, rid long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", shortest: int = SHORTEST, longest: int = LONGEST,
              buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank numbers the drawn rows from the highest score on, others
    have none.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; a null text has none. Rows of at least
    `least_words` words can be drawn, `percent` of them are; equal scores go by id, a null id last (its noise is that of an empty
    id). Repeated rows count, and are drawn, as often as they are there. No target text: every feature counts as seldom as it is
    common. The gains, one number a bucket, are all that passes through the driver besides counts per score.
    """
    corpus = written(gram_buckets(docs, id_col, text_col, shortest, longest, buckets), "buckets")
    wanted = written(gram_buckets(target.select(F.lit(None).cast("long").alias("none"), F.col(target_text).alias("text")), "none", "text", shortest, longest, buckets), "target")
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(corpus, wanted, buckets).collect():
        gains[r["bucket"]] = r["gain"]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = written(weighted(corpus, gains).withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("n_words") >= least_words
    # scores are thousandths of logs: as many different ones as the logs' range has, however many rows
    sizes = sorted(((r["score"], r["n"]) for r in rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in sizes) // 100
    cut, above = None, 0
    for score, n in sizes:
        if above >= drawn:
            break
        cut, above = score, above + n
    high = fit & (F.col("score") >= cut) if cut is not None else F.lit(False)
    placed = positions(rows.where(high), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("rid").asc()], "rank")
    of = lambda df, rank: df.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", rank.cast("long").alias("rank"))
    return of(placed, F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(of(rows.where(~high), F.lit(None)))
