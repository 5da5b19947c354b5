"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks boundaries; chunk sizes are normalised: a stricter mask before the normal size, a
looser one after it, never under the least or over the greatest size. Inserting or removing bytes moves boundaries only near by.
A fingerprint is the set of chunk digests, each with the bytes it covers in the text; containment is the share of one
fingerprint's bytes whose digests are in the other.
"""

import hashlib
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import out
from .words import mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST, NORMAL, GREATEST = 32, 96, 384
STRICT, LOOSE = 0x003F00C0, 0x003C0000  # eight bits, four of them: 1 in 256 and 1 in 16
GEAR = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
PART = 1 << 22


def _hits(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of bytes at which the loose and the strict mask are met; h[i] = sum of GEAR[data[i-j]] << j for j < 32."""
    loose, strict = [], []
    for low in range(0, len(data), PART):
        from_ = max(0, low - 31)
        h = GEAR[data[from_:low + PART]]
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k] << np.uint32(k)
        h = h[low - from_:]
        at = np.flatnonzero(h & np.uint32(LOOSE) == 0)
        loose.append(at + low + 1)
        strict.append(at[h[at] & np.uint32(STRICT) == 0] + low + 1)
    return (np.concatenate(loose), np.concatenate(strict)) if loose else (np.empty(0, int), np.empty(0, int))


def boundaries(data: bytes) -> list[int]:
    """End of each chunk."""
    n, at, ends = len(data), 0, []
    loose, strict = (x.tolist() for x in _hits(np.frombuffer(data, np.uint8)))
    loose.append(n), strict.append(n)
    i = j = 0
    while n - at > LEAST:
        while strict[j] < at + LEAST and strict[j] < n:
            j += 1
        if strict[j] <= min(at + NORMAL, n):
            at = strict[j]
        else:
            while loose[i] < at + NORMAL and loose[i] < n:
                i += 1
            at = min(loose[i], at + GREATEST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunk_set(data: bytes) -> dict[int, int]:
    """40-bit digest of each chunk: the bytes it covers."""
    got: dict[int, int] = {}
    at = 0
    for end in boundaries(data):
        d = xxhash.xxh3_64_intdigest(data[at:end]) >> 24
        got[d] = got.get(d, 0) + end - at
        at = end
    return got


def written_set(chunks: dict[int, int]) -> str:
    """Sorted `digest:bytes` pairs, joined by commas; an empty text gives an empty string."""
    return ",".join([f"{d:010x}:{n}" for d, n in sorted(chunks.items())])


def containment(one: dict[int, int], other: dict[int, int]) -> float:
    """Share of the bytes of one that the other holds too; two empty ones are alike, an empty and another one are not."""
    total = sum(one.values())
    if not total:
        return 0.0 if other else 1.0
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    return sum(min(one[d], other[d]) for d in small if d in large) / total


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(part, id, h, text, halo): rows dealt to parts of descending id, each with the first row of the next part at its end.

    Parts have about as many rows each; their bounds are quantiles of the ids. Rows without an id come last, ordered by
    the hash of their text, and have 64 parts of their own. Ties of an id go by the hash of the text.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = sorted(set(cuts))
    above = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b > F.col("id")))
    last = len(bounds) + 1
    part = F.when(F.col("id").isNull(), F.lit(last + 31) - F.shiftright("h", 58).cast("int")).otherwise(above)
    rows = base.withColumn("part", part)
    heads = {r["part"]: (r["head"]["id"], r["head"]["h"]) for r in rows.groupBy("part").agg(F.max(F.struct("id", "h")).alias("head")).collect()}
    order = sorted(heads)
    before = [(int(p), heads[p][0], heads[p][1], int(order[k - 1])) for k, p in enumerate(order)]
    whose = spark.createDataFrame(before, "part int, id long, h long, to int")  # a row for each part
    halo = (rows.join(F.broadcast(whose), (rows["part"] == whose["part"]) & rows["id"].eqNullSafe(whose["id"]) & (rows["h"] == whose["h"]))
            .select(whose["to"].alias("part"), rows["id"], rows["h"], rows["text"], F.lit(1).alias("halo")))
    return rows.select("part", "id", "h", "text", F.lit(0).alias("halo")).unionByName(halo), n


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next row is the one with the next lower id (after the last: the first; a single row is its own next). near_*: the
    share of the text's bytes that the edited text, or the next one, holds in equal chunks. Null texts are empty: their
    fingerprint is an empty string. Texts are shuffled once, to parts of neighbouring ids; a part is read in order and
    holds two texts at a time.
    """
    rows, n = in_order(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def finished(one, following):
        i, text, own = one
        new = edited(text, following[1]).encode()
        changed = chunk_set(new)
        return i, len(text), hashlib.sha256(new).hexdigest(), written_set(own), written_set(changed), containment(own, changed), containment(own, following[2])

    def table(done):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        held, part, closed = None, None, False
        for b in batches:
            done = []
            for p, i, text, halo in zip(b.column("part").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("halo").to_pylist(), strict=True):
                if p == part and closed:  # a repeated row that heads the next part
                    continue
                row = (i, text, chunk_set(text.encode()))
                if p == part:
                    done.append(finished(held, row))
                held, part, closed = row, p, bool(halo)
            if done:
                yield table(done)

    return rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "halo", F.col("id").desc_nulls_last(), F.desc("h")).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
