"""Benchmark decontamination as a prefix-filtered containment join over item-sized windows.

An item is cut into windows of 13 words (a shorter item is one window). A window's set of shingles (three words, or the whole
window where it has fewer) must be contained in full, so one of its shingles is a sufficient prefix: the rarest in the
corpus, counted over all documents in a first pass. Documents send their prefix shingles only, each with the words around it,
and Spark joins them with the windows that chose that shingle. A pair fixes where its window would start (positional bound)
and must leave room for all its words (length bound); what passes is compared word by word.

Items and documents meet in shuffles alone, so neither has to fit anywhere. What tasks get in advance is a filter of fixed
size that tells which shingles no item has; it lets some others through, and the join drops those.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import out, row_key, utf8, written
from .words import LOWER, WORD_BYTES, U, run_hashes, word_hashes, word_spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, SHINGLE = 13, 3
SLOTS = 1 << 26  # bits of the filter: 8 MB, whatever the size of the benchmark
CHUNK_ROWS = 8192


def _words(data: bytes):
    low = data.translate(LOWER)
    starts, ends = word_spans(low, WORD_BYTES)
    return low, starts, ends


def _tokens(words: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of `size` words; runs of other sizes have others."""
    return run_hashes(words, size) ^ U(size)


class Filter:
    """Two bits for each shingle that an item has, and the sizes of those shingles."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.mask = U(len(bits) * 64 - 1)

    def passing(self, tokens: np.ndarray) -> np.ndarray:
        """Places of the tokens that an item may have."""
        at = np.arange(len(tokens))
        for shift in (U(0), U(32)):
            slot = (tokens[at] >> shift) & self.mask
            at = at[(self.bits[slot >> U(6)] >> (slot & U(63))) & U(1) == U(1)]
        return at


def _filter(tokens: DataFrame, slots: int):
    """The broadcast filter of a table (size, token); a row for each 64 bits at most reaches the driver."""
    both = tokens.select(F.explode(F.array(F.col("token").bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned("token", 32).bitwiseAND(F.lit(slots - 1)))).alias("slot"))
    rows = both.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(slots // 64, U)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(U)
    sizes = sorted(r["size"] for r in tokens.select("size").distinct().collect())  # at most as many as a shingle has words
    return tokens.sparkSession.sparkContext.broadcast(Filter(bits, sizes))


def _item_shingles(texts: DataFrame, window: int, shingle: int) -> DataFrame:
    """(key, pos, size, token): the shingles of each item in their order."""
    schema = pa.schema([("key", pa.binary()), ("pos", pa.int32()), ("size", pa.int32()), ("token", pa.int64())])

    def run(batches):
        for b in batches:
            for key, t in zip(b.column("key").to_pylist(), utf8(b, "text"), strict=True):
                h = word_hashes(*_words(t))
                size = min(shingle, window, len(h))
                if size:
                    g = _tokens(h, size)
                    yield out(schema, key=pa.array([key], pa.binary()).take(pa.array(np.zeros(len(g), np.int64))), pos=pa.array(np.arange(len(g), dtype=np.int32)), size=pa.array(np.full(len(g), size, np.int32)), token=pa.array(g.view(np.int64)))

    return texts.mapInArrow(run, "key binary, pos int, size int, token long")


def _frequencies(docs: DataFrame, known, label: str) -> DataFrame:
    """(token, c): how often each shingle that passes the filter occurs in the corpus."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches):
        want = known.value
        for b in batches:
            seen = []
            for t in utf8(b, "text"):
                h = word_hashes(*_words(t))
                for size in want.sizes:
                    g = _tokens(h, size)
                    seen.append(g[want.passing(g)])
            if seen:
                token, n = np.unique(np.concatenate(seen), return_counts=True)
                yield out(schema, token=pa.array(token.view(np.int64)), n=pa.array(n))

    return written(docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("c")), label)


def _prefixes(texts: DataFrame, shingles: DataFrame, counts: DataFrame, window: int, shingle: int) -> DataFrame:
    """(key, token, shift, n, line): every window of an item as its words, with its rarest shingle and that one's place in it.

    Equal windows choose alike: by frequency, then token, then place.
    """
    rarity = shingles.join(counts, "token", "left").groupBy("key").agg(F.collect_list(F.struct("pos", F.coalesce("c", F.lit(0).cast("long")).alias("c"))).alias("rarity"))
    schema = pa.schema([("key", pa.binary()), ("token", pa.int64()), ("shift", pa.int32()), ("n", pa.int32()), ("line", pa.string())])

    def run(batches):
        for b in batches:
            for key, t, rarity in zip(b.column("key").to_pylist(), utf8(b, "text"), b.column("rarity").to_pylist(), strict=True):
                low, starts, ends = _words(t)
                h = word_hashes(low, starts, ends)
                n = min(window, len(h))
                g = _tokens(h, min(shingle, n))
                c = np.zeros(len(g), np.int64)
                c[[r["pos"] for r in rarity]] = [r["c"] for r in rarity]
                rank = np.empty(len(g), np.int64)
                rank[np.lexsort((np.arange(len(g)), g, c))] = np.arange(len(g))
                span = n - min(shingle, n) + 1
                shift = np.lib.stride_tricks.sliding_window_view(rank, span).argmin(1)
                words = [low[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                for lo in range(0, len(shift), CHUNK_ROWS):
                    part = shift[lo:lo + CHUNK_ROWS]
                    own = np.arange(lo, lo + len(part))
                    yield out(schema, key=[key] * len(part), token=pa.array(g[own + part].view(np.int64)), shift=pa.array(part.astype(np.int32)), n=[n] * len(part),
                              line=pa.array([b" ".join(words[k:k + n]) for k in own.tolist()], pa.binary()))

    return texts.join(rarity, "key").select("key", "text", "rarity").mapInArrow(run, "key binary, token long, shift int, n int, line string")


def _probes(docs: DataFrame, known, window: int, shingle: int) -> DataFrame:
    """(id, rid, n_words, token, at, before, near): a row without a token for each document, and one for each prefix shingle in
    it: its first word's place, and the words around it, `before` of them ahead, that a window with that shingle can reach."""
    schema = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("n_words", pa.int64()), ("token", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("near", pa.string())])

    def run(batches):
        want = known.value
        for b in batches:
            ids, rids, n_words = b.column("id").to_pylist(), b.column("rid").to_pylist(), []
            for i, r, t in zip(ids, rids, utf8(b, "text"), strict=True):
                low, starts, ends = _words(t)
                n_words.append(len(starts))
                h = word_hashes(low, starts, ends)
                for size in want.sizes:
                    g = _tokens(h, size)
                    hit = want.passing(g)
                    reach = window - size if size == shingle else 0  # a window with smaller shingles is one shingle
                    for k in range(0, len(hit), CHUNK_ROWS):
                        at = hit[k:k + CHUNK_ROWS]
                        first, last = np.maximum(at - reach, 0), np.minimum(at + size + reach, len(h))
                        near = [b" ".join([low[p:q] for p, q in zip(starts[x:y].tolist(), ends[x:y].tolist(), strict=True)]) for x, y in zip(first.tolist(), last.tolist(), strict=True)]
                        yield out(schema, id=pa.array([i] * len(at), pa.int64()), rid=[r] * len(at), n_words=[len(h)] * len(at), token=pa.array(g[at].view(np.int64)),
                                  at=pa.array(at.astype(np.int32)), before=pa.array((at - first).astype(np.int32)), near=pa.array(near, pa.binary()))
            none = [None] * len(ids)
            yield out(schema, id=b.column("id"), rid=b.column("rid"), n_words=n_words, token=none, at=none, before=none, near=none)

    return docs.mapInArrow(run, "id long, rid long, n_words long, token long, at int, before int, near string")


def _spans(found: DataFrame) -> DataFrame:
    """(rid, spans): the windows found in each text, overlapping and touching ones as one span [from, to)."""
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    schema = pa.schema([("rid", pa.int64()), ("spans", span)])

    def run(batches):
        for b in batches:
            merged = []
            for windows in b.column("windows").to_pylist():
                spans: list[list[int]] = []
                for lo, hi in sorted((w["start"], w["start"] + w["n"]) for w in windows):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                merged.append([{"from": lo, "to": hi} for lo, hi in spans])
            yield out(schema, rid=b.column("rid"), spans=merged)

    return found.groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("windows")).mapInArrow(run, "rid long, spans array<struct<from:int,to:int>>")


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, slots: int = SLOTS) -> DataFrame:
    """(id, rid, n_words, spans, items) of every row: the word spans [from, to) inside occurrences of item windows, merged,
    and the sorted ids of the items that have one, a null last for those without an id.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. Items without words
    match nothing; those without an id match like any other and count as one item. An empty set of items gives every row without spans.
    `slots` (a power of two, 64 and more) sets the size of the filter and changes no result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    texts = asked.select("key", "text").dropDuplicates(["key"])
    shingles = written(_item_shingles(texts, window, shingle), "item-shingles")
    counts = _frequencies(base.select("text"), _filter(shingles, slots), "shingle-counts")
    windows = written(_prefixes(texts, shingles, counts, window, shingle), "windows")
    chosen = _filter(windows.select(F.least("n", F.lit(shingle)).alias("size"), "token"), slots)

    probes = written(_probes(base, chosen, window, shingle), "probes")
    start = F.col("at") - F.col("shift")
    room = (F.col("before") >= F.col("shift")) & (start + F.col("n") <= F.col("n_words"))
    same = F.expr("array_join(slice(split(near, ' '), before - shift + 1, n), ' ') = line")
    found = written(probes.where("token IS NOT NULL").join(windows.select("token", "shift", "n", "line").distinct(), "token").where(room).where(same)
                    .select("rid", start.alias("start"), "n", "line"), "found")

    holders = windows.select("key", "line").distinct().join(asked.select("key", "item").distinct(), "key").select("line", "item").distinct()
    held = found.select("rid", "line").distinct().join(holders, "line").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("named"), F.max(F.col("item").isNull()).alias("nameless"))
    item_list = F.concat("named", F.when(F.col("nameless"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    rows = probes.where("token IS NULL").select("id", "rid", "n_words")
    got = _spans(found).join(held, "rid").select("rid", "spans", item_list.alias("items"))
    return rows.join(got, "rid", "left").select("id", "rid", "n_words", F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20, **how) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every row.

    Contaminated: some word is hit, and at least one in `share` (20: five per cent). A null text has no words and is clean.
    """
    got = hits(docs, items, id_col, text_col, **how)
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.to - s.from)")
    return got.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"), "items")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20, **how) -> DataFrame:
    """The rows that are not contaminated, with their own columns."""
    got = hits(docs, items, id_col, text_col, **how)
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.to - s.from)")
    bad = got.where((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).select(F.col("rid").alias("__rid")).distinct()
    return docs.withColumn("__rid", row_key(id_col, text_col)).join(bad, "__rid", "left_anti").drop("__rid")
