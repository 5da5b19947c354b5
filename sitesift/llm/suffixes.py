"""Repeated passages by a sparse suffix array over words.

Only suffixes at content-selected places are kept: every window of `min_words` words is anchored at the minimiser (the
place with the least hash of `gram` words) among its first `min_words - lead + 1` places, so equal windows have equal anchors at
equal offsets, wherever they stand. Kept suffixes are brought into order by the hash of their leading `lead` words, which lie
inside every window anchored there; a suffix without an equal neighbour cannot belong to a repeated window and is dropped.
What is left is extended: to the right to the end of the last window and to the left to the start of the first window
anchored there. Suffixes whose extended matches are equal are settled together; where the extensions of
neighbours differ (at the edges of passages) each window of both is compared by itself. The result is exact for every window
of `min_words` words, up to 64-bit hash collisions, and no step needs the members of a group in one place.

Words are runs of bytes other than ASCII white space, compared as they are.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import out, row_key, utf8, written
from .words import NOT_SPACE, run_hashes, span_hashes, word_hashes, word_spans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_WORDS, LEAD, GRAM = 50, 12, 5


def _anchors(words: np.ndarray, min_words: int, lead: int, gram: int):
    """(anchor, first window, last window) of each kept suffix."""
    n = len(words) - min_words + 1
    if n < 1:
        return (np.empty(0, int),) * 3
    width = min_words - lead + 1
    grams = run_hashes(words, gram)
    at = np.empty(n, np.int64)
    for low in range(0, n, 1 << 16):
        part = grams[low:min(n, low + (1 << 16)) + width - 1]
        at[low:low + (1 << 16)] = np.lib.stride_tricks.sliding_window_view(part, width).argmin(1) + np.arange(low, low + len(part) - width + 1)
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[start], start, np.append(start[1:], n) - 1


def _words(data: bytes):
    starts, ends = word_spans(data, NOT_SPACE)
    return starts, ends, word_hashes(data, starts, ends)


def kept_suffixes(docs: DataFrame, min_words: int, lead: int, gram: int) -> DataFrame:
    """(id, rid, lo, n, head, body): windows lo .. lo+n-1, hash of the leading words, hash of the extended match."""
    schema = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("lo", pa.int32()), ("n", pa.int16() if min_words < 1 << 14 else pa.int32()), ("head", pa.int64()), ("body", pa.int64())])

    def run(batches):
        for b in batches:
            ids, rids, cols = b.column("id").to_pylist(), b.column("rid").to_pylist(), []
            for i, r, t in zip(ids, rids, utf8(b, "text"), strict=True):
                w = _words(t)[2]
                at, lo, hi = _anchors(w, min_words, lead, gram)
                if len(at):
                    cols.append((i, r, lo, hi - lo + 1, span_hashes(w, at, at + lead), span_hashes(w, lo, hi + min_words)))
            if cols:
                count = [len(c[2]) for c in cols]
                whole = [np.concatenate([c[k] for c in cols]) for k in (2, 3, 4, 5)]
                yield out(schema, id=pa.array([c[0] for c in cols], pa.int64()).take(pa.array(np.repeat(np.arange(len(cols)), count))), rid=pa.array(np.repeat(np.array([c[1] for c in cols], np.int64), count)),
                          lo=pa.array(whole[0].astype(np.int32)), n=pa.array(whole[1].astype(np.int32)), head=pa.array(whole[2].view(np.int64)), body=pa.array(whole[3].view(np.int64)))

    return docs.mapInArrow(run, f"id long, rid long, lo int, n {'short' if min_words < 1 << 14 else 'int'}, head long, body long")


def _place(prefix: str = ""):
    """Where a window starts, in the order in which the first occurrence is kept: ids ascending, null last, then rid."""
    return F.struct(F.col(f"{prefix}id").isNull().alias("none"), F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}rid").alias("rid"), F.col(f"{prefix}lo").alias("lo"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, lead: int = LEAD, gram: int = GRAM) -> DataFrame:
    """(id, rid, lo, n, first): runs of n windows from word lo on, each repeated; `first` is the place of the first
    occurrence of the run's first window, and the run's other windows follow it there."""
    if not gram <= lead <= min_words:
        raise ValueError("gram <= lead <= min_words must hold")
    base = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    kept = written(kept_suffixes(base, min_words, lead, gram), "suffixes")
    # neighbours in the order of leading words: only those that have an equal one stay
    # (written, so that both sides of the join are plain shuffles and a crowded head can be split)
    heads = written(kept.groupBy("head").agg(F.count("*").alias("c")).where("c > 1").select("head"), "heads")
    equal = written(kept.join(heads, "head", "left_semi"), "equal")
    bodies = equal.groupBy("body", "head", "n").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    bodies = written(bodies, "bodies")
    split = written(bodies.groupBy("head").agg(F.min("body").alias("x"), F.max("body").alias("y")).where("x <> y").select("head"), "split")
    whole = bodies.join(split, "head", "left_anti").where("first <> last").select("body", "first")
    settled = equal.join(whole, "body").select("id", "rid", "lo", F.col("n").cast("int").alias("n"), "first")

    # edges of passages: each window of one text that has the extended match stands for all of them
    edge = written(bodies.join(split, "head", "left_semi"), "edges")
    ask = edge.groupBy("first.rid").agg(F.collect_list(F.struct("body", F.col("first.lo").alias("lo"), "n")).alias("asked"))
    wanted = base.select("rid", "text").join(ask, "rid").dropDuplicates(["rid"])
    schema = pa.schema([("body", pa.int64()), ("k", pa.int32()), ("window", pa.int64())])

    def windows(batches):
        for b in batches:
            body, k, got = [], [], []
            for t, asked in zip(utf8(b, "text"), b.column("asked").to_pylist(), strict=True):
                h = run_hashes(_words(t)[2], min_words).view(np.int64)
                for a in asked:
                    body.append(np.full(a["n"], a["body"]))
                    k.append(np.arange(a["n"]))
                    got.append(h[a["lo"]:a["lo"] + a["n"]])
            if body:
                yield out(schema, body=pa.array(np.concatenate(body)), k=pa.array(np.concatenate(k).astype(np.int32)), window=pa.array(np.concatenate(got)))

    each = written(wanted.mapInArrow(windows, "body long, k int, window long").join(edge.select("body", "first", "last"), "body")
                   .select("body", "k", "window", _shifted("first").alias("first"), _shifted("last").alias("last")), "windows")
    same = each.groupBy("window").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last").select("window", "first")
    hits = each.select("body", "k", "window").join(same, "window")
    runs = written(hits.groupBy("body").agg(F.sort_array(F.collect_list(F.struct("k", "first"))).alias("ks")).select("body", F.expr(_RUNS).alias("ks")), "runs")
    return settled.unionByName(equal.select("id", "rid", "lo", "body").join(runs, "body").select("id", "rid", "lo", F.explode("ks").alias("w"))
                               .select("id", "rid", (F.col("lo") + F.col("w.k")).alias("lo"), F.col("w.n").alias("n"), F.col("w.first").alias("first")))


#: windows of one match, at most min_words of them, that follow each other there and at their first place as one run
_RUNS = """aggregate(ks, cast(array() as array<struct<k:int,n:int,first:struct<none:boolean,id:bigint,rid:bigint,lo:int>>>), (a, w) ->
    if(size(a) > 0 and element_at(a, -1).k + element_at(a, -1).n = w.k and element_at(a, -1).first.rid = w.first.rid and element_at(a, -1).first.lo + element_at(a, -1).n = w.first.lo,
       concat(slice(a, 1, size(a) - 1), array(named_struct('k', element_at(a, -1).k, 'n', element_at(a, -1).n + 1, 'first', element_at(a, -1).first))),
       concat(a, array(named_struct('k', w.k, 'n', 1, 'first', w.first)))))"""


def _shifted(place: str):
    p = F.col(place)
    return F.struct(p["none"].alias("none"), p["id"].alias("id"), p["rid"].alias("rid"), (p["lo"] + F.col("k")).alias("lo"))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, lead: int = LEAD, gram: int = GRAM) -> DataFrame:
    """(id, rid, repeated, surplus, sources): word spans [from, to) of one text that occur elsewhere, those to drop, and the
    ids of the texts that hold the first occurrences. Only texts with a repeated passage have a row.

    A passage is a run of words each covered by a window of `min_words` words that occurs again, in another text or
    further on in the same one. The first occurrence (least id, then least place; null ids last) stays; `surplus` is what
    the others have. A window that overlaps its own first occurrence gives up only the words beyond it.
    """
    runs = repeated_windows(docs, id_col, text_col, min_words, lead, gram)
    # a set: copies of a row bring the same runs, and those are one before they leave their tasks
    per = runs.groupBy("id", "rid").agg(F.collect_set(F.struct("lo", "n", F.col("first.id").alias("fid"), F.col("first.rid").alias("frid"), F.col("first.lo").alias("flo"))).alias("runs"))
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
    schema = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("repeated", span), ("surplus", span), ("sources", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = {k: [] for k in ("repeated", "surplus", "sources")}
            for rid, found in zip(b.column("rid").to_pylist(), b.column("runs").to_pylist(), strict=True):
                every, drop, sources = [], [], set()
                for r in found:
                    lo, hi, own = r["lo"], r["lo"] + r["n"] - 1 + min_words, r["frid"] == rid
                    every.append((lo, hi))
                    if not own:
                        drop.append((lo, hi))
                        sources.add(r["fid"])
                    elif r["flo"] != lo:  # the k-th window gives up [max(lo, flo + min_words) + k, lo + min_words + k)
                        drop.append((max(lo, r["flo"] + min_words), hi))
                        sources.add(r["fid"])
                spans = lambda x: [{"from": p, "to": q} for p, q in _merge(x)]
                rows["repeated"].append(spans(every))
                rows["surplus"].append(spans(drop))
                rows["sources"].append(sorted(x for x in sources if x is not None))
            yield out(schema, id=b.column("id"), rid=b.column("rid"), **rows)

    return per.mapInArrow(run, "id long, rid long, repeated array<struct<from:int,to:int>>, surplus array<struct<from:int,to:int>>, sources array<long>")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, n_words, n_repeated, n_surplus, sources) of every row; texts without a repeated passage have zeros and an
    empty list, and a null or blank text has no words."""
    found = passages(docs, id_col, text_col, **how)
    count = lambda c: F.expr(f"aggregate({c}, 0L, (a, s) -> a + s.to - s.from)")
    schema = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        for b in batches:
            yield out(schema, id=b.column("id"), rid=b.column("rid"), n_words=[len(word_spans(t, NOT_SPACE)[0]) for t in utf8(b, "text")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text")).mapInArrow(run, "id long, rid long, n_words long")
    got = found.select("rid", count("repeated").alias("n_repeated"), count("surplus").alias("n_surplus"), "sources")
    return rows.join(got, "rid", "left").select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"),
                                                F.coalesce("n_surplus", F.lit(0).cast("long")).alias("n_surplus"), F.coalesce("sources", F.array().cast("array<long>")).alias("sources"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows with surplus passages cut from their text; other columns stay as they are.

    The text keeps everything outside the cut words, white space included; rows without surplus are unchanged, null
    stays null. A text that is surplus as a whole becomes its remaining white space.
    """
    cut = passages(docs, id_col, text_col, **how).where("size(surplus) > 0").select(F.col("rid").alias("__rid"), F.col("surplus").alias("__surplus"))
    joined = docs.withColumn("__rid", row_key(id_col, text_col)).join(cut, "__rid", "left").drop("__rid")
    fields = [f for f in docs.schema.fields]
    ddl = docs.schema

    def run(batches):
        for b in batches:
            got = []
            for t, surplus in zip(b.column(text_col).cast(pa.binary()).to_pylist(), b.column("__surplus").to_pylist(), strict=True):
                if surplus:
                    starts, ends = word_spans(t, NOT_SPACE)
                    parts, at = [], 0
                    for s in surplus:
                        parts.append(t[at:int(starts[s["from"]])])
                        at = int(ends[s["to"] - 1])
                    t = b"".join([*parts, t[at:]])
                got.append(t)
            text = pa.array(got, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([text if f.name == text_col else b.column(f.name) for f in fields], names=[f.name for f in fields])

    return joined.mapInArrow(run, ddl)
