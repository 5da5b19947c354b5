"""Ranked lexical search over document intervals.

Postings of the terms that some item asks for come from one pass over the documents: a text's distinct terms are joined to the asked
ones, so the join is Spark's to choose and the documents' own vocabulary never travels. Statistics are counted from the same
rows. Postings are dealt by document; a task cuts its documents, shortest first, into blocks.

In a block every posting list has a sparse table of the places of its greatest impacts, so the maximum over any document interval
costs two look-ups. An item starts with one interval, the block. The interval with the greatest sum of its terms' maxima is
taken next: the document with the greatest single impact in it is scored exactly, and the intervals left and right of that document
go back with their own sums. No document of an interval can score more than its sum, so the search ends when no interval
reaches the k-th best score of what the task has seen. The items' best of all tasks are ranked at last.

Items are asked in blocks of bounded size, each over the written postings; texts are read once.
"""

import collections
import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import spread
from .common import out, row_key, utf8, written
from .words import LOWER, WORD_BYTES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K, NO_ID = 10, (1 << 63) - 1
#: saturation and length weights in per mille and per cent, as integers; postings of a block and terms of an item block
SATURATION, LENGTH_PERCENT, SCALE = 8, 90, 1_000_000_000
BLOCK, ITEM_TERMS, AT_ONCE = 1 << 18, 1 << 18, 32
_BLANKS = bytes(LOWER[c] if WORD_BYTES[c] else 32 for c in range(256))


def term_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rid, n, term, tf): a row for each distinct term of a text, and one for the text itself with an empty term."""
    pair = pa.struct([("term", pa.string()), ("tf", pa.int32())])
    schema = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pair))])

    def run(batches):
        for b in batches:
            terms, often, n, ends = [], [], [], [0]
            for t in utf8(b, "text"):
                found = t.translate(_BLANKS).split()
                tally = collections.Counter(found)
                terms += tally.keys()
                often += tally.values()
                terms.append(b""), often.append(0)
                n.append(len(found)), ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(often, pa.int32())], fields=list(pair))
            yield out(schema, id=b.column("id"), rid=b.column("rid"), n=n, terms=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))

    base = texts.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    rows = base.mapInArrow(run, "id long, rid long, n long, terms array<struct<term:string,tf:int>>")
    return rows.select("id", "rid", "n", F.explode("terms").alias("p")).select("id", "rid", "n", "p.term", "p.tf")


def impact(n_docs: int, n_terms: int) -> Column:
    """A posting's part of the score without its term's weight, in whole numbers under a million."""
    length = f"({100 - LENGTH_PERCENT}L + ({LENGTH_PERCENT}L * n * {n_docs}L) div {n_terms}L)"
    return F.expr(f"cast(({SCALE}L * tf) div (1000L * tf + {SATURATION}L * {length}) as int)")


class Block:
    """Posting lists of some documents, each with its range-maximum table."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray):
        order = np.lexsort((doc, term))
        self.ids, self.lengths, self.size = ids, lengths, len(ids)
        self.doc, self.value = doc[order], value[order]
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.key = np.repeat(np.arange(len(self.terms)), self.last - self.first) * self.size + self.doc
        longest = int((self.last - self.first).max()) if len(order) else 1
        self.tables = [np.arange(len(order), dtype=np.int32)]
        while 2 << (len(self.tables) - 1) <= longest:
            half = 1 << (len(self.tables) - 1)
            below = self.tables[-1]
            a, b = below[:len(order) - 2 * half + 1], below[half:half + len(order) - 2 * half + 1]
            self.tables.append(np.concatenate([np.where(self.value[b] > self.value[a], b, a), below[len(order) - 2 * half + 1:]]))
        self.table = np.stack(self.tables)

    def peaks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and value of the greatest impact in each range of postings; an empty range has value 0."""
        size = b - a
        level = np.frexp(np.maximum(size, 1))[1] - 1
        x = self.table[level, np.minimum(a, len(self.key) - 1)]
        y = self.table[level, np.maximum(b - (1 << level), 0)]
        best = np.where(self.value[y] > self.value[x], y, x)
        return best, np.where(size > 0, self.value[best], 0)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, int]]) -> int:
        """Put the block's documents into the k best (score, -id), a heap with the least in front; gives the documents scored."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        t, w = at[known], weights[known]
        if not len(t):
            return 0
        base, scored = t * self.size, 0
        a, b = self.first[t][None], self.last[t][None]
        place, value = self.peaks(a, b)
        queue, rows = [], {}

        def push(a, b, place, value, low, high):
            bounds = value @ w
            for i in np.flatnonzero((bounds > 0) & (bounds >= (best[0][0] if len(best) == k else 1))).tolist():
                n = len(rows)
                rows[n] = (a[i], b[i], place[i], value[i], int(low[i]), int(high[i]))
                heapq.heappush(queue, (-int(bounds[i]), int(low[i]), n))

        push(a, b, place, value, np.zeros(1, np.int64), np.full(1, self.size))
        while queue:
            taken = []
            while queue and len(taken) < AT_ONCE:
                bound, low, n = heapq.heappop(queue)
                if len(best) == k and (-bound < best[0][0] or -bound == best[0][0] and self._later(*rows[n][4:], -best[0][1])):
                    if -bound < best[0][0]:
                        queue.clear()
                    continue
                taken.append(rows[n])
            if not taken:
                break
            a, b, place, value = (np.stack(x) for x in list(zip(*taken, strict=True))[:4])
            low, high = np.array([x[4] for x in taken]), np.array([x[5] for x in taken])
            pivot = self.doc[place[np.arange(len(taken)), np.argmax(value * w, axis=1)]].astype(np.int64)
            want = base + pivot[:, None]
            c = np.searchsorted(self.key, want)
            there = self.key[np.minimum(c, len(self.key) - 1)] == want
            score = (np.where(there, self.value[np.minimum(c, len(self.key) - 1)], 0) @ w).tolist()
            scored += len(taken)
            for s, p in zip(score, pivot.tolist(), strict=True):
                entry = (s, -int(self.ids[p]))
                if s > 0 and len(best) < k:
                    heapq.heappush(best, entry)
                elif s > 0 and entry > best[0]:
                    heapq.heapreplace(best, entry)
            left, right = self.peaks(a, c), self.peaks(c + there, b)
            push(a, c, *left, low, pivot)
            push(c + there, b, *right, pivot + 1, high)
        return scored

    def _later(self, low: int, high: int, id_: int) -> bool:
        """Do all documents of an interval have greater ids? Known where its documents are equally long, as those stand in id order."""
        return low >= high or (self.lengths[low] == self.lengths[high - 1] and int(self.ids[low]) > id_)


def _best_of_part(batches, items: list[tuple[int, int, np.ndarray, np.ndarray]], k: int, size: int, schema: pa.Schema):
    """The k best documents of each item among a part's postings, which come document by document, the shortest first."""
    best: list[list[tuple[int, int]]] = [[] for _ in items]
    held: list[pa.Table] = []

    def ask(rows: pa.Table):
        ids, rids, n, key, value = (rows.column(c).to_numpy() for c in ("id", "rid", "n", "key", "impact"))
        if not len(ids):
            return
        change = np.append(True, (ids[1:] != ids[:-1]) | (rids[1:] != rids[:-1]) | (n[1:] != n[:-1]))
        again = np.append(False, ~change[1:] & (key[1:] == key[:-1]))  # a repeated row's terms come as often as the row
        at = np.arange(len(ids))
        copy = np.minimum(at - np.maximum.accumulate(np.where(again, 0, at)), k)
        keep = copy < k  # more than k equal rows cannot be told apart from k
        doc, first, place = np.unique((np.cumsum(change) - 1)[keep] * k + copy[keep], return_index=True, return_inverse=True)
        block = Block(ids[keep][first], n[keep][first], place.astype(np.int32), key[keep], value[keep])
        for own, (_, _, terms, weights) in zip(best, items, strict=True):
            block.search(terms, weights, k, own)

    def whole_documents(rows: pa.Table) -> int:
        ids, rids = rows.column("id").to_numpy(), rows.column("rid").to_numpy()
        ends = np.flatnonzero((ids[1:] != ids[:-1]) | (rids[1:] != rids[:-1]))
        return int(ends[-1]) + 1 if len(ends) else 0

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) >= size:
            rows = pa.concat_tables(held).combine_chunks()
            cut = whole_documents(rows)
            ask(rows.slice(0, cut))
            held = [rows.slice(cut)]
    if held:
        ask(pa.concat_tables(held).combine_chunks())
    for own, (item, item_rid, _, _) in zip(best, items, strict=True):
        ids = [-i for _, i in own]
        yield out(schema, item=[item] * len(own), item_rid=[item_rid] * len(own), doc_id=ids, score=[s for s, _ in own])


def _item_blocks(asked: DataFrame, limit: int):
    """Items with their terms and weights, in lists of about `limit` terms; one list at a time is on the driver."""
    block, terms = [], 0
    for r in asked.toLocalIterator():
        block.append((r["id"], r["rid"], np.array([t["key"] for t in r["terms"]], np.int64), np.array([t["weight"] for t in r["terms"]], np.int64)))
        terms += len(r["terms"])
        if terms >= limit:
            yield block
            block, terms = [], 0
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           block: int = BLOCK, item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents that score highest for each item, fewer where fewer score above 0.

    Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; a null text has none. Every row of
    documents counts as a document, so a repeated row can be listed again; a null id sorts last. An item row that is there twice
    (id and text) is asked once. No items or no documents give an empty table.
    """
    spark = docs.sparkSession
    of_items = term_counts(items, item_col, item_text).select("id", "rid", "term").distinct()
    wanted = written(of_items.select("term").distinct().withColumn("key", F.monotonically_increasing_id()), "terms")
    postings = written(term_counts(docs, id_col, text_col).join(wanted, "term").select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "rid", "n", "key", "tf"), "postings")
    n_docs, n_terms = postings.where("tf = 0").agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = postings.where("tf > 0").groupBy("key").agg(F.count("*").alias("df")).select("key", weight.alias("weight")).where("weight > 0")
    asked = written(of_items.join(wanted, "term").join(weights, "key").groupBy("id", "rid").agg(F.array_sort(F.collect_list(F.struct("key", "weight"))).alias("terms")), "items")
    dealt = spread(postings.where("tf > 0").select("id", "rid", "n", "key", impact(n_docs, max(n_terms, 1)).alias("impact")), "rid").sortWithinPartitions("n", "id", "rid", "key")
    ddl = "item long, item_rid long, doc_id long, score long"
    schema = pa.schema([(c.split()[0], pa.int64()) for c in ddl.split(", ")])
    found = spark.createDataFrame([], ddl)
    for part in _item_blocks(asked, item_terms):
        shared = spark.sparkContext.broadcast(part)
        found = found.unionByName(written(dealt.mapInArrow(lambda batches, shared=shared: _best_of_part(batches, shared.value, k, block, schema), ddl), "best"))
        shared.destroy()
    order = Window.partitionBy("item", "item_rid").orderBy(F.col("score").desc(), "doc_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select(F.col("item").alias("item_id"), "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")
