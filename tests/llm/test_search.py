"""Ranked search against scores of all pairs."""

import collections
import math
import random
import re

import numpy as np
import pytest

from sitesift.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, k=10):
    bags = [(i, collections.Counter(terms(t))) for i, t in rows]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = collections.Counter(x for _, b in bags for x in b)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, b in bags:
            m = 10 + (90 * b.total() * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * b[x]) // (1000 * b[x] + 8 * m)) for x in set(terms(text)) if b[x])
            scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1) if s < 0]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    vocab = [f"{c}{k}" for c in "abé" for k in range(60)]
    text = lambda n: "; ".join(vocab[min(int(rng.expovariate(0.03)), 179)] for _ in range(n))
    items = [(i, text(rng.randrange(1, 30))) for i in range(12)] + [(50, None), (51, "?"), (52, "nowhere seen"), (53, "A1 a1 a1"), (3, text(5)), (None, text(6)), (1, None)]
    items += [items[2], items[2]]
    rows = [(d, text(rng.randrange(0, 90))) for d in range(300)]
    rows += [(400 + d, items[4][1]) for d in range(40)] + [(500, None), (501, ""), (502, "--"), (503, text(9000)), (504, items[4][1].upper()), (None, items[5][1]), (None, items[5][1]), (None, items[6][1])]
    return rows + [(5, rows[5][1])] * 25 + [(6, text(40))], items


@pytest.mark.parametrize(("block", "item_terms", "k"), [(1 << 18, 1 << 18, 10), (200, 40, 10), (1, 1 << 18, 3)])
def test_rows_against_all_pairs(spark, make, block, item_terms, k):
    rows, items = corpus()
    rng = random.Random(1)
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, rid string")
    got = search.ranked(make(rows), table, k=k, block=block, item_terms=item_terms).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items, k)


def test_intervals_without_hope_are_left_out():
    rng = np.random.default_rng(2)
    doc, term = np.nonzero(rng.random((2000, 30)) < 0.3)
    value = rng.integers(1, 1000, len(doc)).astype(np.int32)
    value[doc == 777] = 5000
    block = search.Block(np.arange(2000), np.ones(2000, np.int64), doc.astype(np.int32), term.astype(np.int64), value)
    best = []
    scored = block.search(np.array([3, 9, 12, 99]), np.array([5, 1, 7, 2]), 1, best)
    score = sum(np.bincount(doc[term == t], value[term == t] * w, 2000) for t, w in ((3, 5), (9, 1), (12, 7)))
    assert best == [(int(score.max()), -int(score.argmax()))] and scored < 400


def test_range_maxima():
    rng = np.random.default_rng(5)
    value = rng.integers(0, 50, 300).astype(np.int32)
    block = search.Block(np.arange(300), np.ones(300), np.arange(300, dtype=np.int32), np.zeros(300, np.int64), value)
    a, b = rng.integers(0, 300, 500), rng.integers(0, 301, 500)
    a, b = np.minimum(a, b), np.maximum(a, b)
    assert block.peaks(a, b)[1].tolist() == [int(value[x:y].max()) if y > x else 0 for x, y in zip(a, b)]


def test_no_items_and_no_documents(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.ranked(make([(1, "a b")]), none).count() == 0
    assert search.ranked(make([(1, "a b")]).where("doc_id > 1"), some).count() == 0
    assert search.ranked(make([(1, None), (2, "!")]), some).count() == 0
