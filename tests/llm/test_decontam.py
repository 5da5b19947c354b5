"""Containment of item windows against a plain scan."""

import hashlib
import random
import re

import pytest

from sitesift.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1) if n else ():
            for s in range(len(w) - n + 1):
                if w[s:s + n] == v[k:k + n]:
                    hit |= set(range(s, s + n))
                    ids.add(str(i))
    listed = ",".join(sorted(ids))
    return len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("slots", [1 << 20, 64])
def test_rows_against_a_scan(spark, make, slots):
    rng = random.Random(4)
    vocab = [f"{c}{k}" for c in "abé" for k in range(25)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([40, 13, 14, 5, 2, 1, 30, 25, 60])] + [(20, None), (21, "-- !"), (22, "The Answer"), (23, "the answer"), (1, text(20))]
    rows = []
    for d in range(40):
        t = text(rng.randrange(0, 200))
        if d % 3 == 0:
            v = words(items[rng.randrange(9)][1])
            a = rng.randrange(0, max(1, len(v) - 12))
            t += " -" + "  ".join(v[a:]).upper().replace("É", "é") + "; " + text(5)
        rows.append((d, t))
    rows += [(90, None), (91, ""), (92, "THE, answer"), (92, "THE, answer"), (None, items[0][1]), (93, items[3][1])]
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = decontam.contamination(make(rows), table, slots=slots).collect()
    want = sorted((str(i), *brute(t, items)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    left = decontam.clean(make(rows), table, slots=slots)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, t in rows if not brute(t, items)[4])


def test_no_items_and_no_documents(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    r = decontam.contamination(make([(1, "a b")]), none).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False)
    assert decontam.contamination(make([(1, "a b")]).where("doc_id > 1"), none).count() == 0


@pytest.mark.parametrize("slots", [1 << 20, 64])
def test_items_without_an_id_are_looked_for(spark, make, slots):
    items = spark.createDataFrame([(None, "red fox runs"), (None, "old owl sleeps"), (7, "grey cat waits")], "item_id long, text string")
    rows = [(1, "a red fox runs and an old owl sleeps"), (2, "the grey cat waits for a red fox runs"), (3, "nothing here")]
    got = {r.doc_id: r for r in decontam.contamination(make(rows), items, slots=slots).collect()}
    assert [(got[k].n_hit, got[k].n_items, got[k].contaminated) for k in (1, 2, 3)] == [(6, 1, True), (6, 2, True), (0, 0, False)]
    assert [got[k].items_sha256 for k in (1, 2)] == [hashlib.sha256(t).hexdigest() for t in (b"", b"7")]


def test_a_window_in_many_documents_and_many_items(spark, make):
    passage = " ".join(f"p{k}" for k in range(30))
    items = spark.createDataFrame([(i, passage if i % 2 else f"{passage} tail{i}") for i in range(60)] + [(60, "the"), (61, "of the")], "item_id long, text string")
    rows = [(d, f"head{d} {passage} of the end") for d in range(300)] + [(400, "the the of the"), (401, " ".join(["the"] * 20000)), (401, " ".join(["the"] * 20000))]
    got = {}
    for r in decontam.contamination(make(rows), items, slots=1 << 12).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.contaminated))
    assert {tuple(got[d]) for d in range(300)} == {((34, 32, 62, True),)}
    assert got[400] == [(4, 4, 2, True)] and got[401] == [(20000, 20000, 1, True)] * 2
