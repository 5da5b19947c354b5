"""Repeated passages against a dictionary of all windows."""

import random
import re

import pytest

from sitesift.llm import suffixes


def brute(rows, m):
    """Words to drop for each row: a window goes where an earlier one equals it; an overlap with itself keeps the first."""
    docs = {}
    for i, t in rows:
        docs.setdefault((i is None, i, t or ""), [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    seen = {}
    for key in sorted(docs, key=lambda k: (k[0], k[1] or 0, k[2])):
        w = docs[key]
        for s in range(len(w) - m + 1):
            seen.setdefault(tuple(w[s:s + m]), []).append((key, s))
    drop, again = {k: set() for k in docs}, {k: set() for k in docs}
    for places in seen.values():
        if len(places) > 1:
            (fk, fs) = places[0]
            for k, s in places:
                again[k] |= set(range(s, s + m))
                if k != fk:
                    drop[k] |= set(range(s, s + m))
                elif s != fs:
                    drop[k] |= set(range(max(s, fs + m), s + m))
    return docs, again, drop


def corpus(seed, m):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(n)] for n in (m, m + 1, m + 7, 2 * m, m - 1, 5 * m)]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randrange(0, 3 * m))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(shared)
            a = rng.randrange(0, 3)
            w += p[a:] if rng.random() < 0.3 else p
            w += [word() for _ in range(rng.randrange(0, m))]
        rows.append((i * 3 % 101, " ".join(w)))
    rows += [(500, " ".join(["a", "b"] * (2 * m))), (501, " ".join(shared[5])), (501, " ".join(shared[5])), (502, None), (503, ""), (None, " ".join(shared[3])), (504, "é " * (m + 3))]
    return rows


@pytest.mark.parametrize("seed,m,lead", [(1, 50, 12), (2, 50, 12), (3, 20, 7)])
def test_every_repeated_window_is_found(make, seed, m, lead):
    rows = corpus(seed, m)
    docs, again, drop = brute(rows, m)
    got = suffixes.report(make(rows), min_words=m, lead=lead).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len(docs[i is None, i, t or ""]), len(again[i is None, i, t or ""]), len(drop[i is None, i, t or ""])) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_repeated, r.n_surplus) for r in got) == want


def test_cut_texts_keep_the_rest(make):
    m = 20
    rows = corpus(9, m)
    docs, _, drop = brute(rows, m)
    got = suffixes.without_repeats(make(rows), min_words=m, lead=7, gram=4)
    assert got.columns == make(rows).columns
    want = sorted((str(i), " ".join(w for k, w in enumerate(docs[i is None, i, t or ""]) if k not in drop[i is None, i, t or ""])) for i, t in rows)
    assert sorted((str(r.doc_id), " ".join((r.text or "").split(" ")).strip() and " ".join(re.split(r"[\x20\x09-\x0D]+", r.text.strip(" \t\n\x0b\x0c\r"))) or "") for r in got.collect()) == want
    kept = {str(r.doc_id): r.text for r in got.collect()}
    assert kept["502"] is None and kept["503"] == ""


def test_empty_table(make):
    assert suffixes.report(make([(1, "x")]).where("doc_id > 5")).count() == 0


def test_copies_of_a_row_bring_their_runs_once(make):
    passage = " ".join(f"p{k}" for k in range(120))
    rows = [(1, f"start {passage}")] + [(2, f"{passage} end")] * 400 + [(3, "short")]
    got = suffixes.passages(make(rows)).collect()
    assert sorted((r.id, [tuple(s) for s in r.repeated], [tuple(s) for s in r.surplus]) for r in got) == [(1, [(1, 121)], []), (2, [(0, 120)], [(0, 120)])]
    assert suffixes.report(make(rows)).where("doc_id = 2 AND n_surplus = 120").count() == 400
