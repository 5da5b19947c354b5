"""Bucket gains, weights and the draw against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from sitesift.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(t, low, high):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return w, [" ".join(w[k:k + n]) for n in range(low, high + 1) for k in range(len(w) - n + 1)]


def brute(rows, target, low=1, high=1, buckets=10_000, percent=10, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(map(bucket, grams(x, low, high)[1]))
    for x in target:
        t.update(map(bucket, grams(x, low, high)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in rows:
        w, g = grams(x, low, high)
        weight = sum(gain(bucket(y)) for y in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[:percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows(n=150):
    rng = random.Random(3)
    vocab = [f"{c}{k}" for c in "abcé" for k in range(30)]
    text = lambda m: "".join(rng.choice(vocab) + rng.choice([" ", "  ", ", ", "\n", "-"]) for _ in range(m))
    got = [(d, text(rng.randrange(0, 60))) for d in range(n)]
    got += [(n, None), (n + 1, ""), (n + 2, "?!"), (n + 3, "ONE"), (n + 4, text(4000)), (n + 5, got[5][1]), (n + 6, got[5][1].upper()), (None, text(40)), (None, None), (7, got[7][1]), (7, text(30))]
    return got, [text(50), None, "", "a1 a2 a3 " * 30]


@pytest.mark.parametrize(("low", "high", "percent"), [(1, 1, 10), (1, 3, 25), (2, 2, 100)])
def test_rows_against_plain_python(spark, make, low, high, percent):
    docs, target = rows()
    table = spark.createDataFrame([(x, "z") for x in target], "text string, doc_id string")
    got = resampling.resampled(make(docs), table, shortest=low, longest=high, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, target, low, high, percent=percent)


def test_every_run_of_words_is_matched_once():
    for n in (1, 2, 3):
        assert [m[0] for m in resampling.gram_pattern(n).finditer(b"a bb a bb c", overlapped=True)] == [" ".join(x).encode() for x in zip(*("a bb a bb c".split()[k:] for k in range(n)))]


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "text string")
    docs = [(1, "a b " * 20), (2, "c " * 30)]
    assert sorted((tuple(r) for r in resampling.resampled(make(docs), none, percent=50).collect()), key=str) == brute(docs, [], percent=50)
    assert resampling.resampled(make(docs).where("doc_id > 9"), none).count() == 0
    with pytest.raises(ValueError):
        resampling.resampled(make(docs), none, shortest=2, longest=1)
