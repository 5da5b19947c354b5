"""SimHash against brute force over all pairs."""

import random

import numpy as np
import xxhash

from sitesift.llm import simhash
from sitesift.operators.graph import components


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    n = min(4, len(words))
    h = [xxhash.xxh64(" ".join(words[i:i + n]).encode(), seed=42).intdigest() for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(ids, near):
    """Smallest reachable id by repeated passes."""
    label = {i: i for i in range(len(ids))}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    return [least.get(label[k]) for k in range(len(ids))]


def test_fingerprint_is_the_plain_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 60):
        t = " \t\n".join(rng.choice(["Ab", "É", "c\x0b", "dE", " x"]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) == plain(t)


def test_rows_against_all_pairs(make):
    rng = random.Random(5)
    base = [[rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(200)] for _ in range(12)]
    rows = [(100 - k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(60):  # edits of one word keep few bits apart
        w = list(base[k % 12])
        w[rng.randrange(200)] = "new"
        rows.append((200 + k, " ".join(w)))
    rows += [(7, None), (9, ""), (8, " \n "), (None, rows[0][1]), (300, "one two"), (301, "one  TWO"), (301, "one  TWO"), (None, "alone here")]
    got = simhash.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    fp = [plain(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4]
    want = sorted(map(str, zip([r[0] for r in rows], [f"{x:016x}" for x in fp], grouped([r[0] for r in rows], near), strict=True)))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want


def test_crowded_points_in_blocks(spark):
    """A dense cloud of fingerprints with blocks of eight gives the components of all pairs."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(60):
            x = c
            for b in rng.sample(range(12), rng.randrange(1, 6)):
                x ^= 1 << (b * 5)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for block in (8, 4096):
        got = {r.node: r.label for r in components(simhash.links(df, 4, block)).collect()}
        near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
        want = grouped(list(range(len(fps))), near)
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        label = [got.get(s, s) for s in signed]
        assert len(set(zip(label, want, strict=True))) == len(set(label)) == len(set(want))


def test_forest_and_empty(spark, make):
    f = np.array([0, 1, 3, 1 << 40, (1 << 40) | 7], np.uint64)
    assert len(simhash.forest(f, 4)) == 4 - 1 + 0 or len(simhash.forest(f, 4)) >= 3
    assert simhash.near_duplicates(make([(1, "x")]).where("doc_id > 5")).count() == 0
    line = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (None, 4)], "a long, b long")
    assert {r.label for r in components(line).collect()} == {0}


def test_links_between_blocks_are_a_forest():
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = lambda n: np.unique([c ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for c in centres for i, j in rng.integers(0, 60, (n, 2))]).astype(np.uint64)
    a = near(12)
    b = np.setdiff1d(near(20), a)

    def groups(edges):
        up = {}

        def root(v):
            while up.setdefault(v, v) != v:
                v = up[v]
            return v
        for x, y in edges:
            up[root(x)] = root(y)
        every = {}
        for v in list(up):
            every.setdefault(root(v), set()).add(v)
        return {frozenset(g) for g in every.values()}

    linked = [(int(x), int(y)) for x in a for y in b if int(x ^ y).bit_count() <= 3]
    got = simhash._cross(a, b, 3)
    whole = groups(linked)
    assert groups(got) == whole and set(got) <= set(linked) and len(got) == sum(len(g) - 1 for g in whole) < len(linked)
