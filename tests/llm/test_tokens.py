"""Encoding, counting and packing against the libraries on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitesift.llm import bpe, counts, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(8)
    alphabet = ["a", "B", "'s", "'T", " ", "  ", "\n", "\t", "é", "é", "ß", "Σ", "ΑΣ ", "İ", "ﬁ", "中", "👍🏽", " ", " ", "\x1c", "\x85", "9", "½", "…", "—", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "Ǆ", "ª", "²", "\x00", "​"]
    got = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    return got + ["word " * 40_000, "x" * 5000, " " * 3000, "A1 b2 " * 30_000 + "<|endoftext|>", "Hello, world's best!"]


def test_round_trip(make):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(900, None), (901, ""), (None, "x"), (3, "again"), (3, "again")]
    got = bpe.round_trip(make(rows), RANKS).collect()
    enc = bpe.encoding(RANKS)
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_encode_decode_tables(make):
    rows = [(1, "naïve café"), (2, None), (3, "퟿ 👍")]
    ids = bpe.encoded(make(rows), RANKS)
    assert {r.id: bytes(r.data) for r in bpe.decoded(ids, RANKS).collect()} == {1: "naïve café".encode(), 2: b"", 3: "퟿ 👍".encode()}


def test_long_texts_are_cut_where_nothing_changes():
    enc = bpe.encoding(RANKS)
    t = "It's 3 o'clock, and the 12 words go on.  Then\n\nmore " * 5000
    assert len(list(bpe.pieces(t))) > 2 and "".join(bpe.pieces(t)) == t
    assert bpe.encode_text(enc, t) == enc.encode_ordinary(t)


def test_counts_are_the_tokenizers(make):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(900, None), (901, ""), (None, "x y"), (3, "again"), (3, "again")]
    tok = Tokenizer.from_file(WORDS)
    got = counts.token_counts(make(rows), WORDS).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_counts_do_not_depend_on_what_is_frequent(make):
    """With few frequent pre-tokens nearly all pairs go through the shuffled join, copies and rows without an id included."""
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(7, "some words again"), (7, "some words again"), (None, "some words again"), (None, "some words again"), (8, None), (9, "")]
    tok = Tokenizer.from_file(WORDS)
    want = sorted((str(i), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for frequent in (0, 5):
        got = counts.token_counts(make(rows), WORDS, frequent=frequent).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want


def test_vocabulary_has_each_pre_token_once(make):
    rows = [(1, "It's the end, the END"), (2, "the"), (3, None), (3, "it")]
    got = {r.word: (r.n, r.pieces) for r in counts.vocabulary(make(rows), WORDS).collect()}
    assert {w: n for w, (n, _) in got.items()} == {"it": 2, "'s": 1, "the": 3, "end": 2, ",": 1}
    assert counts.vocabulary(make(rows).where("doc_id > 9"), WORDS).count() == 0


def test_cut_frequency_keeps_to_its_bound(make):
    words = make([(1, "a")]).sparkSession.createDataFrame([(f"w{k}", n) for k, n in enumerate([1, 1, 1, 2, 2, 3, 900, 3000, 5000])], "word string, n long")
    assert [counts.cut_frequency(words, most) for most in (9, 8, 6, 5, 3, 2)] == [1, 2, 2, 3, 900, 2048]
    assert words.where(F.col("n") >= counts.cut_frequency(words, 0)).count() == 0


def test_counts_of_an_empty_table(make):
    assert counts.token_counts(make([(1, "a")]).where("doc_id > 9"), WORDS).count() == 0


def test_best_fit_is_the_plain_one():
    rng = random.Random(2)
    for cap in (5, 64, 100):
        lengths = [rng.randrange(1, cap + 1) for _ in range(300)]
        rows, room = [], []
        for k in sorted(range(300), key=lambda k: (-lengths[k], k)):
            fits = [r for r in room if r >= lengths[k]]
            if fits:
                room[room.index(min(fits))] -= lengths[k]
            else:
                room.append(cap - lengths[k])
        rows = packing.best_fit(lengths, cap)
        assert sorted(k for r in rows for k in r) == list(range(300))
        assert sorted(cap - sum(lengths[k] for k in r) for r in rows) == sorted(room)


def test_packing_loses_nothing(make):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x", "é"]) for _ in range(rng.randrange(0, 400)))) for i in range(60)] + [(100, "word " * 5000), (101, None), (102, ""), (None, "nameless text")]
    packs = packing.packed(make(rows), RANKS, length=256, window_rows=8)
    enc = bpe.encoding(RANKS)
    segments = {}
    for r in packing.unpacked(packs).collect():
        segments.setdefault(r.id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u2").tolist()))
    for i, t in rows:
        ids, at = [], 0
        for start, part in sorted(segments.get(i, [])):
            assert start == at
            ids += part
            at += len(part)
        assert ids == enc.encode_ordinary(t or "")
    for p in packs.collect():
        assert len(p.ids) == 512 and p.cu_seqlens[0] == 0 and p.cu_seqlens[-1] == p.n_ids <= 256 and p.resets == p.cu_seqlens[:-1]
        assert set(np.frombuffer(bytes(p.ids), "<u2")[p.n_ids:].tolist()) <= {65535}
    assert packing.packed(make(rows).where("doc_id > 1000"), RANKS).count() == 0
