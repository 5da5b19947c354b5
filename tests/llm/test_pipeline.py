"""The pipeline against the plain versions of its stages, one after the other."""

import random

import corpus_pipeline
import public_tokenizers

from sitesift.llm import bpe, langid
from tests.llm.test_decontam import brute as benchmark_brute
from tests.llm.test_simhash import grouped, plain
from tests.llm.test_suffixes import brute as passages_brute


def corpus():
    rng = random.Random(12)
    en, de = ("the of and that with from this have which their would there".split(), "der die und nicht eine werden haben durch zwischen schon wieder".split())
    text = lambda words, n: " ".join(rng.choice(words) + str(rng.randrange(400)) * (rng.random() < 0.6) + rng.choice(["", "", "ly", "en"]) for _ in range(n))
    shared, item = text(en, 60), text(en, 30)
    rows = [(i, text(en if i % 2 else de, rng.randrange(60, 200)), "en" if i % 2 else "de") for i in range(60)]
    for k in (5, 9, 13):
        rows[k] = (rows[k][0], f"{text(en, 20)} {shared} {text(en, 20)}", "en")
    rows[17] = (17, f"{text(en, 10)} {item}", "en")
    rows[19] = (19, f"{text(en, 2000)} {item}", "en")
    rows += [(100, rows[3][1], "en"), (101, rows[3][1] + " more", "en"), (102, None, "en"), (103, "12 34 !!", "en"), (104, "", None), (3, rows[3][1], "en")]
    return rows, [(0, item), (1, text(de, 20)), (2, None)]


def expected(spark, make):
    rows, items = corpus()
    books = langid.dictionaries(make(rows).where(~langid.is_held_out()))
    own = langid._compressors(books)
    sure = lambda t: len(s := sorted(langid.sizes(t or "", own))) > 1 and s[1] > s[0]
    rows = [(i, t) for i, t, _ in rows if sure(t)]
    fp = [plain(t) for _, t in rows]
    group = grouped([i for i, _ in rows], [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    rows = sorted({(i, t) for (i, t), g in zip(rows, group, strict=True) if i == g})
    docs, _, drop = passages_brute(rows, 50)
    cut = []
    for i, t in rows:
        words, gone = docs[False, i, t], drop[False, i, t]
        cut.append((i, "".join((" " if k and not {k - 1, k} <= gone else "") + ("" if k in gone else w) for k, w in enumerate(words))))
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return {i: enc.encode_ordinary(t) for i, t in cut if not benchmark_brute(t, items)[4]}, len(rows)


def test_run_equals_the_plain_stages(spark, make, tmp_path):
    rows, items = corpus()
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want, before = expected(spark, make)
    assert got == want
    assert 17 not in got and 19 in got and not {100, 102, 103, 104} & set(got) and len(got) < before


def test_stages_take_empty_tables(spark, make, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = make(rows).where("doc_id > 1000")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0, name
        assert name == "encoded" or out.columns == corpus_pipeline.COLUMNS
