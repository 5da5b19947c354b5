"""Fingerprints, language, pages, conversations."""

import hashlib
import random
import time

import pytest

from sitesift.llm import chat, chunks, html, langid

SF = "/root/testdata/sf0.01"


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 123) for _ in range(60_000))
    for d in (b"", b"a", data[:31], data[:33], data, b"z" * 5000):
        ends = chunks.boundaries(d)
        assert (ends[-1] if ends else 0) == len(d) and all(b - a <= chunks.GREATEST for a, b in zip([0, *ends], ends, strict=False))
    whole, moved = chunks.chunk_set(data), chunks.chunk_set(b"inserted at the front" + data)
    assert chunks.containment(whole, moved) > 0.98
    assert chunks.containment({}, {}) == 1.0 and chunks.containment({}, {1: 2}) == chunks.containment({1: 2}, {}) == 0.0


def test_gear_hash_in_parts(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(10_000))
    want = chunks.boundaries(data)
    monkeypatch.setattr(chunks, "PART", 777)
    assert chunks.boundaries(data) == want


@pytest.mark.parametrize("parts", [1, 4])
def test_fingerprints_of_neighbours(spark, make, parts):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "bêta", "gamma", "x"]) + str(rng.randrange(99)) for _ in range(rng.randrange(0, 300)))) for i in rng.sample(range(10_000), 50)]
    rows += [(20_000, None), (-5, ""), (20_001, "é"), (None, "nameless"), (None, "another"), (77_777, "twice"), (77_777, "twice")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = chunks.fingerprinted(make(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    named = sorted([(i, t or "") for i, t in rows if i is not None], key=lambda r: (-r[0], r[1]))
    nameless = [r for r in got if r.doc_id is None]
    assert len(got) == len(rows) and len(nameless) == 2
    by = {}
    for k, (i, t) in enumerate(named[:-1]):
        by[i] = (t, named[k + 1][1])
    for r in got:
        if r.doc_id in by and r.doc_id != 77_777:
            t, after = by[r.doc_id]
            new = (t[:len(t) - len(t) // 2] + after[:len(t) // 2]).encode()
            a, b, c = chunks.chunk_set(t.encode()), chunks.chunk_set(new), chunks.chunk_set(after.encode())
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new).hexdigest(), chunks.written_set(a), chunks.written_set(b))
            assert (r.near_edited, r.near_next) == (chunks.containment(a, b), chunks.containment(a, c))
    assert chunks.fingerprinted(make(rows).where("doc_id > 99999")).count() == 0
    one = chunks.fingerprinted(make([(4, "lonely text")])).first()
    assert one.near_next == 1.0


def test_language_of_held_out_rows(spark):
    from sitesift.llm.common import table
    docs = table(spark, SF, "documents")
    got = langid.identified(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    out = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(make):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat and that was that " * 9, "en"), ("der hund und die katze sind nicht da " * 9, "de")] * 12)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 + 3 = !", "de"), (103, "und die katze nicht", None), (None, "the cat and the mat", "en"), (100, None, "en")]
    got = {r.doc_id: r for r in langid.identified(make(rows)).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "de", "en"] and got[100].score == 0
    kept = {r.doc_id for r in langid.accepted(make(rows)).collect()}
    assert not kept & {100, 101, 102} and {0, 1, 103, None} <= kept
    unlabelled = langid.identified(make([(1, "words", None)])).first()
    assert unlabelled.lang_pred == "und"
    assert langid.identified(make(rows).where("doc_id > 999")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">one</a></li></ul></nav><!-- no <p>text</p> --><div class="cookie-notice">We use</div>
<article><header><h1>Head&nbsp;line</h1></header><p>First <b>bold<br>text</b> &lt;tag&gt; &eacute;&#233;&amp;amp;<p>Second
  para<ul><li>item a<li>item b</ul><div class="ad">buy</div><form><p>send</p></form><aside>side</aside><footer>foot</footer>
<section class="comments"><p>nice!</p></section><noscript><p>js</p></noscript></article><div id="sidebar"><p>more</p></div><footer>&copy;</footer></body></html>"""


def test_article_text():
    p = html.Page(PAGE)
    assert p.text(set()) == "Head line\nFirst bold text <tag> éé&amp;\nSecond para\nitem a\nitem b"
    assert html.Page("").text(set()) == "" and html.Page("plain  words").text(set()) == "plain words"
    assert html.Page("<p>open <i>ended").text(set()) == "open ended"
    assert html.Page("<div>" * 30_000 + "deep").text(set()) == "deep"
    assert html.Page('<p title="a > b">x < y <3').text(set()) == "x < y <3"


def test_templates_of_a_host_go(spark):
    page = lambda k: f"<html><body><div class='top'><p>Acme daily — all the news</p></div><div><h2>Story {k}</h2><p>Body {k} {'word ' * (k + 3)}</p></div><table><tr><td>Contact us</td></tr></table></body></html>"
    rows = [(k, f"https://acme.example/{k}", page(k)) for k in range(30)] + [(100 + k, "http://other.example/x?y", page(0)) for k in range(30)] + [(200, None, None), (201, "", ""), (202, "nonsense", "<p>x</p>"), (5, "https://acme.example/5", page(5))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as host", "1 as content", "2 as hash")
    got = {r.page_id: r for r in html.extracted(df).collect()}
    assert got[7].text == f"Story 7\nBody 7 {' '.join(['word'] * 10)}" and got[7].n_chars == len(got[7].text)
    assert "Acme" in got[103].text  # thirty copies of one page are one page
    assert got[200].text == got[201].text == "" and got[202].text == "x" and html.extracted(df).count() == len(rows)
    assert html.extracted(df.where("page_id > 999")).count() == 0


def test_repeated_boxes_inside_the_article_go(spark):
    box = "<div class='card'><p>Written by our desk in Oslo</p></div>"
    page = lambda k: f"<html><body><article><h2>Today</h2><div class='body'><p>Story {k} {'word ' * (k + 9)}</p><p>The same line</p></div>{box if k % 3 else ''}<ul><li>few {k % 10}</li></ul></article></body></html>"
    df = spark.createDataFrame([(k, f"https://acme.example/{k}", page(k)) for k in range(120)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extracted(df).collect()}
    # the box stands on two pages of three; paragraphs and headings stay, and so does a list on a tenth of the pages
    assert all(t == f"Today\nStory {k} {' '.join(['word'] * (k + 9))}\nThe same line\nfew {k % 10}" for k, t in got.items()) and len(got) == 120


def test_markers():
    kinds = {"User: hi": 1 + 1, "### Human:": 2, "<|assistant|>": 3, "[context] x": 1, "A: yes": 3, "**Assistant**: ok": 3, "Alice: hi": 4, "A man walks": 0, "userland: no": 0, "": 0}
    assert {k: chat.marker(k)[0] for k in kinds} == kinds


def test_blocks_give_the_path_of_the_whole(spark, monkeypatch):
    from sitesift.llm.common import table
    raw = chat.transcripts(table(spark, SF, "conversations"))
    model = chat.learned(raw)
    rows = [(1, k, r.text) for k, r in enumerate(raw.orderBy("conv_id", "turn").limit(60).collect())] + [(2, 0, None), (None, 0, "User: x"), (None, 1, "Assistant: y"), (3, None, "Q: a"), (3, 1, ""), (2, 0, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "1 as block", "2 as role", "3 as entry")
    results = []
    for size in (256, 4):
        monkeypatch.setattr(chat, "BLOCK", size)
        got = chat.recovered(df, model).collect()
        texts = {}
        for r in sorted(got, key=lambda r: (str(r.conv_id), r.part, r.place)):
            texts[r.conv_id] = texts.get(r.conv_id, "") + r.rendered
        results.append(texts)
    assert results[0] == results[1] and set(results[0]) == {1, 2, 3, None}
    assert all(t.count("<|end|>") >= 1 and t.endswith("<|end|>\n") for t in results[0].values())
    assert chat.recovered(df.where("conv_id > 9"), model).count() == 0


def plain_viterbi(lines, model):
    """Best path over a whole transcript, one line after the other."""
    seen = chat.codes(lines)
    v, back = [model["start"][s] + model["emit"][s, seen[0]] for s in range(chat.STATES)], []
    for c in seen[1:]:
        step = [max(range(chat.STATES), key=lambda p, s=s: (v[p] + model["move"][p, s], -p)) for s in range(chat.STATES)]
        back.append(step)
        v = [v[step[s]] + model["move"][step[s], s] + model["emit"][s, c] for s in range(chat.STATES)]
    path = [max(range(chat.STATES), key=lambda s: (v[s], -s))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("size", [256, 3, 1])
def test_paths_against_a_plain_viterbi(spark, monkeypatch, size):
    """Blank lines at block ends, empty pieces, equal and unknown turn numbers, a transcript without an id."""
    from sitesift.llm.common import table
    model = chat.learned(chat.transcripts(table(spark, SF, "conversations")))
    rng = random.Random(9)
    said = ["User: what now?", "Assistant: that", "System: be kind", "more of it", "", "ends blank\n", "\nstarts blank", "Q: why?\nand so on\n\n", "A: so", None, "Bob: hello"]
    rows = [(c, None if rng.random() < 0.3 else rng.randrange(6), rng.choice(said)) for c in (1, 2, None) for _ in range(40)] + [(3, 0, ""), (4, None, None)]
    monkeypatch.setattr(chat, "BLOCK", size)
    got = chat.recovered(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model).collect()
    for conv in (1, 2, None, 3, 4):
        own = sorted(((t is None, t or 0, x or "") for c, t, x in rows if c == conv))
        path = plain_viterbi([line for *_, x in own for line in x.split("\n")], model)
        want = [(chat.ROLES[s // 2], s % 2 == 0) for s in path]
        mine = [r for r in sorted(got, key=lambda r: (r.part, r.place)) if r.conv_id == conv]
        assert [(r.role, r.starts and k == 0) for r in mine for k in range(r.n_lines)] == want
        assert max(r.n_lines for r in mine) <= max(4 * size, 4) or size == 256


def test_roles_come_back(spark):
    from pyspark.sql import functions as F
    from sitesift.llm.common import table
    raw = chat.transcripts(table(spark, SF, "conversations"))
    train = F.pmod(F.xxhash64("conv_id"), F.lit(16)) < 12
    model = chat.learned(raw.where(train))
    got = chat.recovered(raw.where(~train), model).where("starts").orderBy("conv_id", "part", "place").collect()
    want = raw.where(~train).orderBy("conv_id", "turn").collect()
    seen, true = {}, {}
    for r in got:
        seen.setdefault(r.conv_id, []).append(r.role)
    for r in want:
        true.setdefault(r.conv_id, []).append(r.role)
    right = sum(sum(a == b for a, b in zip(seen[c], true[c], strict=False)) for c in true)
    assert right >= 0.9 * len(want)


@pytest.mark.parametrize("page", ["<b>" * 330_000, "<a " * 330_000, "<a " * 330_000 + ">", "</i>" * 250_000, '<a "' * 250_001 + ">", "<p>" * 330_000, "<div>" * 200_000, "<" * 1_000_000, "<!-- " * 200_000, "<ul><li>" * 125_000, "<a " + "x" * 1_000_000 + "=>"])
def test_broken_pages_of_a_megabyte_are_read_in_time(page):
    start = time.process_time()
    html.Page(page + "x").settled({1})
    assert time.process_time() - start < 20


def test_menus_of_changing_words_go_by_their_shape(spark):
    """No class or tag says that these boxes are no article; their shape, the same on every page of the host, does."""
    def page(k):
        box = f"<div class=x1><ul><li>w{k}</li><li>v{k}</li></ul></div><section class=x2>seen {k} times</section>"
        return f"<html><body>{box}<article><h1>t{k}</h1><p>own text of {k}, long enough to stay</p><ul><li>one {k}</li><li>two {k}</li></ul></article><div class=x3>end {k}</div></body></html>"
    rows = [(k, "http://a.example/p", page(k)) for k in range(12)] + [(50 + k, "http://b.example/p", page(k)) for k in range(4)]
    rows += [(90, "http://a.example/q", page(90).replace("</body>", "<div class=only>once</div></body>"))]
    got = {r.page_id: r for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].text == f"t{k}\nown text of {k}, long enough to stay\none {k}\ntwo {k}" for i, k in [*((k, k) for k in range(12)), *((50 + k, k) for k in range(4)), (90, 90)])
    assert [got[k].settled_by for k in (0, 11, 50, 53, 90)] == ["counts", "counts", "marks", "marks", "marks"]


def test_hashes_of_shape_and_text():
    a, b = (html.Page(f"<body><nav><ul><li>{x}</li><li>{x}{x}</li></ul></nav><article><p>{x} and more text than the menu</p></article></body>") for x in ("p", "q"))
    own = [{a.tags[k]: hs for k, hs in p.hashes().items()} for p in (a, b)]
    assert own[0]["nav"][0] != own[1]["nav"][0] and own[0]["nav"][1] == own[1]["nav"][1] and "li" not in own[0] and len(own[0]) == 2


def test_fingerprint_parts_need_no_python(make):
    from sitesift.llm import chunks
    rows = [(i, f"text {i}") for i in (5, 1, -3, 9, 9, 2**60)] + [(None, "a"), (None, None)]
    dealt, _n = chunks.in_order(make(rows), "doc_id", "text")
    assert "Python" not in dealt._jdf.queryExecution().executedPlan().toString()
    part = {r.id: r.part for r in dealt.filter("halo = 0 AND id IS NOT NULL").collect()}
    order = sorted(part, reverse=True)
    assert len(part) == 5 and [part[i] for i in order] == sorted(part.values())
