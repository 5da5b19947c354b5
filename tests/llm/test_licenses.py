"""Licence scan against a plain look at every place and every span."""

import re

from sitesift.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text):
    w, base, labels, score = words(text), [], set(), 0.0
    for counted, group in ((True, licenses.PHRASES), (False, licenses.NOTICES)):
        for label, phrase in group:
            v = phrase.split()
            size = min(licenses.RUN, len(v))
            hits = {}
            for q in range(len(w) - size + 1):
                for p in range(len(v) - size + 1):
                    if w[q:q + size] == v[p:p + size]:
                        hits.setdefault(q - p, set()).update(range(p, p + size))
            chains = []
            for k in sorted(hits):
                if counted or not chains or k - chains[-1][0] > licenses.SLACK:
                    chains.append([k, set(hits[k]), min(k + x for x in hits[k])])
                else:
                    chains[-1] = [k, chains[-1][1] | hits[k], chains[-1][2]]
            for _, there, start in chains:
                share = len(there) / len(v)
                score = max(score, share)
                if counted and share == 1:
                    base.append((start, label))
                if share >= (1 if counted or len(v) < licenses.WHOLE else licenses.SHARE):
                    labels.add(label)
    at = [s for s, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 6)


BSD = next(p for label, p in licenses.NOTICES if label == "bsd").split()
MIT = max((p for label, p in licenses.NOTICES if label == "mit"), key=len)
ROWS = [
    (1, "Released under the MIT License. mit-license; MIT\nLicense mit mit license"), (2, "GNU General Public License, version 3"), (3, "general public general public license"),
    (4, " ".join(BSD)), (5, "x " + " ".join([*BSD[:7], "quite", "new", *BSD[7:]]) + " y"), (6, " ".join(BSD[:9])), (7, " ".join(w for k, w in enumerate(BSD) if k != 10)),
    (8, " ".join([*BSD[:7], *["gap"] * 9, *BSD[7:]])), (9, MIT.upper()), (10, MIT + " " + MIT), (11, "Licensed under CC BY-NC 4.0."), (12, "licensed under cc by 4.0"), (13, "licensed under CC"),
    (14, None), (15, ""), (16, "--- !!"), (17, "MIT"), (18, "éapache license apachelicense APACHE LICENSE apache licenseé"), (19, "apache license " * 3000), (20, "mit license"), (20, "mit license"),
    (None, "All rights reserved"), (None, None), (21, "the mit license " + "word " * 40000 + "apache license"), (22, "copy of the software copy of the software copy of the software"),
]


def test_rows_against_a_plain_scan(spark, make):
    got = licenses.scanned(make(ROWS)).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted((tuple(r) for r in got), key=lambda r: str(key(r))) == sorted(((i, *brute(t)) for i, t in ROWS), key=lambda r: str(key(r)))
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].labels == "bsd" and by[8].labels == "" and by[6].labels == "" and by[7].labels == "bsd" and by[9].labels == "mit" and by[9].n_base == 0
    assert (by[19].n_base, by[19].last_word) == (3000, 5998)


def test_spans_are_given_and_templates_can_be_chosen(spark, make):
    templates = licenses.template_table(spark, [("own", "you may use this data freely for research and for nothing else", False)])
    found = licenses.spans(licenses.votes(make([(1, "Note: you may use this data very freely for research, and for nothing else. End")]), templates), templates).collect()
    assert [(r.id, r.label, r.first_word, r.last_word, r.share) for r in found] == [(1, "own", 1, 13, 1.0)]


def test_no_rows(spark, make):
    assert licenses.scanned(make([(1, "mit license")]).where("doc_id > 1")).count() == 0
