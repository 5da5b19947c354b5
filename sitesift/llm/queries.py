"""The registered queries: each operator over its whole table, with production parameters, and SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, chunks, counts, decontam, html, langid, licenses, packing, resampling, search, simhash, suffixes
from .common import table


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts made of the conversations, read back into turns by a model of all labelled turns."""
    raw = chat.transcripts(table(spark, folder, "conversations"))
    return chat.recovered(raw, chat.learned(raw))


def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.fingerprinted(table(spark, folder, "documents"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extracted(table(spark, folder, "pages"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identified(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.report(table(spark, folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items")


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(table(spark, folder, "documents"))


def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_document_fingerprints, op3_byte_bpe, op4_token_packing, op5_html_extraction, op6_language_id, op7_token_counts,
                                   op8_suffix_dedup, op9_simhash, op10_decontamination, op11_license_scan, op12_resampling, op13_ranked_search)}

#: windows as runs of joined words; only lengths that some item has are looked for
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), p AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n
), hit AS (
  SELECT p.doc_id, p.k, p.n, iw.item_id FROM p JOIN iw ON iw.n = p.n AND iw.t = array_to_string(p.w[p.k:p.k + p.n - 1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AND 20 * coalesce(words.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

#: A-Z lower-cased words of a text
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TEMPLATES = ", ".join(f"({n}, '{label}', '{phrase}', {str(base).lower()})" for n, (label, phrase, base) in
                       enumerate([(*x, True) for x in licenses.PHRASES] + [(*x, False) for x in licenses.NOTICES]))

#: runs of joined words on diagonals, neighbouring diagonals chained, words of a template counted per chain
OP11_SQL = f"""
WITH t AS (
  SELECT template, label, base, string_split(phrase, ' ') AS w, least({licenses.RUN}, len(string_split(phrase, ' '))) AS size FROM (VALUES {_TEMPLATES}) v(template, label, phrase, base)
), tr AS (
  SELECT template, size, k - 1 AS place, array_to_string(w[k:k + size - 1], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM t)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), dr AS (
  SELECT r, size, k - 1 AS pos, array_to_string(w[k:k + size - 1], ' ') AS run FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM tr) WHERE len(w) >= size)
), h AS (
  SELECT r, template, pos - place AS diagonal, place FROM dr JOIN tr USING (size, run)
), g AS (
  SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {licenses.SLACK}, true) THEN 1 ELSE 0 END AS apart
  FROM (SELECT DISTINCT r, template, diagonal FROM h) JOIN t USING (template)
), c AS (
  SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM g
), x AS (
  SELECT r, template, span, count(DISTINCT word) AS there, min(diagonal + word) AS start
  FROM (SELECT h.r, h.template, span, h.diagonal, unnest(range(place, place + size)) AS word FROM h JOIN c ON c.r = h.r AND c.template = h.template AND c.diagonal = h.diagonal) GROUP BY ALL
), y AS (
  SELECT r, label, base AND there = len(w) AS counted, start, there / CAST(len(w) AS DOUBLE) AS share, CASE WHEN base OR len(w) < {licenses.WHOLE} THEN 1.0 ELSE {licenses.SHARE} END AS least_share
  FROM x JOIN t USING (template)
), z AS (
  SELECT r, count(*) FILTER (counted) AS n_base, min(start) FILTER (counted) AS first_word, max(start) FILTER (counted) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (counted) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= least_share) AS labels, round(max(share), 6) AS score
  FROM y GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM d LEFT JOIN z ON z.r = d.r
"""


def _crc_steps(x: str, steps: int = 8) -> str:
    """Eight steps of the reflected CRC-32 polynomial over one byte."""
    for _ in range(steps):
        x = f"(SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM (SELECT {x} AS v))"
    return x


#: CRC-32 of each distinct word from a table of 256 remainders, buckets, gains, noise and the draw
OP12_SQL = f"""
WITH remainder AS (
  SELECT list({_crc_steps("CAST(i AS BIGINT)")} ORDER BY i) AS tab FROM range(256) b(i)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), dw AS (
  SELECT r, unnest(w) AS word FROM d
), tw AS (
  SELECT unnest({WORDS}) AS word FROM benchmark
), crc AS (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(x) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT))),
              lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % {resampling.BUCKETS} AS bucket
  FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM tw)), remainder
), s AS (
  SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM tw JOIN crc USING (word) GROUP BY bucket
), n AS (
  SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM tw) AS t_all
), g AS (
  SELECT s.bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + {resampling.BUCKETS}) / ((CAST(s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + {resampling.BUCKETS})))) AS BIGINT) AS gain
  FROM s LEFT JOIN t ON t.bucket = s.bucket, n
), m AS (
  SELECT r, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN crc USING (word) JOIN g USING (bucket) GROUP BY r
), h AS (
  SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, substr(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS x FROM d LEFT JOIN m ON m.r = d.r
), c AS (
  SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((list_sum(list_transform(range(0, 8), lambda i: (instr('0123456789abcdef', x[i + 1]) - 1) * (1::BIGINT << (4 * (7 - i))))) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM h
), o AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS fit FROM c WHERE n_features >= {resampling.LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {resampling.PERCENT} * fit // 100 THEN place END AS rank FROM c LEFT JOIN o ON o.r = c.r
"""

OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents
), s AS (
  SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d
), item AS (
  SELECT DISTINCT item_id, text, unnest({WORDS}) AS term FROM benchmark
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY ALL
), p AS (
  SELECT tf.* FROM tf SEMI JOIN item USING (term)
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2e0 * n_docs + 2) / (2e0 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, n_docs
), sums AS (
  SELECT item_id, text, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + {search.SATURATION} * ({100 - search.LENGTH_PERCENT} + ({search.LENGTH_PERCENT} * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM item JOIN p USING (term) JOIN weights USING (term), s GROUP BY ALL
), places AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM sums WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM places WHERE rank <= {search.K}
"""

ORACLE = {"op10_decontamination": OP10_SQL, "op11_license_scan": OP11_SQL, "op12_resampling": OP12_SQL, "op13_ranked_search": OP13_SQL}
