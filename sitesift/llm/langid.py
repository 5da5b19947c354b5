"""Language by compression: a text belongs to the language whose dictionary compresses it best.

For each language a zstandard raw-content dictionary holds lower-cased letters of sampled training texts. A text is reduced
to its letters, cut into segments so that dictionaries keep their weight in long texts, and every segment of the whole text
is compressed with every dictionary. The least sum of sizes wins; score is the margin of the runner-up as a share of its size,
brought to 0 to 1. A narrow margin is a reason to reject, which is the caller's choice.
"""

import sys

import pyarrow as pa
import regex
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from .common import out, per_worker, texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: the bounded training sample: texts a language, characters a text, bytes of a dictionary
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 128, 64 << 10
SEGMENT, SPREAD = 1024, 128
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


def letters(text: str) -> str:
    return " ".join(_LETTERS.findall(text.lower()))


def dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """A dictionary per language from a bounded sample of rows with text and language: the `SAMPLE_TEXTS` texts with the least
    hash, chosen in two steps so that no task sorts a whole language. Rows without either are not used."""
    rows = (labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.substring(text_col, 1, 4 * SAMPLE_CHARS).alias("text")))
    best = Window.partitionBy("lang", "part").orderBy("h", "text")
    part = rows.withColumn("part", F.pmod("h", F.lit(SPREAD))).withColumn("n", F.row_number().over(best)).where(F.col("n") <= SAMPLE_TEXTS // SPREAD)
    sample: dict[str, list[str]] = {}
    for r in part.select("lang", "h", "text").dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect():
        sample.setdefault(r["lang"], []).append(letters(r["text"])[:SAMPLE_CHARS])
    return {lang: " ".join(x).encode()[:DICTIONARY_BYTES] for lang, x in sorted(sample.items()) if any(x)}


def sizes(text: str, compressors) -> list[int]:
    data = letters(text).encode()
    parts = [data[i:i + SEGMENT] for i in range(0, len(data), SEGMENT)]
    if len(parts) > 1 and len(parts[-1]) < SEGMENT // 4:
        parts[-2:] = [parts[-2] + parts[-1]]
    return [sum(len(c.compress(p)) for p in parts) for c in compressors] if data else []


def _compressors(books: dict[str, bytes]):
    """Matches of three bytes and up count: syllables tell languages apart in short segments."""
    made = []
    for b in books.values():
        how = zstandard.ZstdCompressionParameters.from_level(3, source_size=SEGMENT, dict_size=len(b), min_match=3, strategy=zstandard.STRATEGY_BTOPT, search_log=3,
                                                             write_checksum=False, write_content_size=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
    return made


def predicted(docs: DataFrame, books: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, margin) of every row by its text alone.

    A null text or one without letters is `und` with score 0; so is every text where there are no dictionaries. Ties go
    to the first language in alphabetical order, with margin 0. margin: the runner-up's size over the best one, less 1.
    """
    names = list(books)
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])
    key = f"zstd {hash(tuple(books.items()))}"

    def run(batches):
        own = per_worker(key, lambda: _compressors(books))
        for b in batches:
            lang, score, margin = [], [], []
            for t in texts(b, "text"):
                got = sizes(t, own)
                if not got:
                    lang.append(UNKNOWN), score.append(0.0), margin.append(0.0)
                    continue
                order = sorted(range(len(got)), key=got.__getitem__)
                gap = (got[order[1]] / got[order[0]] - 1) if len(got) > 1 else 1.0
                lang.append(names[order[0]]), margin.append(gap), score.append(min(1.0, 0.5 + gap))
            yield out(schema, id=b.column("id"), lang_pred=lang, score=score, margin=margin)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, margin double")


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin) of every row; learned from the rows that are not held out (crc32 of the id
    as text, modulo 4, is 2). A row without an id is not held out."""
    books = dictionaries(docs.where(~is_held_out(id_col)), text_col, lang_col, id_col)
    return predicted(docs, books, id_col, text_col).select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "lang_pred", "score", "margin")


def accepted(docs: DataFrame, min_margin: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is known with more than the margin, with their own columns: `und` and narrower ones go."""
    books = dictionaries(docs.where(~is_held_out(id_col)), text_col, lang_col, id_col)
    names = [f.name for f in docs.schema.fields]

    def run(batches):
        own = per_worker(f"zstd {hash(tuple(books.items()))}", lambda: _compressors(books))
        for b in batches:
            keep = []
            for t in texts(b, text_col):
                got = sorted(sizes(t, own))
                keep.append(bool(got) and (len(got) == 1 or got[1] / got[0] - 1 > min_margin))
            yield b.filter(pa.array(keep, pa.bool_())).select(names)

    return docs.mapInArrow(run, docs.schema)
