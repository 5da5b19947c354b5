"""Token counts: pieces once per distinct pre-token, joined to the pre-token frequencies of each document.

The tokenizer's own rules cut a text into pre-tokens (normalised, lower-cased words). A first pass counts every distinct
pre-token of the corpus; each is then run through the merges once, many in one call, where only the ends of words are looked at. A
second pass takes each document's pre-token frequencies and joins them to those counts. No document's ids are built.

The join has two sides by the corpus-wide frequency of a pre-token, as words are very uneven: the most frequent ones, at most
`FREQUENT` however large the corpus, are broadcast and joined where the document is read; the pairs of all others are shuffled
on the pre-token. Such a pre-token occurs less often than the last frequent one, so no key of that join is hot.

Texts for which the quick rules might differ from the tokenizer's are normalised by the tokenizer itself.
"""

import collections
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import out, per_worker, row_key, utf8, written
from ..session import spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT, AT_ONCE = 2048, 1 << 15
#: distinct pre-tokens a task holds before it hands them on; most pre-tokens that are broadcast, and their longest size in bytes
KNOWN, FREQUENT, LONGEST = 400_000, 1 << 18, 64
#: frequencies up to here are told apart one by one, greater ones by powers of two
FINE = 1 << 10
#: ranges where Python and the tokenizer agree on letters, numbers, spaces, case and composition: ASCII, Latin, Greek, Cyrillic,
#: without the capital sigma and the dotted capital I; others go through the tokenizer
_PLAIN = regex.compile(r"[\x09\x0A\x0D\x20-\x7E¡-įı-ſΑ-ΡΤ-ωА-я–-…]*")


class Counter:
    """The rules of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = [p for p in rules["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if len(split) != 1 or rules["model"].get("end_of_word_suffix") != "</w>" or rules["post_processor"]:
            raise ValueError("a BPE with word ends and one splitting pattern is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pattern = regex.compile(split[0]["pattern"]["Regex"])
        special = [t["content"] for t in rules["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        ends = [i for w, i in rules["model"]["vocab"].items() if w.endswith("</w>")]
        self.is_end = np.zeros(1 + max([*rules["model"]["vocab"].values(), *(t["id"] for t in rules["added_tokens"])]), bool)
        self.is_end[ends] = True

    def pre_tokens(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self.pattern.findall(text.lower())
        return self.pattern.findall(self.tokenizer.normalizer.normalize_str(text))

    def frequencies(self, text: str) -> tuple[int, collections.Counter]:
        """Special strings of a text, and how often it has each pre-token."""
        if self.special is None or "<|" not in text:
            return 0, collections.Counter(self.pre_tokens(text))
        got = collections.Counter()
        for part in self.special.split(text):
            got.update(self.pre_tokens(part))
        return len(self.special.findall(text)), got

    def pieces(self, words: list[str]) -> np.ndarray:
        """Pieces of each pre-token: a blank parts them, and the last piece of each is a word end."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.is_end[ids])
        if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids) - 1):
            return np.diff(ends, prepend=-1)
        return np.array([len(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in words], np.int64)


def counter(path: str) -> Counter:
    return per_worker(f"counter {path}", lambda: Counter(path))


def vocabulary(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n, pieces): each distinct pre-token of the corpus once, its occurrences and its pieces."""
    seen = pa.schema([("word", pa.string()), ("n", pa.int64())])
    schema = pa.schema([*seen, ("pieces", pa.int64())])

    def run(batches):
        own, tally = counter(path), collections.Counter()
        for b in batches:
            for t in utf8(b, "text"):
                tally.update(own.frequencies(t.decode())[1])
                if len(tally) > KNOWN:
                    yield out(seen, word=list(tally), n=list(tally.values()))
                    tally = collections.Counter()
        yield out(seen, word=list(tally), n=list(tally.values()))

    def measure(batches):
        own = counter(path)
        for b in batches:
            words = b.column("word").to_pylist()
            found = [own.pieces(words[i:i + AT_ONCE]) for i in range(0, len(words), AT_ONCE)]
            yield out(schema, word=b.column("word"), n=b.column("n"), pieces=pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))

    # a task's pre-tokens are distinct already; merging them is heavy for its few bytes, so parts are set by the cores
    seen_words = spread(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long"), "word")
    words = seen_words.groupBy("word").agg(F.sum("n").alias("n"))
    return words.mapInArrow(measure, "word string, n long, pieces long")


def cut_frequency(words: DataFrame, most: int) -> int:
    """The least frequency (whole below FINE, a power of two above) that at most `most` pre-tokens reach; a table of some
    thousand frequencies at most is read."""
    step = F.when(F.col("n") <= FINE, F.col("n")).otherwise(F.expr("shiftleft(1L, length(bin(n)) - 1)"))
    sizes = {r["step"]: r["words"] for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}
    above, cut = 0, 1 + 2 * max(sizes, default=0)
    for n in sorted(sizes, reverse=True):
        above += sizes[n]
        if above > most:
            break
        cut = n
    return cut


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text, as the tokenizer of the file gives them without added
    tokens; special strings in a text count as one each. Null and empty texts have no bytes and no tokens; a null id stays
    null; repeated rows repeat."""
    words = written(vocabulary(docs, path, text_col), "pieces")
    short = words.where(F.octet_length("word") <= LONGEST)
    cut = cut_frequency(short, frequent)
    is_frequent = (F.octet_length("word") <= LONGEST) & (F.col("n") >= cut)
    top = words.where(is_frequent).select("word", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), top.column("pieces").to_pylist(), strict=True)))
    pair = pa.struct([("word", pa.string()), ("k", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("rest", pa.list_(pair))])

    def run(batches):
        own, get = counter(path), known.value.get
        for b in batches:
            n_bytes, n_tokens, word, often, ends = [], [], [], [], [0]
            for t in utf8(b, "text"):
                total, found = own.frequencies(t.decode())
                for w, k in found.items():
                    p = get(w)
                    if p is None:
                        word.append(w), often.append(k)
                    else:
                        total += k * p
                n_bytes.append(len(t)), n_tokens.append(total), ends.append(len(word))
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(word, pa.string()), pa.array(often, pa.int64())], fields=list(pair)))
            yield out(schema, id=b.column("id"), rid=b.column("rid"), n_bytes=n_bytes, n_tokens=n_tokens, rest=rest)

    base = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    rows = written(base.mapInArrow(run, "id long, rid long, n_bytes long, n_tokens long, rest array<struct<word:string,k:long>>"), "frequencies")
    # repeated rows have equal pairs: their sum is the copies times the row's own, and so is the number of pairs
    open_ = rows.where("size(rest) > 0").withColumn("pairs", F.size("rest"))
    sums = (open_.select("rid", F.explode("rest").alias("p")).select("rid", "p.word", "p.k").join(words.where(~is_frequent).select("word", "pieces"), "word")
            .groupBy("rid").agg(F.sum(F.col("k") * F.col("pieces")).alias("s"), F.count("*").alias("c")))
    late = open_.drop("rest").join(sums, "rid").select("id", "n_bytes", (F.col("n_tokens") + F.expr("s div (c div pairs)")).alias("n_tokens"))
    return (rows.where("size(rest) = 0").select("id", "n_bytes", "n_tokens").unionByName(late)
            .select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
