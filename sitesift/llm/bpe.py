"""Byte-level BPE with the ranks of a local file: encoding and decoding through tiktoken, inside tasks.

Long texts are cut where the splitting pattern always begins a new match: before an ASCII space that stands between two ASCII
letters or digits. Pieces are encoded one by one, so their ids follow each other as if the whole text had been encoded at once.
"""

import base64
import hashlib
import re
import sys

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import out, per_worker, texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")


def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoder of one rank file, read once in each Python worker; executors need the file at the same path."""
    def make():
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return per_worker(f"bpe {path} {pattern}", make)


def pieces(text: str, size: int = PIECE_CHARS):
    """Cut at safe places, each piece at least `size` characters long but the last; joined they are the text."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text) for i in enc.encode_ordinary(p)]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of every row's whole text; null text has none."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        enc = encoding(path)
        for b in batches:
            yield out(schema, id=b.column("id"), ids=[encode_text(enc, t) for t in texts(b, "text")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")


def decoded(rows: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the raw bytes the ids stand for, also where they are not whole UTF-8 characters."""
    schema = pa.schema([("id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        enc = encoding(path)
        for b in batches:
            yield out(schema, id=b.column("id"), data=[enc.decode_bytes(x or []) for x in b.column("ids").to_pylist()])

    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encode, then decode the ids, in one pass.

    ids_sha256 is over the decimal ids joined by one space; null and empty texts have no ids and empty bytes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        enc = encoding(path)
        names = per_worker(f"names {path}", lambda: [str(i) for i in range(enc.max_token_value + 1)])
        for b in batches:
            n, first, second = [], [], []
            for t in texts(b, "text"):
                ids = encode_text(enc, t)
                n.append(len(ids))
                first.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                second.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield out(schema, doc_id=b.column("id"), n_tokens=n, ids_sha256=first, decoded_sha256=second)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
