"""Token ids packed to rows of fixed length by best-fit decreasing.

Documents longer than a row are split without loss; pieces are sorted by length and each goes to the open row with the least
room that still holds it, found in a segment tree over capacities. Packing runs inside tasks on windows of bounded size,
in the order in which rows are read, so nothing is shuffled and a lost task is simply run again.
"""

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .bpe import encode_text, encoding
from .common import texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH, WINDOW_ROWS, PAD = 2048, 1024, 0xFFFF


class Capacity:
    """How many open rows have each amount of room, as a segment tree: the least room of at least n in log steps."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def best(self, need: int) -> int:
        """The least room of at least `need` that some row has, or -1."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of piece numbers; pieces by falling length, equal ones in their order."""
    rows: list[list[int]] = []
    room_of: dict[int, list[int]] = {}
    tree = Capacity(capacity)
    for n in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = lengths[n]
        if not 0 < need <= capacity:
            raise ValueError("pieces must have 1 to capacity ids")
        room = tree.best(need)
        if room < 0:
            rows.append([n])
            at, left = len(rows) - 1, capacity - need
        else:
            at = room_of[room].pop()
            tree.add(room, -1)
            rows[at].append(n)
            left = room - need
        if left:
            room_of.setdefault(left, []).append(at)
            tree.add(left, 1)
    return rows


SCHEMA = pa.schema([("pack_id", pa.string()), ("ids", pa.binary()), ("n_ids", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())),
                    ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
DDL = "pack_id string, ids binary, n_ids int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, starts array<long>"


def packed(docs: DataFrame, path: str, length: int = LENGTH, window_rows: int = WINDOW_ROWS, id_col: str = "doc_id", text_col: str = "text", dtype: str = "uint16") -> DataFrame:
    """Rows of one packed sequence each:

    * `ids` binary: `length` little-endian ids, padded with the greatest value of the type; `n_ids` of them are real;
    * `cu_seqlens`: 0 and the end of each segment, as variable-length attention wants it;
    * `resets`: where positions start again at 0 (the start of each segment);
    * `doc_ids`, `starts`: whose segment it is, and at which of the document's ids it starts;
    * `pack_id`: a digest of the row's segments, so that it is the same when a task is run again.

    Every id of every document is in exactly one row. A split document's pieces are `length` ids long but the last. Empty and
    null texts have no ids and so no segment; null document ids stay null. A task holds a window of `window_rows` rows of ids
    at a time. Segments of repeated rows are packed as often as the row is there.
    """
    limit = np.iinfo(dtype)
    kind = np.dtype(dtype).newbyteorder("<")

    def rows_of(pieces):
        got = {f.name: [] for f in SCHEMA}
        for row in best_fit([len(p[2]) for p in pieces], length):
            ids, ends = np.full(length, limit.max, kind), [0]
            for k in row:
                ids[ends[-1]:ends[-1] + len(pieces[k][2])] = pieces[k][2]
                ends.append(ends[-1] + len(pieces[k][2]))
            owners, starts = [pieces[k][0] for k in row], [pieces[k][1] for k in row]
            data = ids.tobytes()
            got["ids"].append(data), got["n_ids"].append(ends[-1]), got["cu_seqlens"].append(ends), got["resets"].append(ends[:-1])
            got["doc_ids"].append(owners), got["starts"].append(starts)
            got["pack_id"].append(hashlib.blake2b(data + repr((owners, starts)).encode(), digest_size=12).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in SCHEMA], schema=SCHEMA)

    def run(batches):
        enc = encoding(path)
        if enc.max_token_value >= limit.max:
            raise ValueError(f"{dtype} cannot hold these ids and a padding value")
        pieces, held = [], 0
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), texts(b, "text"), strict=True):
                ids = np.array(encode_text(enc, t), kind)
                for at in range(0, len(ids), length):
                    pieces.append((i, at, ids[at:at + length]))
                held += len(ids)
                while held >= window_rows * length:  # whole windows go; a very long text fills several
                    whole, size = 0, 0
                    while size < window_rows * length and whole < len(pieces):
                        size += len(pieces[whole][2])
                        whole += 1
                    yield rows_of(pieces[:whole])
                    pieces, held = pieces[whole:], held - size
        if pieces:
            yield rows_of(pieces)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, DDL)


def unpacked(rows: DataFrame, dtype: str = "uint16") -> DataFrame:
    """(id, start, ids binary): the segments of packed rows, for reading back."""
    width = np.dtype(dtype).itemsize
    return rows.select("ids", F.posexplode("doc_ids").alias("k", "id"), "starts", "cu_seqlens").select(
        "id", F.expr("starts[k]").alias("start"), F.expr(f"substring(ids, cu_seqlens[k] * {width} + 1, (cu_seqlens[k + 1] - cu_seqlens[k]) * {width})").alias("ids"))


def write_packed(rows: DataFrame, folder: str) -> None:
    """The packed rows as Parquet files under the folder (any store Spark can write to)."""
    rows.write.mode("errorifexists").parquet(folder)
