"""SimHash near-duplicates: fingerprints, a segment-popcount embedding with a grid range-join, exact verification.

The 64 bits form 32 segments of two bits. A segment's bit count is 0, 1 or 2; the Manhattan distance of two count
vectors never exceeds the Hamming distance of the fingerprints. Of two fingerprints within `distance` 4, one half (16
segments) has counts within a Manhattan distance of 2, so both lie one step or none from a common grid point. Each distinct
fingerprint goes to those points (25 a half on average); fingerprints that meet are verified by Hamming distance. Within a
point only a spanning forest of the verified links leaves the task, never all pairs of a group.
"""

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import out, utf8, written
from ..operators.graph import components
from ..session import spread
from .words import LOWER

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, DISTANCE, SEED, BLOCK = 4, 4, 42, 4096
PART = 1 << 18
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The bits set in over half of the hashes of all word shingles; a text without words gives 0."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    size = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, digest, n = np.zeros(64, np.int64), xxhash.xxh64_intdigest, len(words) - size + 1
    for low in range(0, n, PART):
        high = min(n, low + PART)
        pairs = zip(starts[low:high].tolist(), ends[low + size - 1:high + size - 1].tolist(), strict=True)
        h = np.array([digest(line[s:e], SEED) for s, e in pairs], np.uint64).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            total[8 * j:8 * j + 8] += np.bincount(h[:, j], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. One row per row; null text has the fingerprint zero."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in utf8(b, "text")], np.uint64).view(np.int64)
            yield out(schema, id=b.column("id"), fp=pa.array(fp))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _points(half: int):
    """Grid points at most one step from the counts of one half, packed two bits a segment."""
    bits = f"(shiftrightunsigned(fp, {32 * half}) & 4294967295L)"
    key = f"(({bits} & 1431655765L) + (shiftrightunsigned({bits}, 1) & 1431655765L))"
    step = lambda test, sign: f"transform(filter(sequence(0, 15), i -> (shiftright({key}, 2 * i) & 3L) {test}), i -> {key} {sign} shiftleft(1L, 2 * i))"
    return F.expr(f"concat(array({key}), {step('< 2', '+')}, {step('> 0', '-')})")


def _near(one: np.ndarray, many: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(one ^ many) <= distance


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links within the distance do, one fewer than the nodes of a tree."""
    left, edges = np.unique(fps), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = _near(at, left, distance)
            if hit.any():
                found, left = left[hit], left[~hit]
                edges += [(int(at), int(x)) for x in found]
                todo += list(found)
    return edges


def _cross(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks: all rows are compared, and each member of one is linked to one
    partner in each tree it touches, which makes them one tree. Fewer links than the blocks have members."""
    edges, tree = [], np.arange(len(b))
    for x in a:
        hit = np.flatnonzero(_near(x, b, distance))
        if len(hit):
            found, first = np.unique(tree[hit], return_index=True)
            edges += [(int(x), int(y)) for y in b[hit[first]]]
            if len(found) > 1:
                tree[np.isin(tree, found)] = found[0]
    return edges


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) whose components are those of all links within `distance` (at most 5).

    Rows of a grid point arrive sorted and are taken in blocks of at most `block`: a task's memory is one block. A point
    with more sends its blocks on, each as one row; pairs of blocks are then compared in tasks of their own, so a crowded
    point is spread and still compared in full.
    """
    if not 0 <= distance <= 5:
        raise ValueError("two halves and one step to a common point hold for distances up to 5")
    # a fingerprint is eight bytes and gives fifty rows: parts are set by the cores, not by the few bytes (by a hash, since
    # rows that are dealt by fp already would stay as they are)
    met = (spread(fps.select("fp", F.xxhash64("fp").alias("_deal")), "_deal").select("fp", F.explode(F.array(*[F.struct(F.lit(h).alias("half"), _points(h).alias("points")) for h in (0, 1)])).alias("s"))
           .select("fp", "s.half", F.explode("s.points").alias("point"))
           .select((F.col("point") * 2 + F.col("half")).alias("cell"), "fp"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64()), ("block", pa.int32()), ("members", pa.binary())])
    ddl = "a long, b long, cell long, block int, members binary"

    def settled(cells, fp):
        """Edges of whole runs: short runs by comparing rows that stand d apart, longer ones by a forest."""
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        sizes = np.diff(np.append(starts, len(cells)))
        found = []
        small = np.repeat(sizes <= 8, sizes)
        for d in range(1, 8):
            i = np.flatnonzero(small[:-d] & small[d:] & (cells[:-d] == cells[d:])) if len(cells) > d else np.empty(0, int)
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
            found.append(np.stack([fp[i], fp[i + d]], 1))
        for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            e = forest(fp[s:s + n], distance)
            if e:
                found.append(np.array(e, np.uint64))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.uint64)

    def rows(edges, cell=None, number=None, members=None):
        if members is not None:
            return out(schema, a=[None], b=[None], cell=[cell], block=[number], members=[members])
        n = len(edges)
        return out(schema, a=pa.array(edges[:, 0].view(np.int64) if n else [], pa.int64()), b=pa.array(edges[:, 1].view(np.int64) if n else [], pa.int64()), cell=pa.nulls(n, pa.int64()), block=pa.nulls(n, pa.int32()), members=pa.nulls(n, pa.binary()))

    def run(batches):
        cells, fp, number, last = np.empty(0, np.int64), np.empty(0, np.uint64), 0, None
        for b in batches:
            cells = np.concatenate((cells, b.column("cell").to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            while len(cells):
                open_at = int(np.searchsorted(cells, cells[-1]))
                if open_at:  # all but the last run are whole
                    head, n = cells[0], int(np.searchsorted(cells, cells[0], "right"))
                    if last == head:
                        yield rows(None, int(head), number, fp[:n].tobytes())
                        yield rows(settled(cells[:n], fp[:n]))
                        cells, fp, last, number = cells[n:], fp[n:], None, 0
                        continue
                    yield rows(settled(cells[:open_at], fp[:open_at]))
                    cells, fp, last, number = cells[open_at:], fp[open_at:], None, 0
                elif len(cells) >= block:
                    yield rows(settled(cells[:block], fp[:block]))
                    yield rows(None, int(cells[0]), number, fp[:block].tobytes())
                    last, number, cells, fp = cells[0], number + 1, cells[block:], fp[block:]
                else:
                    break
        if len(cells):
            if last == cells[0]:
                yield rows(None, int(last), number, fp.tobytes())
            yield rows(settled(cells, fp))

    got = written(met.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, ddl), "links")
    blocks = got.where("members IS NOT NULL").select("cell", "block", "members")
    left, right = blocks.alias("l"), blocks.alias("r")
    pairs = left.join(right, (F.col("l.cell") == F.col("r.cell")) & (F.col("l.block") < F.col("r.block"))).select(F.col("l.members").alias("x"), F.col("r.members").alias("y"))

    def across(batches):
        pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for b in batches:
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                e = np.array(_cross(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), distance), np.uint64).reshape(-1, 2)
                yield out(pair, a=pa.array(e[:, 0].copy().view(np.int64)), b=pa.array(e[:, 1].copy().view(np.int64)))

    return got.where("a IS NOT NULL").select("a", "b").unionByName(pairs.mapInArrow(across, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 lowercase hex digits, and the smallest id reachable over
    links of at most `distance` differing bits.

    Rows without words (null or blank text) have the fingerprint zero and are linked like any other. A null id gets a
    component; a component without any id has a null one. Repeated rows repeat in the result.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fps")
    each = rows.groupBy("fp").agg(F.min("id").alias("least_id"))
    labels = components(links(each.select("fp"), distance, block))
    joined = written(each.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "classes")
    ids = joined.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of = joined.select("fp", "label").join(ids, "label").select("fp", "component_id")
    return rows.join(of, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
