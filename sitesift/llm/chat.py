"""Chat transcripts: a hidden Markov model over lines recovers who speaks, then turns are rendered in one form.

States are a role and whether a line starts its turn or continues it. What is seen of a line is one code: the kind of speaker
marker it begins with, its length class, whether it asks, whether the line before is blank. Transitions and emissions are
counted in Spark over labelled turns. Viterbi is exact and split into blocks of a conversation: a block's best scores from each
state to each state are a max-plus matrix, the matrices of a conversation give each block its states at both ends, and
each block is then decoded by itself. So a conversation of any length is spread over tasks. As the code of a block's first line
rests on the last line of the block before, a block has a matrix for either case, and the one that holds is chosen where the
matrices meet. Blocks are cut by the place of a piece among all pieces, so equal or unknown turn numbers make no block longer.
"""

import math
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..operators.serve import positions
from .common import out, texts, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROLES = ("system", "user", "assistant")
#: speaker words of each role, as transcripts use them
SPEAKERS = {"system": "system|instructions?|context|developer", "user": "user|human|customer|question|prompt|you|q", "assistant": "assistant|ai|bot|agent|model|answer|response|gpt|a"}
_MARK = re.compile(r"^\s*(?:[#>*\[<|_({-]+\s*)*(?:" + "|".join(f"(?P<{r}>{w})" for r, w in SPEAKERS.items()) + r")\s*(?:\d+\s*)?(?:[:\]>|*_)}-]+\s*)+|^\s*#{1,6}\s*(?:" + "|".join(f"(?P<{r}2>{w})" for r, w in SPEAKERS.items()) + r")\s*$", re.I)
_NAME = re.compile(r"^\s*[A-Z]\w{0,19}:\s")
BLOCK, CODES, STATES = 256, 5 * 3 * 2 * 2, 2 * len(ROLES)  # pieces a block; state: 2 * role + (0 start, 1 continue)


def marker(line: str) -> tuple[int, int]:
    """Kind (0 none, 1 to 3 a role, 4 another name) and where the line's own text begins."""
    m = _MARK.match(line)
    if m:
        return 1 + next(k for k, r in enumerate(ROLES) if m.group(r) or m.group(r + "2")), m.end()
    return (4, 0) if _NAME.match(line) else (0, 0)


def codes(lines: list[str], before_blank: bool = False) -> list[int]:
    got, blank = [], before_blank
    for line in lines:
        n = len(line)
        got.append(((marker(line)[0] * 3 + (n >= 80) + (n >= 400)) * 2 + line.rstrip().endswith("?")) * 2 + blank)
        blank = not line.strip()
    return got


def learned(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> dict:
    """Log probabilities from labelled turns, one added to each count: first role, role after role, lines a turn, codes a state.

    Counts cover all rows with a known role; what reaches the driver are tables of fixed size (roles, states, codes).
    """
    rows = turns.where(F.col(role_col).isin(*ROLES)).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    schema = pa.schema([("state", pa.int32()), ("code", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros((STATES, CODES), np.int64)
        for b in batches:
            for role, text in zip(b.column("role").to_pylist(), texts(b, "text"), strict=True):
                for k, c in enumerate(codes(text.split("\n"))):
                    total[2 * ROLES.index(role) + (k > 0), c] += 1
        s, c = np.nonzero(total)
        yield out(schema, state=pa.array(s.astype(np.int32)), code=pa.array(c.astype(np.int32)), n=pa.array(total[s, c]))

    emit = np.ones((STATES, CODES))
    for r in rows.select("role", "text").mapInArrow(run, "state int, code int, n long").groupBy("state", "code").agg(F.sum("n").alias("n")).collect():
        emit[r["state"], r["code"]] += r["n"]
    order = rows.select("conv", "turn", "role")
    later = order.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("following"))
    follow, first = np.ones((3, 3)), np.ones(3)
    for r in order.join(later, ["conv", "turn"]).groupBy("role", "following").count().collect():
        follow[ROLES.index(r["role"]), ROLES.index(r["following"])] += r["count"]
    for r in order.groupBy("conv").agg(F.min_by("role", "turn").alias("role")).groupBy("role").count().collect():
        first[ROLES.index(r["role"])] += r["count"]
    follow /= follow.sum(1, keepdims=True)
    move = np.zeros((STATES, STATES))
    for r in range(3):
        starts, more = emit[2 * r].sum(), emit[2 * r + 1].sum()
        stay = more / (starts + more)
        for s in (2 * r, 2 * r + 1):
            move[s, 2 * r + 1] = stay
            for q in range(3):
                move[s, 2 * q] = (1 - stay) * follow[r, q]
    start = np.full(STATES, -math.inf)
    start[::2] = np.log(first / first.sum())
    with np.errstate(divide="ignore"):  # a turn of one role cannot go on as another's: minus infinity
        return {"start": start, "move": np.log(move), "emit": np.log(emit / emit.sum(1, keepdims=True))}


def block_matrix(seen: list[int], model: dict) -> np.ndarray:
    """Best score from the state before the block (row; the last row: the conversation begins here) to that of its last line."""
    m = np.vstack([model["move"], model["start"]]) + model["emit"][:, seen[0]]
    for c in seen[1:]:
        m = (m[:, :, None] + model["move"][None]).max(1) + model["emit"][:, c]
    return m


def block_path(seen: list[int], model: dict, entry: int | None, end: int) -> list[int]:
    """The best states of a block's lines between its given ends; entry None: the conversation begins here."""
    v = (model["start"] if entry is None else model["move"][entry]) + model["emit"][:, seen[0]]
    back = []
    for c in seen[1:]:
        step = v[:, None] + model["move"]
        back.append(step.argmax(0))
        v = step.max(0) + model["emit"][:, c]
    path = [end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _pieces(rows: DataFrame, conv_col: str, turn_col: str, text_col: str) -> DataFrame:
    """Pieces with their place among all (conversation, turn, text; nulls last) and the block of that place."""
    base = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = positions(base, [F.col("conv").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("text")], "at")
    return written(placed.select("conv", F.floor((F.col("at") - 1) / BLOCK).alias("block"), "at", "text"), "pieces")


def _groups(batches, fields):
    """Consecutive rows of one (conv, block), as lists."""
    key, held = None, []
    for b in batches:
        for row in zip(*(b.column(f).to_pylist() for f in ("conv", "block", *fields)), strict=True):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row[2:])
    if held:
        yield key, held


def recovered(rows: DataFrame, model: dict, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv_id, part, place, role, starts, n_lines, text, rendered): the turns of each transcript, in order of part and place.

    Input rows are consecutive pieces of a transcript, in order of `turn_col` (ties by text, nulls last); their ends are no hint.
    A null or empty piece is one empty line; rows without a conversation id form one transcript. `part` is a block of at most BLOCK pieces. A turn that goes on from one block into the next has a row in each, the later ones with
    `starts` false; the `rendered` texts of a conversation, joined as they are, give the canonical transcript
    `<|role|>`, the text without its marker, `<|end|>`, each on lines of its own.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    pieces = _pieces(rows, conv_col, turn_col, text_col)
    ordered = lambda df: df.repartition("conv", "block").sortWithinPartitions("conv", "block", "at")
    matrix = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("m", pa.list_(pa.float64())), ("ends_blank", pa.bool_())])

    def measure(batches):
        found = {f.name: [] for f in matrix}
        for (conv, block), held in _groups(batches, ("text",)):
            lines = [line for (t,) in held for line in t.split("\n")]
            both = [block_matrix(codes(lines, blank), shared.value).ravel().tolist() for blank in (False, True)]
            found["conv"].append(conv), found["block"].append(block), found["m"].append(both[0] + both[1]), found["ends_blank"].append(not lines[-1].strip())
            if len(found["conv"]) >= 1000:
                yield out(matrix, **found)
                found = {f.name: [] for f in matrix}
        yield out(matrix, **found)

    blocks = written(ordered(pieces).mapInArrow(measure, "conv long, block long, m array<double>, ends_blank boolean"), "chat")
    ends = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("last", pa.int32()), ("final", pa.bool_()), ("after_blank", pa.bool_())])

    def settled(conv, held):
        """State before each block of one conversation (STATES: it begins here), state of the block's last line."""
        v, kept, blank = None, [], False
        for block, m, ends_blank in held:
            m = np.array(m).reshape(2, STATES + 1, STATES)[int(blank)]
            kept.append((block, m, v, blank))
            blank = ends_blank
            v = m[STATES] if v is None else (v[:, None] + m[:STATES]).max(0)
        last, rows = int(v.argmax()), []
        for block, m, before, after_blank in reversed(kept):
            entry = STATES if before is None else int((before + m[:STATES, last]).argmax())
            rows.append((conv, block, entry, last, not rows, after_blank))
            last = entry
        return rows

    def settle(batches):
        key, held, got = None, [], []
        for b in batches:
            for conv, block, m, ends_blank in zip(*(b.column(c).to_pylist() for c in matrix.names), strict=True):
                if (conv,) != key:
                    got += settled(key[0], held) if held else []
                    key, held = (conv,), []
                held.append((block, m, ends_blank))
            if got:
                yield table(got)
                got = []
        if held:
            yield table(settled(key[0], held))

    def table(got):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*got, strict=True), ends, strict=True)], schema=ends)

    states = (blocks.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(settle, "conv long, block long, entry int, last int, final boolean, after_blank boolean")
              .select(F.col("conv").alias("c"), F.col("block").alias("b"), "entry", "last", "final", "after_blank"))
    final = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("place", pa.int32()), ("role", pa.string()), ("starts", pa.bool_()), ("n_lines", pa.int32()), ("text", pa.string()), ("rendered", pa.string())])

    def render(batches):
        for (conv, block), held in _groups(batches, ("text", "entry", "last", "final", "after_blank")):
            lines = [line for row in held for line in row[0].split("\n")]
            _, entry, last, closes, after_blank = held[0]
            path = block_path(codes(lines, after_blank), shared.value, None if entry == STATES else entry, last)
            starts = [0] + [k for k in range(1, len(path)) if path[k] % 2 == 0]
            got = {f.name: [] for f in final}
            for place, (k, to) in enumerate(zip(starts, [*starts[1:], len(path)], strict=True)):
                opens, role, own = path[k] % 2 == 0, ROLES[path[k] // 2], lines[k:to]
                if opens:
                    own[0] = own[0][marker(own[0])[1]:]
                text = "\n".join(own)
                # a turn is closed where the next one opens, or with the conversation
                head = ("<|end|>\n" if place or entry != STATES else "") + f"<|{role}|>\n" if opens else ""
                foot = "<|end|>\n" if closes and to == len(path) else ""
                for name, value in zip(got, (conv, block, place, role, opens, to - k, text, f"{head}{text}\n{foot}"), strict=True):
                    got[name].append(value)
            yield out(final, **got)

    joined = pieces.join(states, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    return ordered(joined).mapInArrow(render, "conv_id long, part long, place int, role string, starts boolean, n_lines int, text string, rendered string")


#: how a transcript may mark its speakers; fixed values for the transcripts made from labelled turns
STYLES = ({"system": "System: ", "user": "User: ", "assistant": "Assistant: "}, {"system": "### Instructions:\n", "user": "### Human:\n", "assistant": "### Assistant:\n"},
          {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}, {"system": "[context] ", "user": "Q: ", "assistant": "A: "})


def transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bare: int = 8) -> DataFrame:
    """Labelled turns as pieces of raw transcripts (conv_id, turn, role, text): each conversation has one style of markers,
    and one turn in `bare` has none. Turns without a known role have none either."""
    style = F.pmod(F.xxhash64(conv_col), F.lit(len(STYLES)))
    plain = F.pmod(F.xxhash64(conv_col, turn_col), F.lit(bare)) == 0
    mark = F.lit("")
    for k, words in enumerate(STYLES):
        for role, word in words.items():
            mark = F.when((style == k) & (F.col(role_col) == role) & ~plain, word).otherwise(mark)
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.concat(mark, F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
