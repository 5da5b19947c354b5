"""Numpy kernels over the words of one text: where they are, a 64-bit hash of each, and hashes of runs of words.

A word's hash is a polynomial over its bytes modulo 2^64, mixed; a run's hash is a polynomial over the hashes of its
words, mixed. Both come from prefix sums, so any run costs two look-ups. Equal words and runs have equal hashes;
different ones collide with a chance of about 2^-64 a pair.
"""

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U = np.uint64
BASE, STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # any odd numbers do
CHUNK = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = (9, 10, 11, 12, 13, 32)


def byte_class(members) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(members)] = True
    return mask


NOT_SPACE = ~byte_class(SPACES)
#: ASCII letters and digits and every byte of a non-ASCII character
WORD_BYTES = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int, store={}) -> np.ndarray:  # noqa: B006  the default is the cache
    have = store.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, U)
        have[0] = 1
        have = store[base] = np.multiply.accumulate(have)
    return have[:n]


def _runs(values: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """Polynomial of values[first:last] for each pair, whatever its place."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * _powers(base, len(values)), out=total[1:])
    return (total[last] - total[first]) * _powers(pow(base, -1, 1 << 64), len(values) + 1)[first]


def word_spans(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes."""
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = is_word[np.frombuffer(data, np.uint8)]
    turn = np.diff(edge)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; long texts in pieces, so memory follows the words, not eight times the bytes."""
    got, at = np.empty(len(starts), U), 0
    raw = np.frombuffer(data, np.uint8)
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK)))
        s, e = starts[at:to] - low, ends[at:to] - low
        got[at:to] = _runs(raw[low:low + int(e[-1])].astype(U) + U(1), s, e, BASE)
        at = to
    return mixed(got)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    if len(words) < n:
        return np.empty(0, U)
    first = np.arange(len(words) - n + 1)
    return mixed(_runs(words, first, first + n, STEP))


def span_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of words[first:last] for each pair."""
    return mixed(_runs(words, first, last, STEP) ^ (last - first).astype(U))
