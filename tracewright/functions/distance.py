"""Exact edit distance of long texts, pair by pair within Arrow tasks. No table of all prefixes is filled: see distance()."""

from __future__ import annotations

from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Characters compared at once along a diagonal, at first and at most; bytes of character masks kept of one pair.
LEAST, MOST, MASKS = 8, 4096, 1 << 26


def distance(a: str, b: str) -> int:
    """Edit distance in code points.

    Equal ends are cut off. Counts of characters bound the distance from below, replacing place by place from above; where they meet, or
    where the shorter text is the longer one with characters left out, nothing is searched. Else diagonals are followed as far as they
    reach with each number of edits, which takes time with the distance; and texts too far apart for that go through by_bits().
    """
    x, y = _codes(a), _codes(b)
    least = min(len(x), len(y))
    head = _agreeing(x[:least], y[:least])
    tail = _agreeing(x[head:][::-1][: least - head], y[head:][::-1][: least - head])
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(x) < len(y):
        x, y, a, b = y, x, b, a
    if not len(y):
        return len(x)
    low = _surplus(x, y)
    if low == len(x) - len(y) + int(np.count_nonzero(x[: len(y)] != y)):
        return low
    if low == len(x) - len(y):
        rest = iter(a[head : len(a) - tail])
        if all(c in rest for c in b[head : len(b) - tail]):
            return low
    found = by_diagonals(x, y, max(64, isqrt(len(x) * len(y)) // 40))
    return by_bits(x, y) if found is None else found


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common prefix of two arrays of one length."""
    differ = x != y
    return int(differ.argmax()) if differ.any() else len(x)


def _surplus(x: np.ndarray, y: np.ndarray) -> int:
    """Characters, with their numbers, that x has more of than y; x is not the shorter one."""
    n = int(max(x.max(), y.max())) + 1
    more = np.bincount(x, minlength=n) - np.bincount(y, minlength=n)
    return int(more[more > 0].sum())


def by_diagonals(x: np.ndarray, y: np.ndarray, most: int) -> int | None:
    """The distance, if it is at most `most`: how far into x each diagonal gets, edit by edit."""
    n, m = len(x), len(y)
    # past their ends the texts differ, so that nothing runs over
    ends = (np.concatenate([x, np.full(MOST + 1, 0xFFFFFFFE, np.uint32)]), np.concatenate([y, np.full(MOST + 1, 0xFFFFFFFF, np.uint32)]))
    reach, mid = np.full(2 * most + 3, -(1 << 40), np.int64), most + 1
    reach[mid] = _followed(*ends, np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for edits in range(1, most + 1):
        low, high = mid - min(edits, n), mid + min(edits, m) + 1
        k = np.arange(low, high) - mid
        at = np.maximum(np.maximum(reach[low:high], reach[low + 1 : high + 1]) + 1, reach[low - 1 : high - 1])
        at = _followed(*ends, np.minimum(at, np.minimum(n, m - k)), k)
        reach[low:high] = at
        if abs(m - n) <= edits and reach[mid + m - n] >= n:
            return edits
    return None


def _followed(x: np.ndarray, y: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places in x after the equal characters that begin at `at`, on diagonals k."""
    live, width = np.arange(len(at)), LEAST
    while len(live):
        window = at[live][:, None] + np.arange(width)
        differ = x[window] != y[window + k[live][:, None]]
        stops = differ.any(axis=1)
        at[live] += np.where(stops, differ.argmax(axis=1), width)
        live, width = live[~stops], min(4 * width, MOST)
    return at


def by_bits(x: np.ndarray, y: np.ndarray) -> int:
    """The distance by Myers' bit vectors: a column of the table at a time, its steps kept as the bits of two integers."""
    n = len(x)
    full = (1 << n) - 1

    @lru_cache(maxsize=max(16, 8 * MASKS // n))
    def places(c: int) -> int:
        return int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little")

    up, down, score = full, 0, n
    for c in y.tolist():
        eq = places(c)
        level = eq | down
        across = (((eq & up) + up) ^ up | eq) & full
        more, less = down | (full ^ (across | up)), up & across
        score += (more >> (n - 1)) - (less >> (n - 1))
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | (full ^ (level | more)), more & level
    return score


@F.arrow_udf(IntegerType())
def long_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """distance() of each pair; null where either is null."""
    return pa.array((None if x is None or y is None else distance(x, y) for x, y in ((s.as_py(), t.as_py()) for s, t in zip(a, b))), pa.int32())
