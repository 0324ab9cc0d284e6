"""Edit distance of long sequences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from seqspark.functions.sequence import as_column

#: Pairs with more letters times letters than this are compared in Arrow batches.
LONG = 1 << 15


def by_columns(a: str, b: str) -> int:
    """The distance by columns of bits: one step for each letter of ``b``, over numbers with a bit for each letter of ``a`` (Myers, in Hyyro's form).

    The bits say where a column of distances grows and falls by one from letter to letter; the shorter text gives the steps.
    """
    a, b = (b, a) if len(a) < len(b) else (a, b)
    n = len(a)
    if not n or not b:
        return max(n, len(b))
    turned, kinds, full = a[::-1], set(a), (1 << n) - 1
    places = {c: int(turned.translate({ord(x): "1" if x == c else "0" for x in kinds}), 2) for c in kinds}
    up, down = full, 0
    for c in b:
        same = places.get(c, 0)
        level = (((same & up) + up) ^ up) | same
        grows = ((down | (full ^ ((level | up) & full))) << 1) | 1
        falls = (up & level) << 1
        either = same | down
        up, down = (falls | ~(either | grows)) & full, grows & either
    return len(b) + up.bit_count() - (down & full).bit_count()


def worthwhile_edits(n: int, m: int) -> int:
    """Edits up to which diagonals take some quarter of the time of columns; fixed values: microseconds, measured."""
    columns = m * (1.6 + 0.0006 * n)
    return int(((1e4 + 0.025 * columns) ** 0.5 - 100) / 0.05)


def _measured() -> Callable[[str, str], int]:
    """The distance of two texts: along diagonals while there are few edits for the lengths, else by columns."""
    near = _along_diagonals()

    def distance(a: str, b: str) -> int:
        if a == b:
            return 0
        found = near(a, b, worthwhile_edits(len(a), len(b)))
        return by_columns(a, b) if found is None else found

    return distance


def _along_diagonals() -> Callable[[str, str, int], int | None]:
    """The distance of two texts in time of their length and the square of the distance; None if it is over ``most``.

    For 0, 1, .. edits, each diagonal's furthest place that so many edits reach; equal letters behind it cost nothing and are passed
    eight bytes at a time, on all diagonals at once.  The first number of edits that reaches both ends is the distance.
    """

    def places(text: str, ascii_: bool, end: int) -> np.ndarray:
        raw = np.frombuffer(text.encode("ascii" if ascii_ else "utf-32-le"), np.uint8 if ascii_ else "<u4")
        # behind the end stands no letter, and another one in each text
        padded = np.concatenate([raw, np.full(9, np.iinfo(raw.dtype).max - end, raw.dtype)])
        return np.ndarray(len(raw) + 1, "<u8", padded, 0, (raw.itemsize,))

    def distance(a: str, b: str, most: int) -> int | None:
        n, m, ascii_ = len(a), len(b), a.isascii() and b.isascii()
        left, right = places(a, ascii_, 0), places(b, ascii_, 1)
        each, shift = (8, 3) if ascii_ else (2, 5)

        def passed(at: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
            open_ = np.flatnonzero((at < n) & (at + diagonal < m))
            while len(open_):
                differ = left[at[open_]] ^ right[at[open_] + diagonal[open_]]
                same = np.where(differ == 0, each, np.bitwise_count((differ & -differ) - np.uint64(1)) >> shift)
                at[open_] += same
                open_ = open_[same == each]
                open_ = open_[(at[open_] < n) & (at[open_] + diagonal[open_] < m)]
            return at

        diagonal = np.zeros(1, np.int64)
        at = passed(np.zeros(1, np.int64), diagonal)
        edits, goal, none = 0, m - n, np.iinfo(np.int64).min // 2
        while not (diagonal[0] <= goal <= diagonal[-1] and at[goal - diagonal[0]] >= n):
            if edits == most:
                return None
            edits += 1
            lo, hi = max(diagonal[0] - 1, -n), min(diagonal[-1] + 1, m)
            wide = np.full(hi - lo + 3, none)
            wide[diagonal[0] - lo + 1 : diagonal[-1] - lo + 2] = at
            diagonal = np.arange(lo, hi + 1)
            # another letter, one more of b, one more of a
            at = np.maximum(np.maximum(wide[1:-1] + 1, wide[:-2]), wide[2:] + 1)
            at = passed(np.minimum(at, np.minimum(n, m - diagonal)), diagonal)
        return edits

    return distance


def edit_distance(a: Column | str, b: Column | str, long: int = LONG) -> Column:
    """Levenshtein distance; null if one is null.

    Short pairs use Spark's own function, whose time is the product of both lengths; long ones go through Arrow batches: those of few edits in time of their length and the
    square of the distance, the others in a step for each letter, of some thousand letters in a microsecond.
    """
    a, b = as_column(a), as_column(b)
    distance = _measured()

    @F.pandas_udf("int")
    def far(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else distance(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    is_long = F.length(a).cast("long") * F.length(b) > long
    only = lambda c: F.when(is_long, c)
    return F.when(is_long, far(only(a), only(b))).otherwise(F.levenshtein(a, b))
