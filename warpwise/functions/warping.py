"""Dynamic time warping as columns.

The Arrow form warps a whole batch of pairs at once; a fold written with higher-order
functions gives the same numbers but is interpreted per cell and copies each row of the
table, which measured far slower (see BENCH.md).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .kernels import dtw_pairs, offsets_and_values, point_cost


def _pairs(a: pa.Array, b: pa.Array, cost: str) -> pa.Array:
    ao, av = offsets_and_values(a)
    bo, bv = offsets_and_values(b)
    shape = np.stack([np.diff(ao), np.diff(bo)], axis=1)
    if (shape == 0).any():
        raise ValueError("dtw of an empty sequence")
    out = np.empty(len(shape))
    kinds, kind = np.unique(shape, axis=0, return_inverse=True)
    for k, (m, n) in enumerate(kinds):
        rows = np.nonzero(kind.ravel() == k)[0]
        left = av[ao[rows][:, None] + np.arange(m)]
        right = bv[bo[rows][:, None] + np.arange(n)]
        out[rows] = dtw_pairs(left, right, cost)
    return pa.array(out)


def dtw(a: Column, b: Column, cost: str = "abs") -> Column:
    """Exact DTW distance of two arrays of any lengths.

    ``cost='abs'`` sums absolute differences; ``cost='sq'`` is the root of summed squares.
    """

    @F.arrow_udf("double")
    def score(x: pa.Array, y: pa.Array) -> pa.Array:
        return _pairs(x, y, cost)

    return score(a, b)


def _diagonal(a: np.ndarray, b: np.ndarray, cost: str, d: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Totals of the cells (i, d - i) at places i + 1, from those of the diagonal before (``one``) and the one before that."""
    low, high = max(0, d - len(b) + 1), min(d, len(a) - 1)
    out = np.full(len(a) + 1, np.inf)
    step = point_cost(a[low : high + 1], b[d - high : d - low + 1][::-1], cost)
    before = 0.0 if d == 0 else np.minimum(np.minimum(two[low : high + 1], one[low : high + 1]), one[low + 1 : high + 2])
    out[low + 1 : high + 2] = step + before
    return out


def _path(a: np.ndarray, b: np.ndarray, cost: str) -> list[dict]:
    """Cells of the best path in linear space.

    The table of totals is walked by anti-diagonals, of which two out of each ``stretch`` are kept. On the way back a stretch
    is computed again from these two, so about the root of the number of diagonals is held at a time.
    """
    diagonals = len(a) + len(b) - 1
    stretch = max(2, int(np.sqrt(diagonals)))
    kept = []
    one = two = np.full(len(a) + 1, np.inf)
    for d in range(diagonals):
        if d % stretch == 0:
            kept.append((one, two))
        one, two = _diagonal(a, b, cost, d, one, two), one
    i, j = len(a) - 1, len(b) - 1
    path = []
    for number in range(len(kept) - 1, -1, -1):
        first = number * stretch
        one, two = kept.pop()
        held = [two, one]  # diagonals from first - 2 on
        for d in range(first, i + j + 1):
            held.append(_diagonal(a, b, cost, d, held[-1], held[-2]))
        while i + j >= first:
            path.append({"i": i, "j": j})
            if i + j == 0:
                return path[::-1]
            two, one = held[i + j - first], held[i + j - first + 1]
            back = (two[i], one[i], one[i + 1])
            move = back.index(min(back))
            i, j = (i - 1, j - 1) if move == 0 else (i - 1, j) if move == 1 else (i, j - 1)
    return path[::-1]


def warping_path(a: Column, b: Column, cost: str = "sq") -> Column:
    """Best path as ``array<struct<i,j>>``; ties go diagonal, then up, then left.

    Meant for the few rows a search returns; memory grows with the lengths to the power of 1.5, not with their product.
    """

    @F.arrow_udf("array<struct<i:int,j:int>>")
    def trace(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = [_path(np.asarray(p), np.asarray(q), cost) for p, q in zip(x.to_pylist(), y.to_pylist())]
        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))
        return pa.array(rows, type=kind)

    return trace(a, b)
