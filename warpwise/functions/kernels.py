"""Small numpy helpers that run inside Spark tasks, on blocks Spark has bounded.

Sums run left to right, as a fold over the array does, so a distance here and the same
distance written as SQL agree to the last bit. The matrix product is only a filter: whatever
it leaves undecided is computed exactly.
"""

from __future__ import annotations

import numpy as np

# Tiles of distances small enough to stay in the processor's cache.
ITEM_TILE = 512
TILE_CELLS = 4_000_000
PATTERN_TILE = 1024
WARP_ITEM_TILE, WARP_PATTERN_TILE = 2048, 256  # the same of warping, whose patterns are few
PAIR_CHUNK = 4096
BOUND_CELLS = 2_000_000  # cells of window pairs laid out at a time for their bounds
SLACK = 1e-9


def offsets_and_values(column) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and flat values of an Arrow list column."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def tile_rows(length: int, most: int = ITEM_TILE) -> int:
    """Windows of one length laid out at a time."""
    return max(16, min(most, TILE_CELLS // length))


def owner_rows(column) -> np.ndarray:
    """For each item of an Arrow list column, the row it belongs to."""
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def key_words(keys) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit words, in byte order, of an Arrow array of 16-byte keys."""
    data = keys.buffers()[2]
    if not len(keys):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    first = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset]
    words = np.frombuffer(data, ">u8", 2 * len(keys), offset=int(first)).reshape(-1, 2)
    return words[:, 0].astype(np.uint64), words[:, 1].astype(np.uint64)


def fold(terms: np.ndarray) -> np.ndarray:
    return np.cumsum(terms, axis=1)[:, -1]


# --- dynamic time warping -------------------------------------------------------------------


def point_cost(a, b, cost: str):
    d = a - b
    return np.abs(d) if cost == "abs" else d * d


def finish(total, cost: str):
    return total if cost == "abs" else np.sqrt(total)


def dtw_pairs(a: np.ndarray, b: np.ndarray, cost: str = "abs") -> np.ndarray:
    """Exact DTW of row pairs; ``b`` may be one row for all of ``a``."""
    out = np.empty(len(a))
    for at in range(0, len(a), PAIR_CHUNK):
        left = np.ascontiguousarray(a[at : at + PAIR_CHUNK].T)
        right = b.T if len(b) == 1 else np.ascontiguousarray(b[at : at + PAIR_CHUNK].T)
        n = len(right)
        row = np.full((n + 1, left.shape[1]), np.inf)
        row[0] = 0.0
        for x in left:
            step = point_cost(x[None, :], right, cost)
            best = np.minimum(row[:-1], row[1:])
            row = np.empty_like(row)
            row[0] = np.inf
            for j in range(n):
                np.add(step[j], np.minimum(best[j], row[j]), out=row[j + 1])
        out[at : at + PAIR_CHUNK] = row[-1]
    return finish(out, cost)


def dtw_lower(a: np.ndarray, b: np.ndarray, cost: str = "abs") -> np.ndarray:
    """The larger of the end-cell bound and the range bound, both ways; never above DTW."""

    def outside(x, y):
        low, high = y.min(axis=1, keepdims=True), y.max(axis=1, keepdims=True)
        excess = np.maximum(np.maximum(x - high, low - x), 0.0)
        return (excess if cost == "abs" else excess * excess).sum(axis=1)

    bound = np.maximum(outside(a, b), outside(b, a))
    if max(a.shape[1], b.shape[1]) > 1:
        ends = point_cost(a[:, 0], b[:, 0], cost) + point_cost(a[:, -1], b[:, -1], cost)
        bound = np.maximum(bound, ends)
    return finish(bound, cost)


def dtw_upper(a: np.ndarray, b: np.ndarray, cost: str = "abs") -> np.ndarray:
    """Cost of the straight warping path; never below DTW."""
    m, n = a.shape[1], b.shape[1]
    steps = np.arange(max(m, n))
    along = point_cost(a[:, steps * m // len(steps)], b[:, steps * n // len(steps)], cost)
    return finish(along.sum(axis=1), cost)


def _columns(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points of rows, place by place, and each row's lowest and highest one."""
    points = np.ascontiguousarray(x.T)
    return points, points.min(axis=0), points.max(axis=0)


def _inner_excess(x, i, other, j) -> np.ndarray:
    """What the inner points of rows ``i`` of ``x`` lie outside the ranges of rows ``j`` of ``other``, both as ``_columns`` gives them."""
    low, high = other[1][j], other[2][j]
    total = np.zeros(len(i))
    for points in x[0][1:-1]:
        point = points[i]
        total += np.maximum(np.maximum(point - high, low - point), 0.0)
    return total


def warp_candidates(a: np.ndarray, b: np.ndarray, limit: np.ndarray, allowed=None):
    """Pairs of rows whose DTW (absolute cost) may be within ``limit``, a number for each row of ``a``: ``(rows of a, rows of b, lower bounds)``.

    Every path pays for both ends, and for each inner point at least its way outside the other's range.
    The pairs come by rising row of ``a``.
    """
    reach = limit * (1 + SLACK) + 1e-12
    ends = np.abs(a[:, 0, None] - b[None, :, 0])
    if max(a.shape[1], b.shape[1]) > 1:
        ends += np.abs(a[:, -1, None] - b[None, :, -1])
    near = ends <= reach[:, None]
    if allowed is not None:
        near &= allowed
    i, j = np.nonzero(near)
    bound = ends[i, j]
    left, right = _columns(a), _columns(b)
    step = max(1, BOUND_CELLS // max(a.shape[1], b.shape[1]))
    for at in range(0, len(i), step):
        some, other = i[at : at + step], j[at : at + step]
        bound[at : at + step] += np.maximum(_inner_excess(left, some, right, other), _inner_excess(right, other, left, some))
    keep = bound <= reach[i]
    return i[keep], j[keep], bound[keep]


def warp_rounds(a: np.ndarray, b: np.ndarray, limit: np.ndarray, allowed=None):
    """DTW of the pairs of rows that may be within ``limit``, by rounds: yields ``(rows of a, rows of b, distances)``.

    A round warps the pairs with the smallest bounds of each row of ``a``: one, then two, four and so on. The caller lowers
    ``limit`` in place between the rounds, and pairs whose bound lies above it by then are never warped.
    """
    i, j, bound = warp_candidates(a, b, limit, allowed)
    take = 1
    while len(i):
        if take == 1:
            start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            least = np.repeat(np.minimum.reduceat(bound, start), np.diff(np.append(start, len(i))))
            now = np.flatnonzero(bound == least)
            now = now[np.append(True, i[now[1:]] != i[now[:-1]])]
        else:
            if take == 2:
                rank = np.lexsort((bound, i))
                i, j, bound = i[rank], j[rank], bound[rank]
            start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
            now = np.flatnonzero(place < take)
        yield i[now], j[now], dtw_pairs(a[i[now]], b[j[now]])
        keep = bound <= limit[i] * (1 + SLACK) + 1e-12
        keep[now] = False
        i, j, bound = i[keep], j[keep], bound[keep]
        take *= 2


def best_of_groups(a, q, group, tie, cost="abs"):
    """Per group the row of ``a`` nearest to ``q`` by DTW: ``(row, distance)`` arrays.

    ``group`` holds 0..G-1 and ``tie`` decides among equal distances. Rows are taken by rising
    lower bound; one whose bound lies above its group's best is never warped.
    """
    q = q[None, :]
    low = dtw_lower(a, q, cost)
    limit = np.full(group.max() + 1, np.inf)
    np.minimum.at(limit, group, dtw_upper(a, q, cost))
    order = np.argsort(low, kind="stable")
    rows, dists = [], []
    for at in range(0, len(order), PAIR_CHUNK):
        part = order[at : at + PAIR_CHUNK]
        part = part[low[part] <= limit[group[part]] * (1 + SLACK) + 1e-12]
        if len(part):
            d = dtw_pairs(a[part], q, cost)
            np.minimum.at(limit, group[part], d)
            rows.append(part)
            dists.append(d)
    row, dist = np.concatenate(rows), np.concatenate(dists)
    rank = np.lexsort((tie[row], dist, group[row]))
    row, dist = row[rank], dist[rank]
    first = np.unique(group[row], return_index=True)[1]
    return row[first], dist[first]


def k_nearest(a, q, k: int, tie, cost="abs"):
    """The ``k`` rows of ``a`` nearest to ``q`` by DTW: ``(rows, distances)``, nearest first."""
    q = q[None, :]
    low, high = dtw_lower(a, q, cost), dtw_upper(a, q, cost)
    limit = np.partition(high, k - 1)[k - 1] if len(a) > k else np.inf
    order = np.argsort(low, kind="stable")
    rows, dists = np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(order), PAIR_CHUNK // 4):
        part = order[at : at + PAIR_CHUNK // 4]
        part = part[low[part] <= limit * (1 + SLACK) + 1e-12]
        if not len(part):
            break
        rows, dists = np.concatenate([rows, part]), np.concatenate([dists, dtw_pairs(a[part], q, cost)])
        rank = np.lexsort((tie[rows], dists))[:k]
        rows, dists = rows[rank], dists[rank]
        if len(rows) == k:
            limit = min(limit, dists[-1])
    return rows, dists


# --- equal-length distances ------------------------------------------------------------------


def pair_distance(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """Exact distance of row pairs."""
    if metric == "dtw":
        return dtw_pairs(a, b)
    if metric == "euclid":
        return np.sqrt(fold((a - b) * (a - b)))
    if metric == "manhattan":
        return fold(np.abs(a - b))
    return np.power(fold(np.power(np.abs(a - b), p)), 1.0 / p)


def mean_reach(radius: float, length: int, metric: str, p: float) -> float:
    """Windows within ``radius`` of each other have means within this of each other."""
    power = {"euclid": 0.5, "manhattan": 1.0, "minkowski": 1.0 / p}.get(metric)
    return np.inf if power is None else radius / length**power * (1 + SLACK) + 1e-12


def rough_matrix(a, b, radius, metric, p):
    """Distances of all rows of two tiles to a known error: ``(matrix, error, limit)``.

    The matrix is monotone in the distance; ``limit`` is the radius on its scale.
    """
    if metric == "euclid":
        na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        # |a|^2 + |b|^2 - 2ab as one product
        left = np.column_stack([-2.0 * a, na, np.ones(len(a))])
        rough = left @ np.column_stack([b, np.ones(len(b)), nb]).T
        return rough, SLACK * (na.max() + nb.max()) + 1e-15, radius * radius
    if metric == "dtw":
        rough = np.full((len(a), len(b)), np.inf)
        some, other, _ = warp_candidates(a, b, np.full(len(a), radius))
        rough[some, other] = dtw_pairs(a[some], b[other])
        return rough, 0.0, radius
    rough = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = np.abs(a[:, j, None] - b[None, :, j])
        rough += d if metric == "manhattan" else np.power(d, p)
    limit = radius if metric == "manhattan" else radius**p
    return rough, SLACK * limit + 1e-15, limit


def covered(a, b, radius, metric, p) -> np.ndarray:
    """For each row of ``a``: does some row of ``b`` lie within ``radius``?"""
    found = np.zeros(len(a), dtype=bool)
    for at in range(0, len(b), PATTERN_TILE):
        tile = b[at : at + PATTERN_TILE]
        if metric == "dtw":
            left = np.flatnonzero(~found)
            limit = np.full(len(left), radius)
            for i, _, d in warp_rounds(a[left], tile, limit):
                limit[i[d <= radius]] = -np.inf
            found[left[limit < 0]] = True
            continue
        rough, error, limit = rough_matrix(a, tile, radius, metric, p)
        found |= (rough <= limit - error).any(axis=1)
        unsure = np.nonzero(~found)[0]
        i, j = np.nonzero(rough[unsure] <= limit + error)
        if len(i):
            i = unsure[i]
            hit = pair_distance(a[i], tile[j], metric, p) <= radius
            found[i[hit]] = True
    return found


def leaders(x: np.ndarray, radius: float, metric: str, p: float, block: int = 256) -> np.ndarray:
    """Rows that become representatives when ``x`` is processed in its order."""
    chosen = np.empty(0, dtype=np.int64)
    for at in range(0, len(x), block):
        rows = np.arange(at, min(at + block, len(x)))
        if len(chosen):
            rows = rows[~covered(x[rows], x[chosen], radius, metric, p)]
        fresh = []
        while len(rows):
            head, rows = rows[0], rows[1:]
            fresh.append(head)
            if len(rows):
                rows = rows[pair_distance(x[rows], np.repeat(x[head][None, :], len(rows), 0), metric, p) > radius]
        chosen = np.concatenate([chosen, np.array(fresh, dtype=np.int64)])
    return chosen


def nearest(a, b, radius, allowed, keys, metric, p):
    """Nearest allowed row of ``b`` within ``radius`` for each row of ``a`` (all, if ``allowed`` is None).

    ``radius`` may be an array, a number for each row of ``a``. Returns ``(rows of a, rows of b, distances)`` for the rows that
    have one; equal distances go to the smallest ``keys`` (a list of arrays over ``b``, most significant first).
    """
    if metric == "dtw":
        limit, found = np.full(len(a), radius), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for i, j, d in warp_rounds(a, b, limit, allowed):
            near = d <= limit[i]
            found.append((i[near], j[near], d[near]))
            np.minimum.at(limit, i[near], d[near])
        i, j, d = (np.concatenate(c) for c in zip(*found))
        keep = d <= limit[i]
    else:
        rough, error, limit = rough_matrix(a, b, radius, metric, p)
        if allowed is not None:
            np.putmask(rough, ~allowed, np.inf)
        best = np.minimum(rough.min(axis=1) + 2 * error, limit + error)
        i, j = np.nonzero(rough <= best[:, None])
        d = pair_distance(a[i], b[j], metric, p)
        keep = d <= radius
    i, j, d = i[keep], j[keep], d[keep]
    rank = np.lexsort([k[j] for k in reversed(keys)] + [d, i])
    i, j, d = i[rank], j[rank], d[rank]
    first = np.unique(i, return_index=True)[1]
    return i[first], j[first], d[first]
