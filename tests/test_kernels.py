"""Properties of the numpy helpers against plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from warpwise.functions import kernels as K

import naive

numbers = st.integers(0, 40).map(lambda x: x / 8)
seq = st.lists(numbers, min_size=1, max_size=7)


@settings(max_examples=150, deadline=None)
@given(seq, seq, st.sampled_from(["abs", "sq"]))
def test_dtw_and_bounds(a, b, cost):
    x, y = np.array([a]), np.array([b])
    d = K.dtw_pairs(x, y, cost)[0]
    assert d == naive.dtw(a, b, cost)
    assert K.dtw_lower(x, y, cost)[0] <= d + 1e-12
    assert K.dtw_upper(x, y, cost)[0] >= d - 1e-12
    assert K.dtw_pairs(x, x, cost)[0] == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["euclid", "manhattan", "minkowski", "dtw"]), st.sampled_from([0.3, 0.8, 1.5]))
def test_cover_nearest_leaders(seed, metric, radius):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 5, (12, 3)) / 4, rng.integers(0, 5, (9, 3)) / 4
    short = {"euclid": "eu", "manhattan": "ma", "minkowski": "mi", "dtw": "dtw"}[metric]
    p = 3.0 if metric == "minkowski" else 2.0
    d = K.pair_distance(np.repeat(a, len(b), 0), np.tile(b, (len(a), 1)), metric, p).reshape(len(a), -1)
    loop = [[naive.distance(list(x), list(y), short, p) for y in b] for x in a]
    assert d == pytest.approx(np.array(loop), abs=1e-12)
    assert (K.covered(a, b, radius, metric, p) == (d <= radius).any(axis=1)).all()
    allowed = rng.random(d.shape) < 0.7
    order = rng.permutation(len(b))
    i, j, dist = K.nearest(a, b, radius, allowed, [order], metric, p)
    want = {}
    for r in range(len(a)):
        options = [(d[r, c], order[c], c) for c in range(len(b)) if allowed[r, c] and d[r, c] <= radius]
        if options:
            want[r] = min(options)[2]
    assert dict(zip(i.tolist(), j.tolist())) == want
    chosen = []
    for r in range(len(a)):
        if all(naive.distance(list(a[r]), list(a[c]), short, p) > radius for c in chosen):
            chosen.append(r)
    assert K.leaders(a, radius, metric, p, block=5).tolist() == chosen
    means = np.abs(a.mean(axis=1)[:, None] - b.mean(axis=1)[None, :])
    assert (means[d <= radius] <= K.mean_reach(radius, 3, metric, p) + 1e-12).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(["abs", "sq"]))
def test_best_of_groups(seed, cost):
    rng = np.random.default_rng(seed)
    a, q = rng.integers(0, 4, (20, 4)) / 2, rng.integers(0, 4, 3) / 2
    group, tie = rng.integers(0, 3, 20), rng.permutation(20)
    group = np.unique(group, return_inverse=True)[1]
    row, dist = K.best_of_groups(a, q, group, tie, cost)
    for g in range(group.max() + 1):
        want = min((naive.dtw(list(a[r]), list(q), cost), tie[r], r) for r in range(20) if group[r] == g)
        assert (dist[g], row[g]) == (pytest.approx(want[0]), want[2])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 25))
def test_k_nearest(seed, k):
    rng = np.random.default_rng(seed)
    a, q, tie = rng.integers(0, 4, (20, 4)) / 2, rng.integers(0, 4, 3) / 2, rng.permutation(20)
    rows, dist = K.k_nearest(a, q, k, tie)
    want = sorted((naive.dtw(list(a[r]), list(q)), tie[r], r) for r in range(20))[:k]
    assert rows.tolist() == [w[2] for w in want] and dist.tolist() == [w[0] for w in want]


def test_few_pairs_in_reach_are_warped(monkeypatch):
    """Looking for the nearest row, or for any near one, warps few of the pairs within the radius."""
    rng = np.random.default_rng(8)
    a, b = rng.exponential(0.1, (300, 7)).round(2), rng.exponential(0.1, (100, 5)).round(2)
    b[10:20] = b[:10]
    radius, order, allowed = 0.5, rng.permutation(100), rng.random((300, 100)) < 0.9
    d = K.dtw_pairs(np.repeat(a, 100, axis=0), np.tile(b, (300, 1))).reshape(300, 100)
    within = (d <= radius).sum()
    warped, dtw_pairs = [], K.dtw_pairs
    monkeypatch.setattr(K, "dtw_pairs", lambda x, y, *cost: (warped.append(len(x)), dtw_pairs(x, y, *cost))[1])
    best = [min(((d[i, j], order[j], j) for j in np.flatnonzero(allowed[i] & (d[i] <= radius))), default=None) for i in range(300)]
    i, j, dist = K.nearest(a, b, radius, allowed, [order], "dtw", 2.0)
    assert i.tolist() == [k for k in range(300) if best[k]]
    assert j.tolist() == [best[k][2] for k in i] and dist.tolist() == [best[k][0] for k in i]
    assert sum(warped) < 0.4 * within
    warped.clear()
    assert (K.covered(a, b, radius, "dtw", 2.0) == (d <= radius).any(axis=1)).all()
    assert sum(warped) < 0.1 * within


def test_rounds_leave_no_pair_out():
    """Bounds of warping lie below it, so pairs at the very radius, equal ones and single points are all found."""
    rng = np.random.default_rng(3)
    for m, n in [(1, 1), (1, 4), (2, 1), (2, 3), (3, 3), (6, 4)]:
        a, b = rng.integers(0, 4, (60, m)) / 4, rng.integers(0, 4, (40, n)) / 4
        d = K.dtw_pairs(np.repeat(a, 40, axis=0), np.tile(b, (60, 1))).reshape(60, 40)
        for radius in (0.0, 0.25, 0.75):
            found = np.full(d.shape, np.inf)
            for i, j, dist in K.warp_rounds(a, b, np.full(60, radius)):
                found[i, j] = dist
            assert (found[d <= radius] == d[d <= radius]).all()
