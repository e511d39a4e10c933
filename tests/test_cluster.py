import random

import pytest
from pyspark.sql import functions as F

from warpwise.operators.cluster import cluster_counts, leader_clusters, two_pass_clusters
from warpwise.sources.segments import cut_segments

import naive


def make_series(count, low, high, seed, digits=2):
    rnd = random.Random(seed)
    return {f"s{i}": [round(rnd.random(), digits) for _ in range(rnd.randint(low, high))] for i in range(count)}


def segments(spark, series, longest, stride=1024):
    frame = spark.createDataFrame(list(series.items()), "series_id string, values array<double>")
    return cut_segments(frame, longest, stride)


def rows(frame):
    out = frame.select("length", "cluster_id", "series_id", "start", "is_rep", "rep_dist").collect()
    return sorted(tuple(r) for r in out)


SMALL = {"first_prefix": 20, "group_items": 20}
ROUNDS = {"first_prefix": 30, "group_items": 4}
BLOCKS = {"first_prefix": 20, "group_items": 20, "broadcast_cells": 0, "block_cells": 500}
BLOCK_ROUNDS = {"first_prefix": 60, "group_items": 2, "broadcast_cells": 0, "block_cells": 400}


@pytest.mark.parametrize("sizes,st", [({}, 0.6), (SMALL, 0.15), (ROUNDS, 0.15), (ROUNDS, 0.6), (BLOCKS, 0.15), (BLOCK_ROUNDS, 0.3)])
def test_leader_equals_loop(spark, sizes, st):
    series = make_series(6, 8, 30, seed=3)
    got = leader_clusters(segments(spark, series, 5), 3, 5, st, seed=7, **sizes)
    assert rows(got) == naive.leader(series, 3, 5, st, 7)


@pytest.mark.parametrize(
    "metric,p,sizes", [("ma", 2.0, SMALL), ("mi", 2.0, {}), ("mi", 3.0, SMALL), ("mi", 3.0, BLOCKS), ("dtw", 2.0, {}), ("dtw", 2.0, SMALL), ("dtw", 2.0, BLOCKS),
     ("ma", 2.0, ROUNDS), ("mi", 3.0, ROUNDS), ("dtw", 2.0, ROUNDS)]
)
def test_metrics_equal_loop(spark, metric, p, sizes):
    series = make_series(4, 8, 20, seed=5, digits=1)
    got = rows(leader_clusters(segments(spark, series, 4), 3, 4, 0.8, 1, metric, p, **sizes))
    want = naive.leader(series, 3, 4, 0.8, 1, metric, p)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-12)


@pytest.mark.parametrize("sizes,st", [({}, 0.5), (SMALL, 0.2), (ROUNDS, 0.2), (BLOCKS, 0.2)])
def test_two_pass_equals_loop(spark, sizes, st):
    series = make_series(6, 8, 30, seed=11)
    got = two_pass_clusters(segments(spark, series, 4), 3, 4, st, seed=2, **sizes)
    assert rows(got) == naive.two_pass(series, 3, 4, st, 2)


def test_ties_and_copies(spark):
    """One value pattern fills most of the data; the hot copies must not matter."""
    series = {f"c{i}": [0.5] * 12 for i in range(10)} | {"x": [0.0, 0.25, 0.5, 0.75, 1.0] * 3}
    for sizes in ({}, ROUNDS):
        got = rows(leader_clusters(segments(spark, series, 3), 2, 3, 0.5, 9, **sizes))
        assert got == naive.leader(series, 2, 3, 0.5, 9)


def test_long_series_across_segments(spark):
    series = make_series(2, 60, 70, seed=1)
    got = leader_clusters(segments(spark, series, 6, stride=8), 5, 6, 0.4, 3)
    assert rows(got) == naive.leader(series, 5, 6, 0.4, 3)
    two = two_pass_clusters(segments(spark, series, 6, stride=8), 5, 6, 0.4, 3)
    assert rows(two) == naive.two_pass(series, 5, 6, 0.4, 3)


def test_counts_and_errors(spark):
    series = make_series(3, 8, 12, seed=4)
    got = leader_clusters(segments(spark, series, 3), 2, 3, 0.3, 0)
    want = [r for r in naive.leader(series, 2, 3, 0.3, 0) if r[4]]
    counts = {r["length"]: r["clusters"] for r in cluster_counts(got).collect()}
    assert counts == {2: sum(r[0] == 2 for r in want), 3: sum(r[0] == 3 for r in want), None: len(want)}
    assert leader_clusters(segments(spark, series, 50), 40, 41, 0.3).count() == 0
    assert two_pass_clusters(segments(spark, series, 50), 40, 41, 0.3).count() == 0
    with pytest.raises(ValueError):
        leader_clusters(segments(spark, series, 3), 2, 3, 0.3, metric="xx")
    with pytest.raises(ValueError):
        leader_clusters(segments(spark, series, 3), 0, 3, 0.3)


@pytest.mark.parametrize("sizes", [{}, SMALL, BLOCKS])
def test_warping_over_many_lengths(spark, sizes):
    series = make_series(4, 8, 16, seed=6)
    got = rows(leader_clusters(segments(spark, series, 6), 1, 6, 0.3, 2, "dtw", **sizes))
    want = naive.leader(series, 1, 6, 0.3, 2, "dtw")
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=1e-12)


@pytest.mark.parametrize("metric", ["dtw", "eu", "ma", "mi"])
def test_windows_meet_the_blocks_in_reach_only(spark, metric):
    """The grid keeps every pair within the radius and leaves out most others."""
    from warpwise.operators import cluster, scoring

    series = make_series(30, 40, 40, seed=9)
    rule = cluster._Rule(0.08, metric, 3.0)
    source = cluster._Windows(segments(spark, series, 4), 3, 4, 1, False)
    flat = [(n, v) for n, name, start, v in naive.windows(series, 3, 4)]
    patterns = cluster._flat(source.rows()).where("length = 3 or start % 2 = 0")
    placed, blocks = scoring._in_blocks(patterns, cluster._routing(rule), 1500)
    assert placed.count() == patterns.count() and len(blocks) >= 16
    routed = cluster._routing(rule).route(source.rows(), blocks)
    meetings = routed.select("_block", F.explode("items").alias("i"), "length", "series_id").select("_block", "length", "series_id", "i.start")
    together = {(r["_block"], r["length"], r["series_id"], r["start"]) for r in meetings.collect()}
    assert len(together) < 0.5 * len(flat) * len(blocks)
    held = [(r["_block"], r["length"], list(r["values"])) for r in placed.collect()][::7]
    windows = list(naive.windows(series, 3, 4))[::5]
    for n, name, start, v in windows:
        for block, m, p in held:
            if (m == n or (metric == "dtw" and m < n)) and naive.distance(v, p, metric, 3.0) <= rule.radius(n):
                assert (block, n, name, start) in together


@pytest.mark.parametrize("alike", [True, False])
def test_rounds_write_one_row_a_window(spark, monkeypatch, alike):
    """No round writes more rows than it has windows, though nearly all of them are near each other."""
    from warpwise.operators import cluster

    series = {f"s{i}": [0.5] * 40 for i in range(10)} if alike else make_series(10, 40, 40, seed=21)
    written = []

    def counted(frame, name, *args):
        stored = materialise(frame, name, *args)
        written.append((name, stored.count()))
        return stored

    materialise = cluster.materialise
    monkeypatch.setattr(cluster, "materialise", counted)
    st = 0.1 if alike else 0.9
    got = leader_clusters(segments(spark, series, 3), 3, 3, st, 5, first_prefix=10_000, group_items=0)
    windows = list(naive.windows(series, 3, 3))
    rounds = [n for name, n in written if name.startswith("round-")]
    assert rounds and max(rounds) <= len(windows) == 370
    radius = cluster._Rule(st, "eu", 2.0).radius(3)
    near = sum(naive.distance(u[3], v[3], "euclid", 2.0) <= radius for k, u in enumerate(windows) for v in windows[:k])
    assert near > 20 * len(windows)
    assert sum(name == "round-reps" for name, _ in written) == (1 if alike else sum(name == "round-open" for name, _ in written))
    assert rows(got) == naive.leader(series, 3, 3, st, 5)


@pytest.mark.parametrize("metric,st", [("dtw", 0.25), ("eu", 0.6)])
def test_last_stretch_is_not_hashed(spark, monkeypatch, metric, st):
    """All windows are hashed for their assignment only; the stretches before hash window by window what they list."""
    from warpwise.operators import cluster

    hashed, work_rows = [], cluster.work_rows
    monkeypatch.setattr(cluster, "work_rows", lambda *args: (hashed.append(args[1:3]), work_rows(*args))[1])
    series = make_series(12, 40, 40, seed=31) | {"gap": [0.1, 0.9, float("nan")] * 6}
    got = rows(leader_clusters(segments(spark, series, 4), 3, 4, st, 4, metric, first_prefix=80))
    assert hashed == [(3, 4)]
    want = naive.leader({k: v for k, v in series.items() if k != "gap"}, 3, 4, st, 4, metric)

    def placed(found):
        return sorted((r[0], *r[2:5], round(r[5], 9)) for r in found)

    kept = [r for r in got if r[2] != "gap"]
    assert placed(kept) == placed(want)
    assert len(got) == len(kept) + 15 + 14 and all(r[4] for r in got if r[2] == "gap")
