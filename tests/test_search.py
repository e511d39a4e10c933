import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpwise.functions.distance import pair_distance, similarity_radius
from warpwise.functions.warping import dtw, warping_path
from warpwise.operators import exact, reports, search, windows as win
from warpwise.operators.cluster import leader_clusters
from warpwise.plans.explore import group_and_cluster, similarity_search
from warpwise.sources.segments import cut_segments

import naive
from test_cluster import make_series, segments

SERIES = make_series(5, 12, 24, seed=8)
QUERIES = {"qa": ("s1", SERIES["s1"][2:7]), "qb": ("s3", SERIES["s3"][4:8])}


def query_frame(spark):
    rows = [(name, source, q) for name, (source, q) in QUERIES.items()]
    return spark.createDataFrame(rows, "query_id string, source_series_id string, q array<double>")


@pytest.fixture(scope="module")
def made(spark):
    parts = segments(spark, SERIES, 12)
    clusters = leader_clusters(parts, 4, 5, 0.8, seed=1).cache()
    return parts, clusters, naive.leader(SERIES, 4, 5, 0.8, 1)


def loop_search(rows, q, source, length, k, percentage, drop_reps=False):
    reps = [r for r in rows if r[0] == length and r[4] and not (drop_reps and r[2] == source)]
    values = lambda r: SERIES[r[2]][r[3] : r[3] + length]
    best = min(reps, key=lambda r: (naive.dtw(values(r), q), int(r[1].split("_")[1])))
    members = [r for r in rows if r[0] == length and r[1] == best[1] and r[2] != source]
    members.sort(key=lambda r: (naive.dtw(values(r), q), r[2], r[3]))
    kept = []
    for r in members:
        clash = any(o[2] == r[2] and (min(o[3], r[3]) + length - max(o[3], r[3])) / length > percentage for o in kept)
        if len(kept) < k and not clash:
            kept.append(r)
    return best[1], [(r[2], r[3]) for r in kept]


@pytest.mark.parametrize("percentage", [0.5, 0.0, 1.0])
def test_similarity_search_equals_loop(spark, made, percentage):
    parts, clusters, rows = made
    got = similarity_search(query_frame(spark), clusters, parts, 4, 5, 6, True, percentage).orderBy("rank").collect()
    for name, (source, q) in QUERIES.items():
        for length in (4, 5):
            want = loop_search(rows, q, source, length, 6, percentage)[1]
            assert [(r["series_id"], r["start"]) for r in got if r["query_id"] == name and r["length"] == length] == want


@pytest.mark.parametrize("limits", [{}, {"broadcast_cells": 0, "block_cells": 400}], ids=["broadcast", "blocks"])
def test_nearest_representative(spark, made, limits):
    parts, clusters, rows = made
    for drop in (False, True):
        near = search.nearest_representatives(query_frame(spark), clusters, parts, 4, 5, drop, **limits)
        got = {(r["query_id"], r["length"]): r["cluster_id"] for r in near.collect()}
        want = {
            (name, n): loop_search(rows, q, source, n, 1, 1.0, drop)[0] for name, (source, q) in QUERIES.items() for n in (4, 5)
        }
        assert got == want


def test_nearest_members_hold_the_best(spark, made):
    parts, clusters, _ = made
    near = search.nearest_representatives(query_frame(spark), clusters, parts, 4, 5).cache()
    every = search.top_k(search.scored_members(query_frame(spark), clusters, near, parts), 4).orderBy("query_id", "length", "rank")
    for limits in ({}, {"broadcast_cells": 0, "block_cells": 300}):
        some = search.nearest_members(query_frame(spark), clusters, near, parts, 4, **limits)
        assert search.top_k(some, 4).select(*every.columns).orderBy("query_id", "length", "rank").collect() == every.collect()


def test_range_guard(spark, made):
    parts, clusters, _ = made
    with pytest.raises(ValueError):
        similarity_search(query_frame(spark), clusters, parts, 4, 6, 3)


def test_deep_top_k_and_overlap(spark):
    """Ranks beyond the pruned ones, and a cluster that lies in one hot series."""
    rnd = random.Random(2)
    hits = [("q", 10, "hot", s, s + 10, round(rnd.random(), 2)) for s in range(1500)] + [("q", 10, "b", 3, 13, 0.5)]
    frame = spark.createDataFrame(hits, "query_id string, length int, series_id string, start long, end long, dist double").repartition(5)
    ranked = sorted(hits, key=lambda h: (h[5], h[2], h[3]))
    got = search.top_k(frame, 1200).orderBy("rank").collect()
    assert [(r["series_id"], r["start"]) for r in got] == [(h[2], h[3]) for h in ranked[:1200]]
    kept = []
    for h in ranked:
        if len(kept) < 150 and not any(o[2] == h[2] and (10 - abs(o[3] - h[3])) / 10 > 0.4 for o in kept):
            kept.append(h)
    got = search.top_k_without_overlap(frame, 150, 0.4).orderBy("rank").collect()
    assert [(r["series_id"], r["start"]) for r in got] == [(h[2], h[3]) for h in kept]


@pytest.mark.parametrize("cost", ["abs", "sq"])
@pytest.mark.parametrize("limits", [{}, {"broadcast_cells": 0, "block_cells": 300}], ids=["broadcast", "blocks"])
def test_exact_search(spark, cost, limits):
    parts = segments(spark, SERIES, 6, stride=7)
    best = {r["query_id"]: r for r in exact.best_match(query_frame(spark), parts, cost, **limits).collect()}
    each = exact.best_per_series(query_frame(spark), parts, cost, **limits).collect()
    for name, (_, q) in QUERIES.items():
        m = len(q)
        options = [
            (naive.dtw(v[i : i + m], q, cost), s, i) for s, v in SERIES.items() for i in range(len(v) - m + 1)
        ]
        d, s, i = min(options)
        row = best[name]
        assert (row["series_id"], row["start"], row["distance"]) == (s, i, d)
        assert list(row["value"]) == SERIES[s][i : i + m]
        path = [(c["i"], c["j"]) for c in row["path"]]
        assert path[0] == (0, 0) and path[-1] == (m - 1, m - 1)
        want = {s: min((d, i) for d, t, i in options if t == s) for s in SERIES}
        assert {r["series_id"]: (r["dist"], r["start"]) for r in each if r["query_id"] == name} == want


def test_warping_columns(spark):
    rows = [([1.0, 2.0, 3.0], [1.0, 3.0]), ([0.0], [2.0, 5.0]), ([1.0, 1.0], [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "a array<double>, b array<double>")
    for cost in ("abs", "sq"):
        got = [r[0] for r in frame.select(dtw(F.col("a"), F.col("b"), cost)).collect()]
        assert got == [naive.dtw(a, b, cost) for a, b in rows]
    paths = [[tuple(c) for c in r[0]] for r in frame.select(warping_path(F.col("a"), F.col("b"))).collect()]
    assert paths[1:] == [[(0, 0), (0, 1)], [(0, 0), (1, 1)]]


def test_distance_columns(spark):
    a, b = [0.1, 0.5, 0.9], [0.3, 0.2, 0.4]
    frame = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    for metric, p in (("eu", 2.0), ("ma", 2.0), ("mi", 2.0), ("mi", 3.0), ("dtw", 2.0)):
        column = pair_distance(F.col("a"), F.col("b"), metric, p)
        assert frame.select(column).first()[0] == pytest.approx(naive.distance(a, b, metric, p), abs=1e-12)
        plan = frame.select(column)._jdf.queryExecution().toString()
        assert ("Python" in plan or "ArrowEval" in plan) == (metric == "dtw")
    with pytest.raises(ValueError):
        pair_distance(F.col("a"), F.col("b"), "xx")
    assert frame.select(similarity_radius(F.lit(4), 0.3)).first()[0] == 2.0 * 0.3 / 2


def test_sampled_queries(spark):
    series = {f"s{i}": [float(j) for j in range(40)] for i in range(6)}
    parts = segments(spark, series, 4, stride=16)
    specs = exact.sample_queries(parts, 3, seed=5).collect()
    assert [r["start"] for r in sorted(specs, key=lambda r: r["query_id"])] == [2, 4, 6]
    assert all(r["start"] + 5 <= r["end"] < 20 for r in specs)
    cut = win.cut(parts, exact.sample_queries(parts, 3, seed=5)).collect()
    assert all(list(r["q"]) == [float(j) for j in range(r["start"], r["end"])] for r in cut)


def test_reports_and_job(spark, made):
    parts, clusters, rows = made
    shown = reports.cluster_profile(clusters, parts, 1, 2).collect()
    assert {r["length"] for r in shown} == {4} and {r["member"] for r in shown} <= {1, 2}
    reps = {r[1]: (r[2], r[3]) for r in rows if r[0] == 4 and r[4]}
    for r in shown:
        if r["member"] == 1:
            s, i = reps[r["cluster_id"]]
            assert r["value"] == SERIES[s][i + r["pos"]]
    results = similarity_search(query_frame(spark), clusters, parts, 4, 5, 2)
    curves = reports.result_profile(query_frame(spark), results, parts)
    assert curves.where("rank = 0").count() == sum(len(q) for _, q in QUERIES.values())
    grouped, clustered = group_and_cluster(parts, 4, 5, 0.5, 3)
    assert grouped.count() == clustered.count() == len(list(naive.windows(SERIES, 4, 5)))


def table_path(a, b, cost):
    """The path by the whole table, one cell after the other."""
    inf = float("inf")
    total = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    total[0][0] = 0.0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            step = abs(x - y) if cost == "abs" else (x - y) * (x - y)
            total[i + 1][j + 1] = step + min(total[i][j], total[i][j + 1], total[i + 1][j])
    i, j, path = len(a), len(b), []
    while i and j:
        path.append((i - 1, j - 1))
        back = [total[i - 1][j - 1], total[i - 1][j], total[i][j - 1]]
        move = back.index(min(back))
        i, j = (i - 1, j - 1) if move == 0 else (i - 1, j) if move == 1 else (i, j - 1)
    return path[::-1]


def test_paths_equal_the_whole_table():
    from warpwise.functions.warping import _path

    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([float(rnd.randint(0, 3)) for _ in range(rnd.randint(1, 40))] for _ in range(2))  # many ties
        for cost in ("abs", "sq"):
            assert [(c["i"], c["j"]) for c in _path(np.array(a), np.array(b), cost)] == table_path(a, b, cost)


def test_long_paths_in_little_memory():
    import tracemalloc

    from warpwise.functions.warping import _path

    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(10_000).cumsum(), rng.standard_normal(10_000).cumsum()
    tracemalloc.start()
    path = _path(a, b, "abs")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and path[0] == {"i": 0, "j": 0} and path[-1] == {"i": 9999, "j": 9999}
    steps = {(y["i"] - x["i"], y["j"] - x["j"]) for x, y in zip(path, path[1:])}
    assert steps <= {(0, 1), (1, 0), (1, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_overlap_fold_equals_one_loop(spark, seed):
    """Kept series by series, as one loop over all hits keeps them."""
    rnd = random.Random(seed)
    hits = [
        (q, n, f"s{rnd.choice([0, 0, 0, 1, 2, 3])}", s, s + n, round(rnd.random(), 1), "c")
        for q in ("a", "b") for n in (6, 9) for s in rnd.choices(range(40), k=rnd.randint(1, 60))
    ]
    hits = sorted(set(hits))
    frame = spark.createDataFrame(hits, "query_id string, length int, series_id string, start long, end long, dist double, cluster_id string")
    for k, share in ((1, 0.5), (4, 0.0), (7, 0.34), (50, 0.7)):
        want = []
        for q in ("a", "b"):
            for n in (6, 9):
                kept = []
                for h in sorted((h for h in hits if h[:2] == (q, n)), key=lambda h: (h[5], h[2], h[3])):
                    if len(kept) < k and not any(o[2] == h[2] and (min(o[4], h[4]) - max(o[3], h[3])) / n > share for o in kept):
                        kept.append(h)
                want += [(*h, i + 1) for i, h in enumerate(kept)]
        got = search.top_k_without_overlap(frame, k, share)
        names = ["query_id", "length", "series_id", "start", "end", "dist", "cluster_id", "rank"]
        assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want)
