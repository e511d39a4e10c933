"""The stored index against the search through joins, and its two stages."""

import math
import random

import pytest
from pyspark.sql import functions as F

import naive
from test_cluster import make_series, segments
from warpwise.operators import index, search
from warpwise.operators.cluster import leader_clusters
from warpwise.plans.explore import similarity_search

SERIES = make_series(12, 20, 40, seed=21)
SERIES["bad"] = [0.5, math.nan, 0.25, 0.75, 0.1, 0.9, 0.3, 0.2, math.inf, 0.4]
QUERIES = [("qa", "s1", SERIES["s1"][2:7]), ("qb", "s3", SERIES["s3"][4:8]), ("qc", "s1", SERIES["s1"][6:15]), ("qd", "none", [0.5])]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    parts = segments(spark, SERIES, 12)
    clusters = leader_clusters(parts, 1, 7, 0.9, seed=1).cache()
    path = str(tmp_path_factory.mktemp("index") / "i")
    index.write_index(path, clusters, parts)
    queries = spark.createDataFrame(QUERIES, "query_id string, source_series_id string, q array<double>")
    return parts, clusters, index.open_index(spark, path), queries


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("staged_rows", [0, 1 << 40], ids=["staged", "direct"])
@pytest.mark.parametrize("options", [{}, {"exclude_overlap": True, "percentage": 0.5, "drop_same_id_reps": True, "exclude_own": False}])
def test_index_equals_joins(made, staged_rows, options):
    parts, clusters, stored, queries = made
    want = rows(similarity_search(queries, clusters, parts, 1, 7, 4, **options))
    assert want and rows(index.indexed_search(queries, stored, 1, 7, 4, staged_rows=staged_rows, **options)) == want


def test_more_queries_than_are_taken_to_the_driver(made, monkeypatch):
    parts, clusters, stored, queries = made
    want = rows(similarity_search(queries, clusters, parts, 4, 5, 4))
    for name in ("LOCAL_QUERIES", "LOCAL_CLUSTERS"):
        with monkeypatch.context() as patch:
            patch.setattr(index, name, 1)
            assert rows(index.indexed_search(queries, stored, 4, 5, 4)) == want


def test_limits_keep_rows_from_being_warped(made):
    _, _, stored, queries = made
    few = index.local_queries(queries)
    chosen = index._chosen(index.nearest_clusters(queries, stored, 6, 7))
    pairs = index.member_pairs(few, stored, chosen)
    left = index.within_limits(pairs, index.limits(pairs, few, 3))
    assert left.count() < 0.8 * pairs.count()
    every = search.top_k(index.nearest_members(queries, stored, index.nearest_clusters(queries, stored, 6, 7), 3), 3)
    kept = {tuple(r) for r in left.select("query_id", "length", "series_id", "start").collect()}
    assert {tuple(r) for r in every.select("query_id", "length", "series_id", "start").collect()} <= kept


def test_pairs_are_not_sorted_for_their_limits(made):
    """All pairs with their values were sorted by bound in their tasks before; now their bounds are only aggregated."""
    _, _, stored, queries = made
    few = index.local_queries(queries)
    chosen = index._chosen(index.nearest_clusters(queries, stored, 6, 7))
    pairs = index.member_pairs(few, stored, chosen)
    plan = index.limits(pairs, few, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "bound#" in plan
    assert not [line for line in plan.splitlines() if ("Window" in line or "Sort" in line) and "bound#" in line]
    found = index.limits(pairs, few, 3).collect()
    kth = search.top_k(index.nearest_members(queries, stored, index.nearest_clusters(queries, stored, 6, 7), 3), 3).where("rank = 3")
    exact = {(r["query_id"], r["length"]): r["dist"] for r in kth.collect()}
    assert found and all(r["limit"] >= exact[r["query_id"], r["length"]] for r in found)


def test_bound_is_below_the_distance(spark):
    rnd = random.Random(5)
    values = [[round(rnd.uniform(-1, 1), rnd.choice([1, 3])) for _ in range(rnd.randint(1, 14))] for _ in range(120)]
    a = index.with_bounds(spark.createDataFrame([(v, len(v)) for v in values], "values array<double>, length int"))
    b = spark.createDataFrame([(v,) for v in values[:40]], "q array<double>").withColumn("q_size", F.size("q"))
    pairs = a.join(index.with_bounds(b, "q", "q_"), F.lit(True)).select("values", "q", index.lower_bound().alias("bound")).collect()
    ratio = []
    for r in pairs:
        true = naive.dtw(r["values"], r["q"])
        assert r["bound"] <= true + 1e-9
        ratio.append(r["bound"] / true if true else 1.0)
    assert sum(ratio) / len(ratio) > 0.4


def test_one_cluster_is_read(made):
    """The filter on members names lengths and clusters, so files and row groups can be left out."""
    _, _, stored, queries = made
    chosen = index._chosen(index.nearest_clusters(queries.where("query_id = 'qa'"), stored, 5, 5))
    named = index._named(stored.members, chosen)
    plan = named._jdf.queryExecution().executedPlan().toString()
    partition, pushed = plan.split("PartitionFilters: ")[1].split("PushedFilters: ")
    assert "length#" in partition and "cluster_no" in pushed
    assert {r["cluster_no"] for r in named.select("cluster_no").distinct().collect()} == {chosen["cluster_no"][0].as_py()}


def test_range_outside_the_index(made):
    _, _, stored, queries = made
    with pytest.raises(ValueError):
        index.indexed_search(queries, stored, 5, 9, 3)


def test_reps_hold_counts_and_envelopes(made):
    _, clusters, stored, _ = made
    values = {(r["length"], r["cluster_id"], r["series_id"], r["start"]): r["values"] for r in stored.members.collect()}
    by_cluster = {}
    for (length, cluster, *_), v in values.items():
        by_cluster.setdefault((length, cluster), []).append(v)
    assert stored.reps.count() == len(by_cluster) == clusters.where("is_rep").count()
    for r in stored.reps.collect():
        inside = [x for v in by_cluster[r["length"], r["cluster_id"]] for x in v]
        assert r["n_members"] == len(by_cluster[r["length"], r["cluster_id"]])
        if all(map(math.isfinite, inside)):
            assert (r["least"], r["most"]) == (min(inside), max(inside)) and r["mean"] == pytest.approx(sum(inside) / len(inside))
