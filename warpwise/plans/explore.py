"""Whole jobs: from a table of points to clusters, and from queries to matches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cluster import leader_clusters
from ..operators.normalize import normalise
from ..operators.search import (
    check_query_range,
    in_length_range,
    nearest_members,
    nearest_representatives,
    ranks_needed,
    top_k,
    top_k_without_overlap,
)
from ..operators.windows import windows
from ..runtime import materialise


def group_and_cluster(
    segments: DataFrame, shortest: int, longest: int, st: float = 0.1, seed: int = 0, **options
) -> tuple[DataFrame, DataFrame]:
    """Scale, group and cluster in one call: ``(windows, clusters)``."""
    scaled = materialise(normalise(segments), "scaled")
    grouped = windows(scaled, shortest, longest, options.get("include_last", False))
    return grouped, leader_clusters(scaled, shortest, longest, st, seed, **options)


def similarity_search(
    queries: DataFrame,
    clusters: DataFrame,
    segments: DataFrame,
    low: int,
    high: int,
    k: int,
    exclude_overlap: bool = False,
    percentage: float = 1.0,
    exclude_own: bool = True,
    drop_same_id_reps: bool = False,
) -> DataFrame:
    """The k best matches per query and length: ``(query_id, length, rank, cluster_id, series_id, start, end, dist)``.

    Only the cluster of the nearest representative is ranked. Lengths outside what was grouped
    raise; a length whose cluster is empty after the exclusions gives no rows.
    """
    check_query_range(clusters, low, high)
    queries = materialise(queries.select("query_id", "source_series_id", "q"), "queries")
    near = materialise(
        nearest_representatives(queries, clusters, segments, low, high, drop_same_id_reps), "nearest"
    )
    ranks = ranks_needed(k, percentage, high) if exclude_overlap else k
    within = in_length_range(clusters, low, high)
    scored = nearest_members(queries, within, near, segments, ranks, exclude_own)
    best = top_k_without_overlap(scored, k, percentage, high) if exclude_overlap else top_k(scored, k)
    return best.select("query_id", "length", "rank", "cluster_id", "series_id", "start", "end", "dist")
