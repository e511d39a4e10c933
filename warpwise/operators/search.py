"""Best matches of many queries at once, through the clusters.

Windows with a value that is not finite are never near a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import kernels as K
from ..functions.warping import dtw
from ..runtime import materialise, spread
from ..sources.segments import with_values
from .scoring import score
from .windows import fixed_windows

# Spark prunes a ranked window before its shuffle up to this rank (the default threshold).
PRUNED_RANK = 1000

NEAREST = pa.schema(
    [
        ("query_id", pa.string()),
        ("length", pa.int32()),
        ("dist", pa.float64()),
        ("cluster_no", pa.int64()),
        ("cluster_id", pa.string()),
    ]
)


def in_length_range(frame: DataFrame, low: int, high: int) -> DataFrame:
    """Rows whose length lies in [low, high]; on a stored dataset this prunes partitions."""
    return frame.where(F.col("length").between(low, high))


def check_query_range(grouped: DataFrame, low: int, high: int) -> None:
    """Raise unless [low, high] lies inside the lengths that were grouped."""
    have = grouped.agg(F.min("length").alias("low"), F.max("length").alias("high")).first()
    if have["low"] is None or low < have["low"] or high > have["high"]:
        raise ValueError(f"query range {low}..{high} is outside the grouped lengths {have['low']}..{have['high']}")


def exclude_same_id(frame: DataFrame, source: str = "source_series_id") -> DataFrame:
    """Drop rows that belong to the query's own series."""
    return frame.where(~F.col("series_id").eqNullSafe(F.col(source)))


def nearest_kernel(drop_same: bool):
    def prepare(table: pa.Table):
        names = table["query_id"].to_pylist()
        sources = table["source_series_id"].to_pylist()
        at, flat = K.offsets_and_values(table["values"])
        queries = [flat[at[i] : at[i + 1]] for i in range(len(names))]

        def run(batch: pa.RecordBatch) -> pa.Table:
            offsets, values = K.offsets_and_values(batch.column("values"))
            length = batch.column("length").to_numpy()
            number = batch.column("cluster_no").to_numpy()
            owner = np.array(batch.column("series_id").to_pylist(), dtype=object)
            parts = []
            for n in np.unique(length):
                rows = np.nonzero(length == n)[0]
                matrix = values[offsets[rows][:, None] + np.arange(n)]
                finite = np.isfinite(matrix).all(axis=1)
                for name, source, q in zip(names, sources, queries):
                    pick = finite & (owner[rows] != source) if drop_same else finite
                    if not pick.any():
                        continue
                    chosen = rows[pick]
                    group = np.zeros(len(chosen), dtype=np.int64)
                    row, dist = K.best_of_groups(matrix[pick], q, group, number[chosen])
                    best = chosen[row[0]]
                    parts.append((name, n, dist[0], number[best], batch.column("cluster_id")[int(best)].as_py()))
            return pa.Table.from_pylist([dict(zip(NEAREST.names, p)) for p in parts], schema=NEAREST)

        return run

    return prepare


def nearest_representatives(
    queries: DataFrame,
    clusters: DataFrame,
    segments: DataFrame,
    low: int,
    high: int,
    drop_same_id_reps: bool = False,
    **limits: int,
) -> DataFrame:
    """Per query and length the cluster whose representative is nearest by DTW.

    ``(query_id, length, cluster_id, dist)``; equal distances go to the cluster made first.
    """
    reps = in_length_range(clusters, low, high).where("is_rep")
    number = F.element_at(F.split("cluster_id", "_"), -1).cast("long")
    reps = reps.select("series_id", "start", "length", "cluster_id", number.alias("cluster_no"))
    # written first: few representatives then go to the segments, not the segments to them
    rows = with_values(materialise(reps, "reps"), segments)
    patterns = queries.select("query_id", "source_series_id", F.col("q").alias("values"))
    found = score(rows, patterns, nearest_kernel(drop_same_id_reps), NEAREST, **limits)
    best = F.min(F.struct("dist", "cluster_no", "cluster_id"))
    return (
        found.groupBy("query_id", "length")
        .agg(best.alias("b"))
        .select("query_id", "length", "b.cluster_id", "b.dist")
    )


def _members(queries, clusters, nearest, segments, exclude_own) -> DataFrame:
    """Members of the chosen clusters with their values: ``(query_id, length, cluster_id, series_id, start, end, values)``."""
    chosen = nearest.select("query_id", "length", "cluster_id").join(
        queries.select("query_id", "source_series_id"), "query_id"
    )
    members = clusters.select("length", "cluster_id", "series_id", "start", "end").join(chosen, ["length", "cluster_id"])
    if exclude_own:
        members = exclude_same_id(members)
    members = spread(materialise(members.select("query_id", "length", "cluster_id", "series_id", "start", "end"), "members"))
    return with_values(members, segments)


def scored_members(
    queries: DataFrame,
    clusters: DataFrame,
    nearest: DataFrame,
    segments: DataFrame,
    exclude_own: bool = True,
) -> DataFrame:
    """DTW distance of every member of the chosen clusters: ``(query_id, length, cluster_id, series_id, start, end, dist)``."""
    return (
        _members(queries, clusters, nearest, segments, exclude_own)
        .join(queries.select("query_id", "q"), "query_id")
        .select("query_id", "length", "cluster_id", "series_id", "start", "end", dtw(F.col("values"), F.col("q")).alias("dist"))
    )


HIT = pa.schema(
    [
        ("query_id", pa.string()),
        ("length", pa.int32()),
        ("cluster_id", pa.string()),
        ("series_id", pa.string()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("dist", pa.float64()),
    ]
)


def members_kernel(k: int, every_query: bool = False, by_cluster: bool = False):
    """Kernel: the k nearest rows per query and length within a batch.

    Rows name their query in ``query_id``; with ``every_query`` each row is held against all of them. Equal distances
    go by (series_id, start), or by the cluster's number.
    """

    def prepare(table: pa.Table):
        at, flat = K.offsets_and_values(table["values"])
        queries = {name: flat[at[i] : at[i + 1]] for i, name in enumerate(table["query_id"].to_pylist())}

        def run(batch: pa.RecordBatch) -> pa.Table:
            offsets, values = K.offsets_and_values(batch.column("values"))
            length = batch.column("length").to_numpy()
            start = batch.column("start").to_numpy()
            if by_cluster:
                place = np.array([int(c.rsplit("_", 1)[-1]) for c in batch.column("cluster_id").to_pylist()], np.int64)
            else:
                owner = np.unique(np.array(batch.column("series_id").to_pylist(), dtype=object), return_inverse=True)[1]
                place = np.empty(len(start), np.int64)
                place[np.lexsort((start, owner))] = np.arange(len(start))
            finite = np.add.reduceat(~np.isfinite(values), offsets[:-1]) == 0 if len(values) else np.zeros(0, bool)
            if every_query:
                wanted = dict.fromkeys(queries, finite)
            else:
                names = np.array(batch.column("query_id").to_pylist(), dtype=object)
                wanted = {name: finite & (names == name) for name in set(names) & set(queries)}
            parts = []
            for name, mask in wanted.items():
                for n in np.unique(length[mask]):
                    rows = np.nonzero(mask & (length == n))[0]
                    best, dist = K.k_nearest(values[offsets[rows][:, None] + np.arange(n)], queries[name], k, place[rows])
                    hits = batch.select(HIT.names[1:-1]).take(pa.array(rows[best]))
                    parts.append(pa.Table.from_arrays([pa.array([name] * len(best)), *hits.columns, pa.array(dist)], schema=HIT))
            return pa.concat_tables(parts) if parts else HIT.empty_table()

        return run

    return prepare


def nearest_members(
    queries: DataFrame,
    clusters: DataFrame,
    nearest: DataFrame,
    segments: DataFrame,
    k: int,
    exclude_own: bool = True,
    **limits: int,
) -> DataFrame:
    """Scored members of the chosen clusters, at least the k nearest per query and length.

    A member whose lower bound lies above the k-th best of its batch is never warped, and a
    batch hands on k rows at most, so :func:`top_k` after it has little left to rank.
    """
    rows = _members(queries, clusters, nearest, segments, exclude_own)
    patterns = queries.select("query_id", F.col("q").alias("values"))
    return score(rows, patterns, members_kernel(k), HIT, **limits)


def nearest_windows(queries: DataFrame, segments: DataFrame, length: int, k: int, **limits: int) -> DataFrame:
    """Scored windows of one length, at least the k nearest to each query, without clusters.

    Bounded as in :func:`nearest_members`: every batch hands on k rows a query at most.
    """
    coordinates = fixed_windows(segments, length, include_last=False).select(
        F.lit(length).alias("length"),
        F.lit(None).cast("string").alias("cluster_id"),
        "series_id",
        "start",
        (F.col("start") + length).alias("end"),
        "values",
    )
    asked = queries.select("query_id", F.col("q").alias("values"))
    return score(coordinates, asked, members_kernel(k, every_query=True), HIT, **limits)


def ranks_needed(k: int, percentage: float, longest: int) -> int:
    """How many of the nearest windows surely hold the k that :func:`top_k_without_overlap` keeps."""
    return k * max(1, 2 * math.ceil(longest * (1 - percentage)) - 1)


def top_k(scored: DataFrame, k: int, keys: tuple[str, ...] = ("query_id", "length")) -> DataFrame:
    """The k nearest rows per key with their ``rank``; ties go by (series_id, start)."""
    order = ["dist", "series_id", "start"]
    if k > PRUNED_RANK:
        # beyond that rank Spark ranks whole keys, so each partition's share is cut first
        share = W.partitionBy(*keys, "_part").orderBy(*order)
        scored = (
            scored.withColumn("_part", F.spark_partition_id())
            .withColumn("_rank", F.row_number().over(share))
            .where(F.col("_rank") <= k)
            .drop("_part", "_rank")
        )
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def overlap_fraction(kept_start: Column, kept_end: Column, start: Column, end: Column) -> Column:
    """Share of the kept window that the other one covers; negative when they are apart."""
    shared = F.least(kept_end, end) - F.greatest(kept_start, start)
    return shared / (kept_end - kept_start)


def top_k_without_overlap(scored: DataFrame, k: int, percentage: float = 1.0, longest: int | None = None) -> DataFrame:
    """Greedy by distance: a window is dropped if a kept one of its series overlaps it by more
    than ``percentage``; stops at k per query and length.

    Windows of one length conflict only if their starts differ by less than
    ``length * (1 - percentage)``, so a kept window can drop only so many others and the k kept
    ones always lie within a computable rank: only that prefix is looked at, whatever the
    cluster's size. As windows of different series never conflict, it is folded series by series, and the k nearest
    of what the series keep are the result; no array holds all hits of a query. ``longest`` bounds the lengths present (asked for when not given).
    """
    if not 0 <= percentage <= 1:
        raise ValueError("percentage must lie in [0, 1]")
    if percentage == 1:
        return top_k(scored, k)
    if longest is None:
        scored = materialise(scored, "scored")
        longest = scored.agg(F.max("length")).first()[0] or 1
    more = [c for c in scored.columns if c not in ("query_id", "length", "series_id", "start", "end", "dist")]
    keys = ["query_id", "length", "series_id"]
    prefix = top_k(scored, ranks_needed(k, percentage, longest)).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("dist", "start", "end", *more))).alias("hits")
    )

    def keep(kept, hit):
        clash = F.exists(kept, lambda old: overlap_fraction(old["start"], old["end"], hit["start"], hit["end"]) > percentage)
        return F.when((F.size(kept) >= k) | clash, kept).otherwise(F.array_append(kept, hit))

    none = F.slice("hits", 1, 0)
    kept = prefix.select(*keys, F.explode(F.aggregate("hits", none, keep)).alias("hit"))
    return top_k(kept.select(*keys, "hit.start", "hit.end", "hit.dist", *[f"hit.{c}" for c in more]), k)


def query_specs(spark, specs: list[tuple[str, str, int, int]]) -> DataFrame:
    """Parameter rows ``(query_id, series_id, start, end)`` for :func:`warpwise.operators.windows.cut`.

    From an Arrow table, so that Spark knows how small they are when it plans the join.
    """
    columns = list(zip(*specs))
    types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
    arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
    return spark.createDataFrame(pa.table(arrays, names=["query_id", "series_id", "start", "end"]))
