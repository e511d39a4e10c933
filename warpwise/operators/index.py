"""A stored index for searches through clusters.

The index of a clustering is three tables:

* ``reps``: one row per cluster, partitioned by length: the representative's coordinates and values, its bounds, the number of
  members, and their mean, least and greatest values;
* ``members``: one row per clustered window, partitioned by length and sorted by cluster, with values and bounds;
* ``lengths``: clusters and members per length.

Bounds are a window's first and last END_POINTS points and its smallest and largest one. They bound the warping distance of a
window and a query from below in plain columns (:func:`lower_bound`).

A search reads the representatives of the asked lengths, then the members of the chosen clusters: by partition, and by the
statistics of files and row groups on ``cluster_no``. It joins nothing back to the series.

Ranking members (or representatives) takes two stages where there are many. The first ranks rows by the lower bound alone and warps
a few with the lowest ones, which gives a limit per query and length that the k-th best cannot exceed. The second drops the rows
whose lower bound lies above the limit before any Python sees them. Results do not depend on the stages.

Values are stored once per window, so an index takes windows x length numbers: it is made for the range of lengths that is
searched often. Windows with a value that is not finite are never near a query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import kernels as K
from ..runtime import materialise, spread
from ..sources.segments import with_values
from . import scoring
from .search import HIT, NEAREST, exclude_same_id, members_kernel, nearest_kernel, ranks_needed, top_k, top_k_without_overlap

END_POINTS = 3  # points of either end that bounds look at
STAGED_ROWS = 2_000_000  # rows times queries from which a limit is worth a stage of its own
PROBES = 4  # rows warped for the limit, times k
SLOTS = 8  # slots for each of these rows
LOCAL_QUERIES = 1_000  # queries that are taken to the driver, at most
LOCAL_CLUSTERS = 10_000  # chosen clusters that are named in the filter on members, at most


def with_bounds(frame: DataFrame, values: str = "values", prefix: str = "") -> DataFrame:
    """``frame`` with the bounds of an array column: points of both ends, null beyond a shorter array, and the extremes."""
    v = F.col(values)
    made = {f"{prefix}head_{i}": F.get(v, F.lit(i)) for i in range(END_POINTS)}
    made |= {f"{prefix}tail_{i}": F.get(v, F.size(v) - 1 - i) for i in range(END_POINTS)}
    return frame.withColumns(made | {f"{prefix}low": F.array_min(v), f"{prefix}high": F.array_max(v)})


def _finite(prefix: str = "") -> Column:
    """Whether a row with bounds has finite values only (a NaN is above infinity)."""
    return (F.col(f"{prefix}low") > F.lit(-math.inf)) & (F.col(f"{prefix}high") < F.lit(math.inf))


def lower_bound(row: str = "", query: str = "q_") -> Column:
    """A number that the warping distance (absolute differences) of a row and a query never goes below, in plain columns.

    Near the start, a path goes through a cell with max(i, j) = k for each k, so it pays at least the cheapest of these; likewise
    from the end backwards. As many points of both ends count as leave these cells apart. Or: the extremes cost at least the
    differences of the maxima and of the minima; both are paid if the ranges overlap, as then no single cell pays for both.
    """
    def apart(name: str, other: str = "") -> str:
        return f"abs({row}{name} - {query}{other or name})"

    longer = f"greatest(length, {query}size)"
    parts = [f"if({longer} = 1, {apart('head_0')}, 0.0D)"]
    for k in range(END_POINTS):
        for side in ("head", "tail"):
            cells = [apart(f"{side}_{k}", f"{side}_{j}") for j in range(k + 1)] + [apart(f"{side}_{i}", f"{side}_{k}") for i in range(k)]
            cheapest = f"least({', '.join(cells)})" if len(cells) > 1 else cells[0]  # leaves out points that are not there
            parts.append(f"if({longer} >= {2 * (k + 1)}, coalesce({cheapest}, 0.0D), 0.0D)")
    low, high = apart("low"), apart("high")
    span = f"if({row}low <= {query}high and {query}low <= {row}high, {low} + {high}, greatest({low}, {high}))"
    return F.expr(f"greatest({' + '.join(parts)}, {span})")


@dataclass
class Index:
    """The tables of a stored index, and (clusters, members) of each length."""

    reps: DataFrame
    members: DataFrame
    lengths: dict[int, tuple[int, int]]

    def check(self, low: int, high: int) -> None:
        """Raise unless [low, high] lies inside the lengths of the index."""
        if not self.lengths or low < min(self.lengths) or high > max(self.lengths):
            raise ValueError(f"query range {low}..{high} is outside the grouped lengths {sorted(self.lengths)[:1]}..{sorted(self.lengths)[-1:]}")


def write_index(path: str, clusters: DataFrame, segments: DataFrame) -> None:
    """Write the index of ``clusters`` (rows of a clustering) with values from ``segments``."""
    spark = clusters.sparkSession
    number = F.element_at(F.split("cluster_id", "_"), -1).cast("long")
    rows = clusters.select("length", "cluster_id", number.alias("cluster_no"), "series_id", "start", "end", "is_rep")
    valued = with_bounds(with_values(rows, segments))
    # the last keys cut a cluster that holds much of the data
    order = ["length", "cluster_no", "series_id", "start"]
    valued.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("length").parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    envelope = [F.min("low").alias("least"), F.max("high").alias("most")]
    counted = members.groupBy("length", "cluster_no").agg(
        F.count(F.lit(1)).alias("n_members"), (F.sum(mean) / F.sum(F.size("values"))).alias("mean"), *envelope
    )
    reps = members.where("is_rep").drop("is_rep").join(counted, ["length", "cluster_no"])
    reps.hint("rebalance", "length").sortWithinPartitions("length", "cluster_no").write.partitionBy("length").parquet(f"{path}/reps")
    sizes = spark.read.parquet(f"{path}/reps").groupBy("length").agg(F.count(F.lit(1)).alias("n_reps"), F.sum("n_members").alias("n_members"))
    sizes.coalesce(1).write.parquet(f"{path}/lengths")


def open_index(spark: SparkSession, path: str) -> Index:
    sizes = {r["length"]: (r["n_reps"], r["n_members"]) for r in spark.read.parquet(f"{path}/lengths").collect()}
    return Index(spark.read.parquet(f"{path}/reps"), spark.read.parquet(f"{path}/members"), sizes)


def local_queries(queries: DataFrame) -> pa.Table | None:
    """The queries (query_id, source_series_id, values), if there are few and short enough to be sent to all tasks."""
    chosen = queries.select("query_id", "source_series_id", F.col("q").cast("array<double>").alias("values"))
    some = chosen.limit(LOCAL_QUERIES + 1).toArrow()
    fit = len(some) <= LOCAL_QUERIES and sum(map(len, some["values"].to_pylist())) <= scoring.BROADCAST_CELLS
    return some if fit else None


def _asked(spark: SparkSession, queries: pa.Table) -> DataFrame:
    """Queries without their values: ids, size and bounds."""
    frame = with_bounds(spark.createDataFrame(queries), "values", "q_").withColumn("q_size", F.size("values"))
    return frame.drop("values")


def paired(rows: DataFrame, asked: DataFrame, by: list[str], drop_same: bool) -> DataFrame:
    """Each row with the queries that ask for its ``by`` columns, and the lower bound of their distance; rows that are not finite are left out."""
    joined = rows.where(_finite()).join(F.broadcast(asked.where(_finite("q_"))), by)
    joined = exclude_same_id(joined) if drop_same else joined
    return joined.withColumn("bound", lower_bound()).select("query_id", "length", "cluster_id", "series_id", "start", "end", "values", "bound")


def limits(pairs: DataFrame, patterns: pa.Table, k: int) -> DataFrame:
    """(query_id, length, limit): a distance that the k-th best of ``pairs`` does not exceed.

    Pairs with the smallest bounds are warped; where a query has fewer than k of them there is no limit. They are found without
    sorting all pairs: pairs are dealt to slots by a hash, and the PROBES * k-th of the smallest bounds of the slots is the highest
    bound of a probe.
    """
    keys = ["query_id", "length"]
    slot = F.pmod(F.xxhash64("series_id", "start"), F.lit(SLOTS * PROBES * k)).alias("_slot")
    least = pairs.groupBy(*keys, slot).agg(F.min("bound").alias("_least"))
    ranked = least.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy("_least")))
    highest = ranked.where(F.col("_rank") <= PROBES * k).groupBy(*keys).agg(F.max("_least").alias("_highest"))
    # written, so that the scan with values starts from one row per query and length
    nearest = pairs.join(F.broadcast(materialise(highest, "probes")), keys).where(F.col("bound") <= F.col("_highest")).drop("_highest")
    warped = scoring.score(nearest, patterns, members_kernel(k), HIT)
    best = warped.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy("dist"))).where(F.col("_rank") == k)
    return best.select(*keys, F.col("dist").alias("limit"))


def within_limits(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that can still be among the k best."""
    joined = pairs.join(F.broadcast(found), ["query_id", "length"], "left")
    near = F.col("limit").isNull() | (F.col("bound") <= F.col("limit") * (1 + K.SLACK) + 1e-12)
    return joined.where(near).drop("limit")


def _staged(pairs: DataFrame, patterns: pa.Table, k: int, staged: bool) -> DataFrame:
    # written, as the plan of the pairs is asked for its partitions before it runs
    return within_limits(pairs, materialise(limits(pairs, patterns, k), "limits")) if staged else pairs.drop("bound")


def nearest_clusters(
    queries: DataFrame, index: Index, low: int, high: int, drop_same_id_reps: bool = False, staged_rows: int = STAGED_ROWS
) -> DataFrame:
    """Per query and length the cluster whose representative is nearest: ``(query_id, length, cluster_id, dist)``.

    Equal distances go to the cluster made first.
    """
    return _nearest(queries, local_queries(queries), index, low, high, drop_same_id_reps, staged_rows)


def _nearest(queries: DataFrame, few: pa.Table | None, index: Index, low: int, high: int, drop_same: bool, staged_rows: int) -> DataFrame:
    index.check(low, high)
    reps = index.reps.where(F.col("length").between(low, high))
    count = sum(n for length, (n, _) in index.lengths.items() if low <= length <= high)
    if few is not None and count * len(few) >= staged_rows:
        asked = _asked(queries.sparkSession, few).withColumn("length", F.explode(F.sequence(F.lit(low), F.lit(high))))
        pairs = _staged(paired(reps, asked, ["length"], drop_same), few, 1, True)
        found = scoring.score(pairs, few, members_kernel(1, by_cluster=True), HIT)
        found = found.withColumn("cluster_no", F.element_at(F.split("cluster_id", "_"), -1).cast("long"))
    else:
        rows = reps.select("series_id", "length", "cluster_id", "cluster_no", "values")
        patterns = queries.select("query_id", "source_series_id", F.col("q").alias("values")) if few is None else few
        found = scoring.score(rows, patterns, nearest_kernel(drop_same), NEAREST)
    best = F.min(F.struct("dist", "cluster_no", "cluster_id")).alias("b")
    return found.groupBy("query_id", "length").agg(best).select("query_id", "length", "b.cluster_id", "b.dist")


def _named(rows: DataFrame, chosen: pa.Table) -> DataFrame:
    """Rows of the chosen clusters by a filter that prunes partitions, files and row groups."""
    numbers: dict[int, set[int]] = {}
    for length, number in zip(chosen["length"].to_pylist(), chosen["cluster_no"].to_pylist()):
        numbers.setdefault(length, set()).add(number)
    named = F.lit(False)
    for length, own in sorted(numbers.items()):
        named = named | ((F.col("length") == length) & F.col("cluster_no").isin(sorted(own)))
    return rows.where(F.col("length").isin(sorted(numbers))).where(named)


def _chosen(nearest: DataFrame) -> pa.Table | None:
    """(query_id, length, cluster_no) of the chosen clusters, if there are few enough to be named."""
    number = F.element_at(F.split("cluster_id", "_"), -1).cast("long").alias("cluster_no")
    chosen = nearest.select("query_id", "length", number).limit(LOCAL_CLUSTERS + 1).toArrow()
    return chosen if len(chosen) <= LOCAL_CLUSTERS else None


def member_pairs(few: pa.Table, index: Index, chosen: pa.Table, exclude_own: bool = True) -> DataFrame:
    """Members of the chosen clusters paired with the queries that chose them."""
    spark = index.members.sparkSession
    asked = _asked(spark, few).join(F.broadcast(spark.createDataFrame(chosen)), "query_id")
    return paired(_named(index.members, chosen), asked, ["length", "cluster_no"], exclude_own)


def _pairs_at_most(index: Index, chosen: pa.Table, enough: int) -> int:
    """How many pairs the chosen clusters make, exact where they could be ``enough``."""
    most = sum(index.lengths[n][1] for n in chosen["length"].to_pylist())
    if most < enough:
        return most
    reps = _named(index.reps, chosen).join(F.broadcast(index.reps.sparkSession.createDataFrame(chosen)), ["length", "cluster_no"])
    return reps.agg(F.sum("n_members")).first()[0] or 0


def nearest_members(
    queries: DataFrame, index: Index, nearest: DataFrame, k: int, exclude_own: bool = True, staged_rows: int = STAGED_ROWS
) -> DataFrame:
    """Scored members of the chosen clusters, at least the k nearest per query and length."""
    return _members(queries, local_queries(queries), index, nearest, _chosen(nearest), k, exclude_own, staged_rows)


def _members(
    queries: DataFrame, few: pa.Table | None, index: Index, nearest: DataFrame, chosen: pa.Table | None, k: int, exclude_own: bool, staged_rows: int
) -> DataFrame:
    if few is not None and chosen is not None:
        pairs = member_pairs(few, index, chosen, exclude_own)
        staged = _pairs_at_most(index, chosen, staged_rows) >= staged_rows
        # one cluster may lie in a few small files
        return scoring.score(spread(_staged(pairs, few, k, staged)), few, members_kernel(k), HIT)
    wanted = nearest.select("query_id", "length", "cluster_id").join(queries.select("query_id", "source_series_id"), "query_id")
    members = index.members.join(wanted, ["length", "cluster_id"])
    members = exclude_same_id(members) if exclude_own else members
    rows = members.select("query_id", "length", "cluster_id", "series_id", "start", "end", "values")
    return scoring.score(rows, queries.select("query_id", F.col("q").alias("values")), members_kernel(k), HIT)


def indexed_search(
    queries: DataFrame,
    index: Index,
    low: int,
    high: int,
    k: int,
    exclude_overlap: bool = False,
    percentage: float = 1.0,
    exclude_own: bool = True,
    drop_same_id_reps: bool = False,
    staged_rows: int = STAGED_ROWS,
) -> DataFrame:
    """The k best matches per query and length: ``(query_id, length, rank, cluster_id, series_id, start, end, dist)``.

    The same as :func:`warpwise.plans.explore.similarity_search`, from the stored tables alone.
    """
    few = local_queries(queries)
    near = _nearest(queries, few, index, low, high, drop_same_id_reps, staged_rows)
    near = near if few is not None else materialise(near, "nearest")
    chosen = _chosen(near)
    ranks = ranks_needed(k, percentage, high) if exclude_overlap else k
    scored = _members(queries, few, index, near, chosen, ranks, exclude_own, staged_rows)
    best = top_k_without_overlap(scored, k, percentage, high) if exclude_overlap else top_k(scored, k)
    return best.select("query_id", "length", "rank", "cluster_id", "series_id", "start", "end", "dist")
