"""Series from a long table: one row per point, ordered by columns of the row."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import materialise
from .segments import STRIDE, cut_segments, points_of_segments, segments_of_points, with_layout

# A series up to this many points is gathered in one group; a longer one is numbered in ranges.
GATHER_POINTS = 50_000
# Points of one range, at most, where there are many; the driver keeps some numbers for each pair of ranges.
RANGE_POINTS = 1_000_000


def _rows(table: DataFrame, id_col: str, order_cols: list[str], value_col: str) -> DataFrame:
    missing = F.raise_error(F.lit("a series value is missing")).cast("double")
    return table.select(
        F.col(id_col).cast("string").alias("series_id"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)],
        F.coalesce(F.col(value_col).cast("double"), missing).alias("value"),
    )


def number_points(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``(series_id, pos, value)`` for series of any size.

    Rows are range-partitioned by (series, order), so a huge series covers many partitions (rows that
    agree in all of these lie together); its rows are numbered inside each, and the counts of the earlier ones are added.
    """
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), "series_id", *order)
    parts = materialise(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    by_part = W.partitionBy("series_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = (
        parts.groupBy("series_id", "part")
        .count()
        .select("series_id", "part", F.coalesce(F.sum("count").over(by_part), F.lit(0)).alias("before"))
    )
    inside = F.row_number().over(W.partitionBy("series_id", "part").orderBy(*order)) - 1
    return (
        parts.withColumn("inside", inside)
        .join(before, ["series_id", "part"])
        .select("series_id", (F.col("before") + F.col("inside")).alias("pos"), "value")
    )


def ranges_for(points: int, gather_points: int, cores: int) -> int:
    """How many ranges to number points in: enough for all cores, then one for RANGE_POINTS points."""
    return max(min(math.ceil(points / max(1, gather_points)), 4 * cores), math.ceil(points / RANGE_POINTS))


def segments_from_long(
    table: DataFrame,
    id_col: str,
    order_cols: list[str],
    value_col: str,
    max_length: int,
    stride: int = STRIDE,
    gather_points: int = GATHER_POINTS,
) -> DataFrame:
    """Segment rows of every series of ``table``."""
    rows = _rows(table, id_col, order_cols, value_col)
    # points of equal order are taken by value, whichever way a series goes
    order = [*[f"o{i}" for i in range(len(order_cols))], "value"]
    counts = materialise(rows.groupBy("series_id").count(), "series-sizes")
    huge = counts.where(F.col("count") > gather_points)
    huge_points = huge.agg(F.sum("count")).first()[0]

    def gathered(part: DataFrame) -> DataFrame:
        cells = F.array_sort(F.collect_list(F.struct(*order)))
        series = part.groupBy("series_id").agg(
            F.transform(cells, lambda c: c["value"]).alias("values")
        )
        return cut_segments(series, max_length, stride)

    if not huge_points:
        return gathered(rows)
    partitions = ranges_for(huge_points, gather_points, table.sparkSession.sparkContext.defaultParallelism)
    points = number_points(rows.join(huge, "series_id", "left_semi"), order, partitions)
    short = gathered(rows.join(huge, "series_id", "left_anti"))
    return with_layout(short.unionByName(segments_of_points(points, max_length, stride)), stride, max_length)


def points_from_long(
    table: DataFrame, id_col: str, order_cols: list[str], value_col: str
) -> DataFrame:
    """``(series_id, pos, value)`` with 0-based positions."""
    return points_of_segments(segments_from_long(table, id_col, order_cols, value_col, 0))
