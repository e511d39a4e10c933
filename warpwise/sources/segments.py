"""The working layout of a series: bounded, overlapping segments.

A segment row ``(series_id, seg_start, own, values, whole)`` owns the window starts
``seg_start .. seg_start + own - 1`` and carries ``max_length`` more points than it owns, so
every window up to that length is cut inside one row. However long a series is, no row, task
or shuffle group has to hold more than ``stride + max_length`` of its points. ``whole`` tells
that the values reach the end of the series, so that windows of any length can be cut.

Stride and ``max_length`` travel with the table, as metadata of the column ``seg_start``, through
every step that keeps that column and through Parquet; nothing has to repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STRIDE = 1024


def with_layout(frame: DataFrame, stride: int, max_length: int) -> DataFrame:
    """``frame`` with the layout written to its column ``seg_start``."""
    return frame.withMetadata("seg_start", {"stride": stride, "max_length": max_length})


def layout(segments: DataFrame) -> tuple[int, int]:
    """Stride and ``max_length`` that the segments were cut with."""
    kept = segments.schema["seg_start"].metadata
    if "stride" not in kept:
        raise ValueError("these rows are not segments: make them with cut_segments or segments_of_points")
    return kept["stride"], kept["max_length"]


def with_room(segments: DataFrame, longest: int) -> DataFrame:
    """``segments`` unchanged; running them raises if they cannot hold every window of ``longest`` points."""
    _, most = layout(segments)
    if longest <= most:
        return segments
    message = F.concat(
        F.lit(f"windows of {longest} points do not fit segments cut for {most}; cut them with a larger max_length: series "),
        F.col("series_id"),
    )
    return segments.where(F.when(F.col("whole"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def cut_segments(series: DataFrame, max_length: int, stride: int = STRIDE) -> DataFrame:
    """``(series_id, values)`` rows -> segment rows, without a shuffle."""
    size = F.size("values")
    cut = (
        series.where(size > 0)
        .select(
            "series_id",
            F.explode(F.sequence(F.lit(0), size - 1, F.lit(stride))).alias("at"),
            "values",
        )
        .select(
            "series_id",
            F.col("at").cast("long").alias("seg_start"),
            F.least(F.lit(stride), F.size("values") - F.col("at")).alias("own"),
            F.slice("values", F.col("at") + 1, F.lit(stride + max_length)).alias("values"),
            (F.col("at") + stride + max_length >= F.size("values")).alias("whole"),
        )
    )
    return with_layout(cut, stride, max_length)


def segments_of_points(points: DataFrame, max_length: int, stride: int = STRIDE) -> DataFrame:
    """``(series_id, pos, value)`` rows -> segment rows.

    Each point goes to the segment owning its position and to the earlier ones whose tail
    covers it; a group is one segment, never one series. One point more shows whether the series goes on.
    """
    last = F.floor(F.col("pos") / stride)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - (stride + max_length + 1)) / stride) + 1)
    spread = points.select(
        "series_id",
        F.explode(F.sequence(first, last)).alias("seg"),
        "pos",
        "value",
    )
    start = F.col("seg") * stride
    cut = (
        spread.groupBy("series_id", "seg")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells"))
        .select(
            "series_id",
            start.cast("long").alias("seg_start"),
            F.least(F.lit(stride).cast("long"), F.element_at("cells", -1)["pos"] + 1 - start)
            .cast("int")
            .alias("own"),
            F.slice(F.transform("cells", lambda c: c["value"]), 1, stride + max_length).alias("values"),
            (F.size("cells") <= stride + max_length).alias("whole"),
        )
    )
    return with_layout(cut, stride, max_length)


def points_of_segments(segments: DataFrame, value: str = "value") -> DataFrame:
    """Segment rows -> one row per point ``(series_id, pos, value)``."""
    return segments.select(
        "series_id", "seg_start", F.posexplode(F.slice("values", 1, F.col("own")))
    ).select(
        "series_id",
        (F.col("seg_start") + F.col("pos")).alias("pos"),
        F.col("col").alias(value),
    )


def window_values(start: Column, length: Column) -> Column:
    """Values of the window at ``start`` inside the segment row that owns it."""
    return F.slice("values", (start - F.col("seg_start")).cast("int") + 1, length)


def with_values(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Add ``values`` to window rows ``(series_id, start, length, ...)``.

    The join key is (series, segment), so a series of any size spreads over the cluster. A window
    that its segment does not hold raises.
    """
    stride, _ = layout(segments)
    message = F.concat(F.lit("no such window in its segment: series "), F.col("series_id"), F.lit(", start "), F.col("start"))
    keyed = rows.withColumn("seg_start", F.col("start") - F.col("start") % stride)
    owner = segments.select("series_id", "seg_start", F.col("values").alias("segment"))
    offset = (F.col("start") - F.col("seg_start")).cast("int") + 1
    return (
        keyed.join(owner, ["series_id", "seg_start"])
        .withColumn(
            "values",
            F.when(offset - 1 + F.col("length") <= F.size("segment"), F.slice("segment", offset, F.col("length"))).otherwise(
                F.raise_error(message).cast("array<double>")
            ),
        )
        .drop("seg_start", "segment")
    )
