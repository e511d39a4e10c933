"""Subsequence windows: coordinates first, values only where a step needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.segments import layout, window_values, with_room


def window_count(length: Column, include_last: bool = False) -> Column:
    """Windows of ``length`` that start in this segment row.

    By default the last point of a series belongs to no window, so a series of n points has
    n - length of them; ``include_last`` gives n - length + 1.
    """
    room = F.size("values") - length + (1 if include_last else 0)
    return F.greatest(F.lit(0), F.least(F.col("own"), room))


def check_range(shortest: int, longest: int) -> None:
    if shortest < 1 or longest < shortest:
        raise ValueError(f"bad window lengths {shortest}..{longest}: need 1 <= shortest <= longest")


def lengths_of(segments: DataFrame, shortest: int, longest: int, include_last: bool, *keep: str) -> DataFrame:
    """One row per segment and length with ``count`` > 0 windows starting in it.

    Segments too short for the longest windows raise when run.
    """
    check_range(shortest, longest)
    segments = with_room(segments, longest)
    room = F.least(F.lit(longest), F.size("values") - (0 if include_last else 1))
    return (
        segments.where(room >= shortest)
        .withColumn("length", F.explode(F.sequence(F.lit(shortest), room)))
        .select("series_id", "seg_start", "length", window_count(F.col("length"), include_last).alias("count"), *keep)
    )


def window_runs(segments: DataFrame, shortest: int, longest: int, include_last: bool = False) -> DataFrame:
    """``(length, series_id, first, count)``: the windows of a length that start at first, first + 1, ... in one segment row.

    The stored form of a group: its rows grow with segments and lengths, not with windows.
    """
    counts = lengths_of(segments, shortest, longest, include_last)
    return counts.select("length", "series_id", F.col("seg_start").alias("first"), F.col("count").cast("int").alias("count"))


def expand_runs(runs: DataFrame) -> DataFrame:
    """``(length, series_id, start, end)`` of the windows that runs stand for, end exclusive; no shuffle."""
    start = F.col("first") + F.col("at")
    return runs.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("count") - 1))).select(
        "length", "series_id", start.alias("start"), (start + F.col("length")).alias("end")
    )


def windows(segments: DataFrame, shortest: int, longest: int, include_last: bool = False) -> DataFrame:
    """``(length, series_id, start, end)`` of every window, end exclusive; no shuffle."""
    return expand_runs(window_runs(segments, shortest, longest, include_last))


def max_length(segments: DataFrame) -> DataFrame:
    """Points of the longest series, as one row ``(max_length)``."""
    end = F.col("seg_start") + F.col("own")
    return segments.agg(F.max(end).cast("long").alias("max_length"))


def grouped_windows(segments: DataFrame, shortest: int, longest: int, include_last: bool = False) -> DataFrame:
    """The nested form ``(length, members)``, in bounded parts: one row per length and segment.

    A length may hold most of all windows, so its members are never gathered in one row.
    """
    return lengths_of(segments, shortest, longest, include_last).select(
        "length",
        F.transform(
            F.sequence(F.lit(0), F.col("count") - 1),
            lambda at: F.struct(
                F.col("series_id"),
                (F.col("seg_start") + at).alias("start"),
                (F.col("seg_start") + at + F.col("length")).alias("end"),
            ),
        ).alias("members"),
    )


def group_sizes(segments: DataFrame, shortest: int, longest: int, include_last: bool = False) -> DataFrame:
    """``(length, windows)``; counted per segment, so the windows are never enumerated."""
    counts = lengths_of(segments, shortest, longest, include_last)
    return counts.groupBy("length").agg(F.sum("count").cast("long").alias("windows"))


def check_lengths(rows: DataFrame) -> DataFrame:
    """``rows`` unchanged; running them raises if ``end - start`` differs from ``length``."""
    message = F.concat(F.lit("window length mismatch, length = "), F.col("length"))
    right = F.col("end") - F.col("start") == F.col("length")
    return rows.where(F.when(right, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def fixed_windows(segments: DataFrame, length: int, include_last: bool = True) -> DataFrame:
    """``(series_id, start, values)`` of all windows of one length, the last point included."""
    return (
        lengths_of(segments, length, length, include_last, "values")
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
        .withColumn("start", F.col("seg_start") + F.col("at"))
        .select("series_id", "start", window_values(F.col("start"), F.lit(length)).alias("values"))
    )


def cut(segments: DataFrame, specs: DataFrame) -> DataFrame:
    """Slices ``[start, end)`` named by ``specs (query_id, series_id, start, end)``.

    An unknown series raises; an end past the series shortens the slice. Each slice is put
    together from the segments it touches, joined on (series, segment).
    """
    stride, _ = layout(segments)
    step = F.lit(stride).cast("long")
    touched = F.sequence(F.col("start") - F.col("start") % stride, F.greatest("start", F.col("end") - 1), step)
    # the first segment shows that the series exists
    pieces = specs.withColumn("seg_start", F.explode(F.array_union(F.array(F.lit(0).cast("long")), touched)))
    owner = segments.select("series_id", "seg_start", F.slice("values", 1, F.col("own")).alias("owned"))
    offset = F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("seg_start"))
    stop = F.least(F.size("owned").cast("long"), F.col("end") - F.col("seg_start"))
    count = F.greatest(F.lit(0).cast("long"), stop - offset).cast("int")
    part = F.when(count > 0, F.slice("owned", offset.cast("int") + 1, count)).otherwise(F.slice("owned", 1, 0))
    found = (
        pieces.join(owner, ["series_id", "seg_start"])
        .groupBy("query_id", "series_id")
        .agg(F.array_sort(F.collect_list(F.struct("seg_start", part.alias("part")))).alias("parts"))
        .withColumn("q", F.flatten(F.transform("parts", lambda x: x["part"])))
        .drop("parts")
    )
    message = F.concat(F.lit("series not found: "), F.col("series_id"))
    return specs.join(found, ["query_id", "series_id"], "left").select(
        "query_id",
        F.col("series_id").alias("source_series_id"),
        "start",
        "end",
        F.coalesce("q", F.raise_error(message).cast("array<double>")).alias("q"),
    )
