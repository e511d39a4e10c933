"""Frames behind the plots: one row per point of a curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..runtime import materialise
from ..sources.segments import with_values
from .cluster import priority


def _points(frame: DataFrame, *keep: str) -> DataFrame:
    return frame.select(*keep, F.posexplode("values").alias("pos", "value"))


def cluster_profile(
    clusters: DataFrame, segments: DataFrame, lengths: int, members: int, seed: int = 0
) -> DataFrame:
    """The first ``members`` windows of every cluster of the first ``lengths`` lengths.

    They come in the order in which clustering with ``seed`` met them, the representative first.
    """
    wanted = clusters.select("length").distinct().orderBy("length").limit(lengths)  # a few rows
    order = W.partitionBy("length", "cluster_id").orderBy(F.desc("is_rep"), priority(seed, F.col("series_id"), F.col("start"), F.col("end")))
    shown = (
        clusters.join(F.broadcast(wanted), "length")
        .withColumn("member", F.row_number().over(order))
        .where(F.col("member") <= members)
    )
    label = F.concat(F.lit("id "), F.col("cluster_id"), F.col("series_id"), F.lit("_"), F.col("start"), F.lit("_"), F.col("end"))
    labelled = with_values(materialise(shown, "shown"), segments).withColumn("label", label)
    return _points(labelled, "length", "cluster_id", "member", "label")


def result_profile(
    queries: DataFrame, results: DataFrame, segments: DataFrame
) -> DataFrame:
    """Curves of the ranked matches and, under rank 0 and length 0, of the queries."""
    label = F.concat(
        F.lit("Rank"), F.col("rank"), F.lit(" id "), F.col("cluster_id"), F.col("series_id"), F.lit("_"), F.col("start"), F.lit("_"), F.col("end")
    )
    matches = with_values(materialise(results, "results"), segments).withColumn("label", label)
    asked = queries.select(
        "query_id",
        F.lit(0).alias("length"),
        F.lit(0).alias("rank"),
        F.lit("QUERY").alias("label"),
        F.col("q").alias("values"),
    )
    keep = ("query_id", "length", "rank", "label")
    return _points(matches, *keep).unionByName(_points(asked, *keep))
