"""Connected components of a distributed graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import new_path, remove, write_parquet


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    tied = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    tied = down.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """(``node``, ``component``) for every node of ``edges`` (columns ``u`` and ``v``); the component is its smallest node.

    Edges with a null end and loops are left out. Each round is written to the shared folder, and the
    round before is removed then; the number of rounds grows with the logarithm of the graph.
    A node with very many edges meets one row in the joins, so its rows can be split at run time.
    """
    spark = edges.sparkSession

    def stored(df):
        path = new_path(spark, "components")
        write_parquet(df, path)
        saved = spark.read.schema(df.schema).parquet(path)
        sums = saved.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return path, saved, tuple(sums)

    path, current, seen = stored(edges.where("u <> v").select("u", "v").distinct())
    while seen[0]:
        before, last = path, seen
        path, current, seen = stored(_small_star(_large_star(current)))
        remove(spark, before)
        if seen == last:
            break
    roots = current.select(F.col("v").alias(node), F.col("v").alias(component)).distinct()
    return current.select(F.col("u").alias(node), F.col("v").alias(component)).unionByName(roots)
