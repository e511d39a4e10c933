"""Global minimum and maximum, and scaling by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def global_bounds(segments: DataFrame) -> DataFrame:
    """One row ``(lo, hi)`` over all points; empty series do not count."""
    return segments.select(F.array_min("values").alias("lo"), F.array_max("values").alias("hi")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def normalise(frame: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Scale ``values`` to [0, 1] by the given bounds, or by the frame's own.

    Bounds computed here are a scalar subquery, so both run in one plan. Equal bounds raise.
    """
    if lo is None or hi is None:
        bounds = global_bounds(frame)
        low, high = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    else:
        low, high = F.lit(float(lo)), F.lit(float(hi))
    names = [c if c != "values" else "_scaled" for c in frame.columns]
    message = F.lit("all values are equal: cannot scale")
    return (
        frame.withColumn("_lo", low)
        .withColumn("_span", high - F.col("_lo"))
        .withColumn(
            "_span",
            F.when(F.col("_span") == 0, F.raise_error(message).cast("double")).otherwise(F.col("_span")),
        )
        .withColumn("_scaled", F.transform("values", lambda x: (x - F.col("_lo")) / F.col("_span")))
        .select(*[F.col(n).alias("values") if n == "_scaled" else F.col(n) for n in names])
    )
