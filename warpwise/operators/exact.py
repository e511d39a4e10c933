"""Exhaustive search: every window of the query's length in every series.

Windows with a value that is not finite match nothing; such a query raises, and so does one longer
than the windows that the segments were cut for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import kernels as K
from ..functions.warping import warping_path
from ..runtime import materialise
from ..sources.segments import layout, with_values
from .scoring import score

TILE_CELLS = 4_000_000  # window cells held at a time inside a task
START_BITS = 44  # room for a start position in a tie key

_BEST = pa.schema(
    [
        ("query_id", pa.string()),
        ("length", pa.int32()),
        ("series_id", pa.string()),
        ("start", pa.int64()),
        ("dist", pa.float64()),
    ]
)


def _prepare(cost: str, per_series: bool, most: int):
    def prepare(table: pa.Table):
        names = table["query_id"].to_pylist()
        at, flat = K.offsets_and_values(table["values"])
        queries = [(name, flat[at[i] : at[i + 1]]) for i, name in enumerate(names)]
        if not np.isfinite(flat).all():
            raise ValueError("a query holds a value that is not finite")
        longest = max((len(q) for _, q in queries), default=0)

        def run(batch: pa.RecordBatch) -> pa.Table:
            offsets, values = K.offsets_and_values(batch.column("values"))
            ids = batch.column("series_id")
            if longest > most and not all(batch.column("whole").to_pylist()):
                raise ValueError(f"a query of {longest} points does not fit segments cut for {most}")
            order = np.unique(np.array(ids.to_pylist(), dtype=object), return_inverse=True)[1]
            first = batch.column("seg_start").to_numpy()
            own = batch.column("own").to_numpy()
            parts = []
            for name, q in queries:
                counts = np.clip(np.diff(offsets) - len(q) + 1, 0, own)
                tile = np.cumsum(counts) * len(q) // TILE_CELLS
                for t in np.unique(tile[counts > 0]):
                    rows = np.nonzero((tile == t) & (counts > 0))[0]
                    row = np.repeat(rows, counts[rows])
                    inside = np.arange(len(row)) - np.repeat(np.cumsum(counts[rows]) - counts[rows], counts[rows])
                    windows = values[(offsets[row] + inside)[:, None] + np.arange(len(q))]
                    tie = (order[row] << START_BITS) + first[row] + inside
                    finite = np.isfinite(windows).all(axis=1)
                    if not finite.all():
                        row, inside, windows, tie = row[finite], inside[finite], windows[finite], tie[finite]
                        if not len(row):
                            continue
                    group = np.unique(order[row], return_inverse=True)[1] if per_series else np.zeros(len(row), np.int64)
                    best, dist = K.best_of_groups(windows, q, group, tie, cost)
                    size = len(best)
                    parts.append(
                        pa.Table.from_arrays(
                            [
                                pa.array([name] * size),
                                pa.array(np.full(size, len(q), np.int32)),
                                ids.take(pa.array(row[best])),
                                pa.array(first[row[best]] + inside[best]),
                                pa.array(dist),
                            ],
                            schema=_BEST,
                        )
                    )
            return pa.concat_tables(parts) if parts else _BEST.empty_table()

        return run

    return prepare


def best_per_series(queries: DataFrame, segments: DataFrame, cost: str = "sq", **limits: int) -> DataFrame:
    """Nearest window of every series to every query: ``(query_id, series_id, start, length, dist)``."""
    patterns = queries.select("query_id", F.col("q").alias("values"))
    found = score(segments, patterns, _prepare(cost, True, layout(segments)[1]), _BEST, **limits)
    return (
        found.groupBy("query_id", "series_id", "length")
        .agg(F.min(F.struct("dist", "start")).alias("b"))
        .select("query_id", "series_id", "b.start", "length", "b.dist")
    )


def best_match(
    queries: DataFrame, segments: DataFrame, cost: str = "sq", **limits: int
) -> DataFrame:
    """The nearest window of all, with its values, distance and warping path.

    Ties go by (series_id, start). The path is traced for the returned rows alone.
    """
    patterns = queries.select("query_id", F.col("q").alias("values"))
    found = score(segments, patterns, _prepare(cost, False, layout(segments)[1]), _BEST, **limits)
    best = (
        found.groupBy("query_id", "length")
        .agg(F.min(F.struct("dist", "series_id", "start")).alias("b"))
        .select("query_id", "length", "b.series_id", "b.start", F.col("b.dist").alias("distance"))
    )
    return (
        with_values(materialise(best, "best"), segments)
        .join(queries.select("query_id", "q"), "query_id")
        .select(
            "query_id",
            "series_id",
            "start",
            F.col("values").alias("value"),
            "distance",
            warping_path(F.col("q"), F.col("values"), cost).alias("path"),
        )
    )


def sample_queries(segments: DataFrame, amount: int = 5, seed: int = 0) -> DataFrame:
    """Specs ``(query_id, series_id, start, end)`` of a seeded sample of series.

    Query i starts at (i + 1) * 2 and ends between start + 5 and half the series, excluded;
    a series too short for that raises.
    """
    sizes = segments.groupBy("series_id").agg(F.max(F.col("seg_start") + F.col("own")).alias("n"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "series_id"))
    picked = sizes.withColumn("digest", digest).orderBy("digest", "series_id").limit(amount)
    numbered = picked.agg(F.array_sort(F.collect_list(F.struct("digest", "series_id", "n"))).alias("all")).select(
        F.posexplode("all").alias("i", "s")
    )
    start = (F.col("i") + 1) * 2
    room = F.floor(F.col("s.n") / 2) - start - 5
    draw = F.conv(F.substring("s.digest", 1, 15), 16, 10).cast("long")
    message = F.concat(F.lit("series too short to cut a query: "), F.col("s.series_id"))
    return numbered.select(
        F.concat(F.lit("q"), F.col("i")).alias("query_id"),
        F.col("s.series_id").alias("series_id"),
        start.cast("long").alias("start"),
        F.when(room > 0, start + 5 + draw % room).otherwise(F.raise_error(message).cast("long")).alias("end"),
    )
