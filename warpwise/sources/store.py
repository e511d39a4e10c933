"""A dataset on disk: series segments, windows and clusters, with checks and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.windows import expand_runs
from ..runtime import write_parquet

# The folders of a stored dataset.
PARTS = ("series", "windows", "clusters")


class DuplicateIdError(ValueError):
    """Series ids that are loaded already; ``ids`` is a table of all of them."""

    def __init__(self, ids: DataFrame, count: int, some: list[str]):
        super().__init__(f"{count} series ids are already loaded, among them {', '.join(some)}")
        self.ids = ids


def duplicate_ids(new: DataFrame, loaded: DataFrame) -> DataFrame:
    """Ids present in both, one row each."""
    ids = new.select("series_id").distinct()
    return ids.join(loaded.select("series_id"), "series_id", "left_semi")


def repeated_ids(rows: DataFrame) -> DataFrame:
    """Ids that occur in more than one row of a load: ``(series_id, rows)``."""
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def replace_series(new: DataFrame, loaded: DataFrame | None) -> DataFrame:
    """A new load replaces the old one, but must not bring an id that is loaded already."""
    if loaded is not None:
        ids = duplicate_ids(new, loaded)
        some = [r["series_id"] for r in ids.orderBy("series_id").take(10)]
        if some:
            raise DuplicateIdError(ids, ids.count(), some)
    return new


def series_status(series: DataFrame, windows: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """``(series_id, status)``: loaded, grouped or clustered."""
    out = series.select("series_id").distinct()
    for name, part in (("grouped", windows), ("clustered", clusters)):
        if part is None:
            out = out.withColumn(name, F.lit(False))
        else:
            seen = part.select("series_id").distinct().withColumn(name, F.lit(True))
            out = out.join(seen, "series_id", "left")
    status = F.when(F.col("clustered"), "clustered").when(F.col("grouped"), "grouped").otherwise("loaded")
    return out.select("series_id", status.alias("status"))


def save_dataset(
    path: str,
    series: DataFrame | None = None,
    windows: DataFrame | None = None,
    clusters: DataFrame | None = None,
    overwrite: bool = False,
) -> None:
    """Write the given parts; windows and clusters are partitioned by length.

    Windows may be given one row each or as runs, which take far less room.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    for name, part in zip(PARTS, (series, windows, clusters)):
        if part is not None:
            write_parquet(part, f"{path}/{name}", None if name == "series" else ["length"], mode)


def load_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts that were saved under exactly this path; windows saved as runs come one row each."""
    from pyspark.errors import AnalysisException

    parts = {}
    for name in PARTS:
        try:
            part = spark.read.parquet(f"{path}/{name}")
            parts[name] = expand_runs(part) if name == "windows" and "first" in part.columns else part
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return parts


def to_map(series: DataFrame, entries: int = 256) -> DataFrame:
    """``(series_id, values)`` rows -> maps ``{series_id: values}`` of about ``entries`` series each.

    Series are dealt to maps by a hash of their id; an id that comes twice raises.
    """
    maps = F.lit(max(1, -(-series.count() // entries)))
    bucket = F.pmod(F.xxhash64("series_id"), maps).alias("bucket")
    return series.groupBy(bucket).agg(F.map_from_entries(F.collect_list(F.struct("series_id", "values"))).alias("entry")).select("entry")


def from_map(maps: DataFrame) -> DataFrame:
    """Maps ``{series_id: values}`` -> ``(series_id, values)`` rows."""
    return maps.select(F.explode("entry").alias("series_id", "values"))
