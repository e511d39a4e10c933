"""Series from wide CSV text: one series per line, label cells first.

The header is the first line of each file, whatever it says; a later line that equals it is data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Cells that count as padding at the end of a line, and what a number looks like.
PADDING = [",", "0", ""]
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def clean_cells(cells: Column) -> Column:
    """Trim every cell; empty and one-blank cells become null."""
    return F.transform(cells, lambda c: F.when(~c.isin("", " "), F.trim(c)))


def trim_padding(cells: Column, mode: str = "reference") -> Column:
    """Drop padding cells from the end.

    ``reference`` also drops the last cell that is kept (an all-padding line loses one cell);
    ``exact`` drops the padding only.
    """
    kept = F.array_max(F.transform(cells, lambda c, i: F.when(~c.isin(*PADDING), i)))
    if mode == "reference":
        return F.slice(cells, 1, F.coalesce(kept, F.greatest(F.size(cells) - 1, F.lit(0))))
    if mode == "exact":
        return F.slice(cells, 1, F.coalesce(kept + 1, F.lit(0)))
    raise ValueError(f"unknown trim mode {mode!r}")


def label(cells: Column, count: int) -> Column:
    """``(a)_(b)_...`` of the first ``count`` cells, blanks turned into dashes."""
    wrapped = F.transform(F.slice(cells, 1, count), lambda c: F.concat(F.lit("("), c, F.lit(")")))
    joined = F.concat_ws("_", wrapped)
    return F.replace(F.replace(joined, F.lit("  "), F.lit("-")), F.lit(" "), F.lit("-"))


def _feature_cells(line: Column) -> Column:
    """Cells of the stripped line without its last character, as the feature lookup sees them."""
    stripped = F.trim(line)
    return clean_cells(F.split(F.substring(stripped, F.lit(1), F.length(stripped) - 1), ",", -1))


MANY_FILES = 100_000  # first places of so many files are broadcast; beyond that Spark chooses the join


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """``(line, file, place)`` of every line, and the first line of the first file by name."""
    text = spark.read.text(path)
    files = sorted(text.inputFiles())
    head = spark.read.text(files[0]).first() if files else None
    if head is None:
        raise ValueError(f"no header line in {path}")
    # order of the lines of a file: split within the file, line within the split
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line_no"))
    return text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), place.alias("place")), head["value"]


def _data_lines(lines: DataFrame) -> DataFrame:
    """All lines but the first of each file."""
    heads = lines.groupBy("file").agg(F.min("place").alias("head"))
    heads = F.broadcast(heads) if len(lines.inputFiles()) <= MANY_FILES else heads
    # the header becomes a null line by a value from the join, so that no later check of lines is made before it
    data = lines.join(heads, "file").select(F.when(F.col("place") > F.col("head"), F.col("line")).alias("line"))
    return data.where(F.col("line").isNotNull())


def _parsed(spark: SparkSession, path: str, features: list[int], trim: str) -> DataFrame:
    """Line, label, values and, for lines that cannot be read, the reason."""
    lines, _ = _lines(spark, path)
    raw = F.split("line", ",", -1)
    count = len(features)
    data = F.col("cells")
    reason = (
        F.when(F.col("line").isNull(), None)
        .when(F.size(_feature_cells(F.col("line"))) <= max(features), "feature cells missing")
        .when(F.size(data) < count, "label cells missing")
        .when(F.exists(F.slice(data, count + 1, F.size(data)), lambda c: ~c.rlike(NUMBER)), "not a number")
    )
    # a number has passed the pattern, so the cast below only runs on readable cells
    return (
        _data_lines(lines)
        .withColumn("cells", trim_padding(F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0))), trim))
        .withColumn("reason", reason)
        .withColumn("series_id", label(data, count))
        .withColumn(
            "values",
            F.transform(F.slice(data, count + 1, F.size(data)), lambda c: F.trim(c).try_cast("double")),
        )
    )


def read_wide_csv(
    spark: SparkSession, path: str, features: list[int] = [0, 1, 2, 3, 4], trim: str = "reference"
) -> DataFrame:
    """``(series_id, values)`` of every line but the header; an unreadable line raises.

    The label takes as many leading cells as ``features`` names; the indices themselves are
    only checked to exist. The last cell of a line is always dropped.
    """
    message = F.concat(F.lit("unreadable line ("), F.col("reason"), F.lit("): "), F.col("line"))
    fine = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return _parsed(spark, path, features, trim).where(fine).select("series_id", "values")


def read_wide_csv_lenient(
    spark: SparkSession, path: str, features: list[int] = [0, 1, 2, 3, 4], trim: str = "reference"
) -> tuple[DataFrame, DataFrame]:
    """``(series, rejected lines with their reason)`` instead of raising."""
    parsed = _parsed(spark, path, features, trim)
    good = parsed.where(F.col("reason").isNull()).select("series_id", "values")
    return good, parsed.where(F.col("reason").isNotNull()).select("line", "reason")


def read_keyed_csv(spark: SparkSession, path: str, features: list[int]) -> DataFrame:
    """``(series_id, values array<string>)``, the last line of each label winning.

    The label takes one cell fewer than ``features`` names, values start after as many cells
    as the header has, and the header itself is also a row.
    """
    lines, head = _lines(spark, path)
    width = F.size(_feature_cells(F.lit(head)))
    raw = F.split("line", ",", -1)
    cells = trim_padding(F.slice(raw, 1, F.greatest(F.size(raw) - 1, F.lit(0))))
    place = F.struct("file", "place")
    message = F.concat(F.lit("label cells missing: "), F.col("line"))
    wide = F.when(F.size("cells") >= len(features) - 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return (
        lines.where(F.col("line") != "")
        .select("line", cells.alias("cells"), place.alias("place"))
        .where(wide)
        .select(
            label(F.col("cells"), len(features) - 1).alias("series_id"),
            F.slice("cells", width + 1, F.size("cells")).alias("values"),
            "place",
        )
        .groupBy("series_id")
        .agg(F.max_by("values", "place").alias("values"))
    )


def extract_rows(spark: SparkSession, source: str, rows: int, target: str | None = None) -> DataFrame:
    """The first ``rows`` data rows of a CSV file, or of a folder of them in the order of their names, also
    written to ``target`` when given.

    Rows are counted per split of the files, files being taken in order until they hold enough; splits that lie inside the
    prefix are read whole, and only the last one is cut. No step brings the prefix to one task, however large it is; only a written
    extract is sorted, by ranges.
    """
    schema = spark.read.csv(source, header=True).schema
    files = sorted(spark.read.csv(source, header=True).inputFiles())
    split = ["_file", "_block"]
    taken = 1
    while True:
        table = spark.read.schema(schema).csv(files[:taken], header=True)
        placed = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        counts = placed.groupBy(*split).agg(F.count(F.lit(1)).alias("_rows"))
        if taken >= len(files) or (counts.agg(F.sum("_rows")).first()[0] or 0) >= rows:
            break
        taken = min(len(files), 4 * taken)
    # one row per split
    before = F.coalesce(F.sum("_rows").over(W.orderBy(*split).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    needed = counts.withColumn("_before", before).where(F.col("_before") < rows)
    inside = placed.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(needed), split)
    place = F.col("_before") + F.row_number().over(W.partitionBy(*split).orderBy("_row"))
    whole = inside.where(F.col("_before") + F.col("_rows") <= rows)
    last = inside.where(F.col("_before") + F.col("_rows") > rows).withColumn("_place", place).where(F.col("_place") <= rows).drop("_place")
    part = whole.unionByName(last)
    if target is None:
        return part.select(*schema.names)
    part.orderBy(*split, "_row").select(*schema.names).write.mode("overwrite").csv(target, header=True)
    return spark.read.csv(target, header=True)
