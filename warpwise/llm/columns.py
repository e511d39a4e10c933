"""Running a numpy function over one text column, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

SLICE_BYTES = 2 << 20  # text handled at once inside a task; one longer text is a slice of its own


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns of ``df`` except ``names``, which Spark compares without case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def column(name: str):
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame | Iterable[str], name: str) -> str:
    """``name``, lengthened until no column has it; Spark compares names without case."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about ``limit`` bytes in column ``name``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(name))
        ends = np.cumsum(_lengths(values) + 1)
        start = 0
        while start < batch.num_rows:
            reach = (ends[start - 1] if start else 0) + limit
            stop = max(start + 1, int(np.searchsorted(ends, reach, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(values: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def append_columns(
    df: DataFrame, text: str, fields: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list]], keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``df`` with the columns ``fields`` computed from column ``text``.

    ``make()`` runs once per task and returns a function from a record batch (which holds ``text``
    under that name) to the arrays of ``fields``. Columns of ``df`` with the same names are replaced.
    ``keep`` names the columns to carry on (default: all).
    """
    carried = without(df.select(*[column(c) for c in keep]) if keep is not None else df, fields.names)
    source = free([*df.columns, *fields.names], "__text")
    chosen = df.select(*[column(c) for c in carried], column(text).cast("string").alias(source))
    schema = T.StructType([chosen.schema[c] for c in carried] + fields.fields)
    width = len(carried)

    def run(batches):
        work = make()
        out_schema = None
        for part in slices(batches, source, slice_bytes):
            made = work(part.rename_columns([*part.schema.names[:width], "text"]))
            arrays = [part.column(i) for i in range(width)] + list(made)
            names = [*part.schema.names[:width], *fields.names]
            out_schema = out_schema or pa.schema([(n, a.type) for n, a in zip(names, arrays)])
            yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    return chosen.mapInArrow(run, schema)
