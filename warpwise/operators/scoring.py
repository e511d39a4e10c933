"""Score rows against a set of patterns: the one join every search here is made of.

``prepare(patterns)`` turns an Arrow table of patterns into a function from an Arrow batch of
rows to an Arrow table of results. Patterns of a measured, bounded size travel to the rows and
the rows are not shuffled. Larger pattern sets are cut into blocks on a grid of two features that bound the
distance from below; rows go only to the blocks that they reach, and the caller combines what the blocks
find. Without such features every row block meets every pattern block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

# Patterns up to this many array cells (8 bytes each) are broadcast; larger sets are cut into blocks.
BROADCAST_CELLS = 16_000_000
BLOCK_CELLS = 8_000_000
ROW_CELLS = 16  # weight of a row's other columns
PIECE_BYTES = 4 << 20  # of a batch of rows that a kernel takes at once
FINEST = 10_000  # blocks of one length that are asked for at most; more come from salt

Prepare = Callable[[pa.Table], Callable[[pa.RecordBatch], pa.Table]]


def pieces(batch: pa.RecordBatch, piece_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``piece_bytes``, so that what a kernel makes of one does not grow with Spark's batches."""
    rows = max(1, batch.num_rows * piece_bytes // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def cells(frame: DataFrame, values: str = "values") -> int:
    """Weight of a frame in array cells, from one aggregate."""
    weight = F.sum(F.size(values).cast("long") + ROW_CELLS)
    return frame.agg(F.coalesce(weight, F.lit(0)).alias("n")).first()["n"]


@dataclass(frozen=True)
class Block:
    """A block of patterns: those of ``length`` (None: of any) whose two features lie in [low, high)."""

    number: int
    length: int | None
    low: tuple[float, float]
    high: tuple[float, float]


@dataclass(frozen=True)
class Routing:
    """How patterns are cut into blocks by two features, and which rows meet which blocks.

    ``features`` gives the two features of the patterns as columns, ``by_length`` tells that patterns of different lengths never meet
    one row, and ``route`` adds ``_block`` to rows, once for each block that a row is to meet.
    """

    features: Callable[[DataFrame], tuple[Column, Column]]
    by_length: bool
    route: Callable[[DataFrame, list[Block]], DataFrame]


def _cuts_of(patterns: DataFrame, group: list[str], feature: str, wanted: dict) -> dict:
    """Cuts of a feature into ``wanted`` parts of about equal weight, per group."""
    finest = max(wanted.values())
    if finest <= 1:
        return {}
    grid = F.percentile_approx(feature, [i / finest for i in range(1, finest)], 10 * finest)
    out = {}
    for r in patterns.groupBy(*group).agg(grid.alias("cuts")).collect():
        key = tuple(r[g] for g in group)
        parts = wanted.get(key, 1)
        out[key] = sorted({r["cuts"][round(i * finest / parts) - 1] for i in range(1, parts)})
    return out


def _place(frame: DataFrame, cuts: str, feature: str, out: str) -> DataFrame:
    """``frame`` with the number of the part that a feature lies in."""
    return frame.withColumn(out, F.size(F.filter(cuts, lambda c: c <= F.col(feature))))


def _in_blocks(patterns: DataFrame, routing: Routing, block_cells: int) -> tuple[DataFrame, list[Block]]:
    """Patterns with ``_block``, and the blocks: slabs of the first feature, cut again by the second one.

    The cuts are one row per length (or one in all), so placing a pattern is a join on its length.
    """
    spark = patterns.sparkSession
    first, second = routing.features(patterns)
    marked = patterns.withColumns({"_f1": first, "_f2": second, "_group": F.col("length") if routing.by_length else F.lit(-1)})
    weight = F.sum(F.size("values").cast("long") + ROW_CELLS)
    sizes = {r["_group"]: r["n"] for r in marked.groupBy("_group").agg(weight.alias("n")).collect()}
    blocks_of = {n: min(FINEST, math.ceil(size / block_cells)) for n, size in sizes.items()}
    slabs_of = {n: math.ceil(math.sqrt(k)) for n, k in blocks_of.items()}
    slabs = {n[0]: cuts for n, cuts in _cuts_of(marked, ["_group"], "_f1", {(n,): k for n, k in slabs_of.items()}).items()}
    table = spark.createDataFrame([(n, slabs.get(n, [])) for n in sizes], "_group int, _slabs array<double>")
    marked = _place(marked.join(F.broadcast(table), "_group"), "_slabs", "_f1", "_slab").drop("_slabs")
    wanted = {(n, s): math.ceil(blocks_of[n] / (len(slabs.get(n, [])) + 1)) for n in sizes for s in range(len(slabs.get(n, [])) + 1)}
    parts = _cuts_of(marked, ["_group", "_slab"], "_f2", wanted)
    blocks: list[Block] = []
    rows = []
    for n in sorted(sizes):
        ends = [-math.inf, *slabs.get(n, []), math.inf]
        for s, (low, high) in enumerate(zip(ends, ends[1:])):
            cuts = parts.get((n, s), [])
            rows.append((n, s, cuts, len(blocks)))
            inner = [-math.inf, *cuts, math.inf]
            for below, above in zip(inner, inner[1:]):
                blocks.append(Block(len(blocks), n if routing.by_length else None, (low, below), (high, above)))
    table = spark.createDataFrame(rows, "_group int, _slab int, _cuts array<double>, _base int")
    placed = _place(marked.join(F.broadcast(table), ["_group", "_slab"]), "_cuts", "_f2", "_part")
    placed = placed.withColumn("_block", F.col("_base") + F.col("_part"))
    return placed.drop("_f1", "_f2", "_group", "_slab", "_cuts", "_base", "_part"), blocks


def _score_routed(rows, patterns, over_block, schema, routing: Routing, block_cells: int) -> DataFrame:
    """Each row against the blocks of patterns it can reach.

    Blocks that are too heavy because many patterns share their features, and the rows of a block, are dealt to
    salted groups, so that a group stays bounded; the weights are counted first.
    """
    spark = rows.sparkSession
    placed, blocks = _in_blocks(patterns, routing, block_cells)
    routed = routing.route(rows, blocks)

    def weights(frame: DataFrame, name: str) -> DataFrame:
        heavy = F.sum(F.size("values").cast("long") + ROW_CELLS)
        return frame.groupBy("_block").agg(F.ceil(heavy / block_cells).cast("int").alias(name))

    # one row per block that both sides have
    parts = F.broadcast(spark.createDataFrame(weights(placed, "_pattern_parts").join(weights(routed, "_row_parts"), "_block").toArrow()))

    def dealt(frame: DataFrame, own: str, other: str) -> DataFrame:
        key = F.xxhash64(*[c for c in frame.columns if not c.startswith("_")])
        return (
            frame.join(parts, "_block")
            .withColumn(own, F.pmod(key, F.col(f"{own}_parts")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)))
            .drop("_row_parts", "_pattern_parts")
        )

    group = ["_block", "_row", "_pattern"]
    left = dealt(routed, "_row", "_pattern").groupBy(*group)
    return left.cogroup(dealt(placed, "_pattern", "_row").groupBy(*group)).applyInArrow(over_block, schema)


def score(
    rows: DataFrame,
    patterns: DataFrame | pa.Table,
    prepare: Prepare,
    result: pa.Schema,
    combine: Callable[[DataFrame], DataFrame] | None = None,
    routing: Routing | None = None,
    broadcast_cells: int = BROADCAST_CELLS,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``prepare(patterns)`` applied to all rows, for all patterns.

    ``rows`` needs columns ``series_id`` and ``values``; ``patterns`` needs ``values``. When
    the patterns come in several blocks, ``combine`` merges what the blocks found, and ``routing`` tells
    which rows meet which blocks (patterns need ``length`` then); without it all do. Patterns given as an Arrow table are on the driver already, and go to all tasks.
    """
    schema = from_arrow_schema(result)
    local = patterns if isinstance(patterns, pa.Table) else None
    size = 0 if local is not None else cells(patterns)
    if local is not None or size <= broadcast_cells:
        shared = rows.sparkSession.sparkContext.broadcast(_to_bytes(patterns.toArrow() if local is None else local))

        def over_batches(batches):
            function = prepare(_from_bytes(shared.value))
            for batch in batches:
                for piece in pieces(batch):
                    # one batch out per piece: results come as many small tables
                    yield from function(piece).combine_chunks().to_batches()

        return rows.mapInArrow(over_batches, schema)

    def over_block(some: pa.Table, against: pa.Table) -> pa.Table:
        if not len(some) or not len(against):
            return result.empty_table()
        function = prepare(against)
        parts = [function(piece) for batch in some.combine_chunks().to_batches() for piece in pieces(batch)]
        return pa.concat_tables(parts).combine_chunks() if parts else result.empty_table()

    if routing is not None:
        scored = _score_routed(rows, patterns, over_block, schema, routing, block_cells)
        return scored if combine is None else combine(scored)

    pattern_blocks = math.ceil(size / block_cells)
    # enough groups for every core, at least
    cores = rows.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(math.ceil(cells(rows) / block_cells), math.ceil(2 * cores / pattern_blocks))

    def block(frame: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        key = F.xxhash64(*[c for c in frame.columns if not c.startswith("_")])
        return frame.withColumn(own, F.pmod(key, F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    left = block(rows, "_row", row_blocks, "_pattern", pattern_blocks)
    right = block(patterns, "_pattern", pattern_blocks, "_row", row_blocks)

    scored = (
        left.groupBy("_row", "_pattern")
        .cogroup(right.groupBy("_row", "_pattern"))
        .applyInArrow(over_block, schema)
    )
    return scored if combine is None else combine(scored)


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()
