"""What the scoring join hands to its kernels."""

import pyarrow as pa

from warpwise.operators import scoring

SEEN = pa.schema([("rows", pa.int64()), ("bytes", pa.int64())])


def test_kernels_take_bounded_pieces(spark):
    """A kernel took whole Arrow batches of 10,000 rows before, however wide the rows."""
    schema = SEEN

    def noting(table):
        return lambda batch: pa.table([pa.array([batch.num_rows]), pa.array([batch.nbytes])], schema=schema)

    rows = spark.range(0, 20_000, 1, 2).selectExpr("'s' series_id", "array_repeat(cast(id as double), 200) values")
    for patterns, limits in ((pa.table({"values": [[1.0]]}), {}), (rows.limit(3), {"broadcast_cells": 0, "block_cells": 4_000_000})):
        seen = scoring.score(rows, patterns, noting, SEEN, **limits).collect()
        blocks = max(1, sum(r["rows"] for r in seen) // 20_000)
        assert sum(r["rows"] for r in seen) == 20_000 * blocks
        assert max(r["bytes"] for r in seen) <= 1.1 * scoring.PIECE_BYTES < 10_000 * 200 * 8


def test_pieces_keep_every_row():
    batch = pa.record_batch({"values": [[float(i)] * (i % 5) for i in range(1000)]})
    for size in (1, 100, 1 << 30):
        assert pa.Table.from_batches(scoring.pieces(batch, size)).equals(pa.Table.from_batches([batch]))
    assert not list(scoring.pieces(batch.slice(0, 0)))
