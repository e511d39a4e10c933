"""Token counts from flat, unindexed token files by a separator scan.

A token file is nothing but little-endian unsigned 16-bit ids, each document closed by the end id. Files
are cut into blocks of BLOCK_TOKENS; numpy finds the end ids of each block on its own. What the blocks
know only together - how many documents and which end id came before - is one row per block, put
in order by a prefix scan over the blocks of a file; then every document's place and length follow.

Files are written by Spark's text writer, one row to a file: a row is the ids of a run of documents of at most
FILE_BYTES (one longer document is a run of its own), with the end id between them and, as the writer's line
separator, after the last one. The row after it, and so the file after it, holds the run's document ids. Both
files come from one task and one pass over the documents, so ids and tokens belong together however the
documents are read, and the second and further attempts of a task replace both.

Defined cases: a null or empty text is a document without tokens; ids after the last end id of a file
are a document that is not terminated; a file without any id holds no document; repeated rows are
documents of their own; document ids may be null and of any type that a cast to string and back keeps.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..runtime import materialise
from .columns import column, slices, texts_of
from .sentencepiece_bpe import CACHED_WORDS, model_of, read_model, spaced
from .words import WordIds

BLOCK_TOKENS = 1 << 19
FILE_BYTES = 8 << 20  # of one token file, unless a single document is longer
TOKEN_FILES, ID_FILES = "part-*-c*[02468].*", "part-*-c*[13579].*"  # a task's files take turns


def _runs(batches, encoder: WordIds, end_id: int, file_bytes: int):
    """Arrow batches of one column: the tokens of a run of documents, then their ids as a JSON list."""
    separator = np.array([end_id], "<u2").tobytes()
    tokens, ids, held = [], [], 0

    def run():
        return pa.RecordBatch.from_arrays([pa.array([separator.join(tokens), json.dumps(ids).encode()], pa.binary())], names=["value"])

    for part in slices(batches, "text"):
        flat, lengths = encoder([spaced(t) for t in texts_of(part, "text")])
        if len(flat) and (flat.max() >= 1 << 16 or (flat == end_id).any()):
            raise ValueError("ids must fit 16 bits and leave out the end id")
        data = flat.astype("<u2").tobytes()
        at = 0
        for doc_id, length in zip(part.column(0).to_pylist(), (2 * lengths).tolist()):
            size = length + 2 + len(doc_id or "")  # the ids count too, as texts may be empty
            if ids and held + size > file_bytes:
                yield run()
                tokens, ids, held = [], [], 0
            tokens.append(data[at : at + length])
            ids.append(doc_id)
            held += size
            at += length
    if ids:
        yield run()


def write_token_files(
    docs: DataFrame, path: str, model_path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", file_bytes: int = FILE_BYTES
) -> None:
    """Encode all documents and write them as flat token files, and files of their ids, at ``path``."""
    proto = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def write(batches):
        yield from _runs(batches, WordIds(model_of(proto.value).merge, CACHED_WORDS), end_id, file_bytes)

    rows = docs.select(column(doc_id).cast("string").alias("doc_id"), column(text).cast("string").alias("text")).mapInArrow(write, "value binary")
    separator = int(end_id).to_bytes(2, "little").decode("ascii")
    rows.select(F.col("value").cast("string")).write.option("lineSep", separator).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def separators(spark: SparkSession, path: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS, files: str = "part-*") -> DataFrame:
    """One row per block of the files: file, block, tokens (end ids included), n_ends, first and last end
    (positions in the file) and the lengths of the documents that begin and end in the block."""
    width = 2 * block_tokens
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path)
    blocks = found.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"),
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / width).cast("int"))).alias("block"),
        "content",
    ).select("file", "block", F.substring("content", F.col("block") * width + 1, F.lit(width)).alias("bytes"))
    blocks = blocks.where("length(bytes) > 0")
    schema = "file string, block int, tokens long, n_ends long, first_end long, last_end long, lengths array<long>"

    def scan(batches):
        for batch in batches:
            rows = []
            for file, block, data in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                ends = np.flatnonzero(ids == end_id) + block * block_tokens
                first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (None, None)
                rows.append((file, block, len(ids), len(ends), first, last, np.diff(ends) - 1))
            fields = ("file", "block", "tokens", "n_ends", "first_end", "last_end", "lengths")
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64())))],
                names=list(fields),
            )

    return blocks.mapInArrow(scan, schema)


def documents_in(spark: SparkSession, path: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS, files: str = "part-*") -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document in the files, which are read once."""
    scanned = materialise(separators(spark, path, end_id, block_tokens, files), "token-blocks")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    placed = scanned.select(
        "*",
        F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("ends_before"),
        F.coalesce(F.last("last_end", ignorenulls=True).over(earlier), F.lit(-1)).alias("end_before"),
        F.count("*").over(later).alias("blocks_after"),
        (F.sum("tokens").over(earlier)).alias("tokens_before"),
    )
    # a block's documents: the one that its first end closes, then those inside
    found = placed.where("n_ends > 0").select(
        "file",
        "ends_before",
        F.posexplode(F.concat(F.array(F.col("first_end") - F.col("end_before") - 1), "lengths")).alias("at", "n_tokens"),
    )
    inside = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    closed = found.select("file", (F.col("ends_before") + F.col("at")).alias("ordinal"), "n_tokens", F.lit(True).alias("terminated"))
    tail = F.col("tokens") + F.coalesce("tokens_before", F.lit(0)) - 1 - F.coalesce("last_end", "end_before")
    open_end = placed.where("blocks_after = 0").select(
        "file", (F.col("ends_before") + F.col("n_ends")).alias("ordinal"), tail.alias("n_tokens"), F.lit(False).alias("terminated")
    )
    every = closed.unionByName(open_end.where("n_tokens > 0"))
    return every.select("file", "ordinal", F.coalesce(F.sum(F.col("n_tokens") + 1).over(inside), F.lit(0)).alias("start"), "n_tokens", "terminated")


def _run_of(file):
    """(task, run) in the name of a file: a run's tokens and ids are two files in a row."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("int").alias("task"), F.floor(F.regexp_extract(file, r"-c(\d+)\.", 1).cast("long") / 2).alias("run")


def ids_in(spark: SparkSession, path: str) -> DataFrame:
    """(task, run, ordinal, doc_id) of every document, from the files of ids; doc_id is a string."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", ID_FILES).load(path)
    # the writer closes a file by the two bytes of the end id
    text = F.substring("content", F.lit(1), F.length("content") - 2).cast("string")
    return files.select(*_run_of("path"), F.posexplode(F.from_json(text, "array<string>")).alias("ordinal", "doc_id"))


def token_counts(
    docs: DataFrame, path: str, model_path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write ``docs`` to token files at ``path`` and count them from there; ``docs`` is read once.

    One row per document: doc_id, task, run (both name its file), ordinal and start (in its file) and n_tokens.
    A document that the files lack, or a surplus one, raises.
    """
    write_token_files(docs, path, model_path, end_id, text, doc_id, file_bytes)
    found = documents_in(docs.sparkSession, path, end_id, files=TOKEN_FILES)
    found = found.select(*_run_of("file"), "ordinal", "start", "n_tokens", "terminated")
    both = ids_in(docs.sparkSession, path).withColumn("known", F.lit(True)).join(found, ["task", "run", "ordinal"], "full")
    wrong = F.col("known").isNull() | ~F.coalesce("terminated", F.lit(False))
    checked = F.when(wrong, F.raise_error(F.lit("token files and files of ids do not agree"))).otherwise(F.col("n_tokens"))
    kind = docs.select(column(doc_id)).schema[0].dataType
    return both.select(F.col("doc_id").cast(kind).alias("doc_id"), "task", "run", "ordinal", "start", checked.cast("long").alias("n_tokens"))
