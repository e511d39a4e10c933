"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt to files by ranges of document id and sorted inside each file, so files, stripes
and row groups cover narrow id ranges: a look-up by id skips files and stripes by their statistics and
row groups by the Bloom filter. Stripes are independent units of reading, so one file can be read by
several tasks. Every row carries its file's number and the count of ids before it in that file; the
count before the file comes from one sum per file.

Defined cases: a null text has only the end id; rows without document id come first; rows with the
same document id follow each other by the hash of their text, so copies are dealt to several files.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .columns import append_columns, column
from .words import Numbers, WordIds, id_lists, spans

SLICE_BYTES = 4 << 20  # larger slices repeat more of their words
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


@lru_cache(maxsize=1)
def tokenizer_of(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


# a run of letters and the marks after it; both are words of their own to this kind of tokenizer
_SPLIT = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,./:;=?@|~-]*)")
END = "\n"  # stands for the end id; no word holds a line end
JOINED = 50  # letter runs per text handed to the library


class StretchEncoder:
    """Ids of the stretches between blanks, from the tokenizer's own library.

    For tokenizers that split at white space and drop it, lower-case, keep runs of letters apart from
    runs of marks, and close every word by a token that ends in their word-end suffix. Lower-case runs of
    Latin letters are left as they are by normalising, so they go to the library's model many at a
    time, split at blanks only; all else takes the tokenizer's whole way.
    """

    def __init__(self, definition: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = tokenizer_of(definition)
        self.letters = Tokenizer.from_str(definition)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix = self.whole.model.end_of_word_suffix
        self.closes = np.zeros(self.whole.get_vocab_size(), bool)
        self.closes[[i for token, i in self.whole.get_vocab().items() if token.endswith(suffix)]] = True
        self.end_id = end_id

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        return flat, np.fromiter(map(len, ids), np.int64, len(ids))

    def _letter_runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        none = np.zeros(0, np.int32)
        flat = np.concatenate([none, *(np.array(e.ids, np.int32) for e in self.letters.encode_batch_fast(joined, add_special_tokens=False))])
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(words):  # not a tokenizer of this kind
            return self._each(words)
        return flat, np.diff(ends, prepend=0)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters, others = Numbers(), Numbers()
        parts, owner = [], []  # letter runs count from 0 up, other parts from -1 down
        for i, word in enumerate(words):
            if word == END:
                continue
            split = _SPLIT.fullmatch(word)
            if split:
                parts.append(letters[split[1].lower()])
                owner.append(i)
                word = split[2]
            if word:
                parts.append(-1 - others[word])
                owner.append(i)
        flat, sizes = self._letter_runs(list(letters))
        more, more_sizes = self._each(list(others))
        starts = np.cumsum(sizes) - sizes
        more_starts = len(flat) + np.cumsum(more_sizes) - more_sizes
        part, owner = np.array(parts, np.int64), np.array(owner, np.int64)
        # the other parts stand at the end in reverse, so that -1 is the first of them
        starts, sizes = np.concatenate([starts, more_starts[::-1]])[part], np.concatenate([sizes, more_sizes[::-1]])[part]
        lengths = np.bincount(owner, weights=sizes, minlength=len(words)).astype(np.int64)
        out = np.concatenate([flat, more])[spans(starts, sizes)]
        if END in words:
            at = words.index(END)
            out = np.insert(out, int(lengths[:at].sum()), self.end_id)
            lengths[at] = 1
        return out, lengths


@lru_cache(maxsize=1)
def encoder_of(definition: str, end_id: int) -> WordIds:
    """The encoder of this Python worker; what it remembers serves all tasks that the worker runs."""
    return WordIds(StretchEncoder(definition, end_id))


# special tokens are told apart by case, and a letter and its mark may be composed in one case only
_CASED = "<\\||[\u0300-\u036f]"


def stretches(texts: pa.Array) -> pa.Array:
    """Texts as stretches between blanks, closed by END; A-Z in lower case unless their case may matter."""
    texts = pc.fill_null(texts, "")
    lowered = pc.if_else(pc.match_substring_regex(texts, _CASED), texts, pc.ascii_lower(texts))
    return pc.binary_join_element_wise(pc.replace_substring(lowered, "\n", " "), END, " ")


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens``, the task's number ``file_no`` and ``offset``, the ids before the row in its task."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    fields = T.StructType(
        [
            T.StructField("file_no", T.IntegerType()),
            T.StructField("offset", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )

    def make():
        encoder = encoder_of(definition.value, end_id)
        number = TaskContext.get().partitionId()
        before = 0

        def work(batch):
            nonlocal before
            flat, lengths = encoder(stretches(batch.column(batch.schema.get_field_index("text"))))
            offsets = before + np.cumsum(lengths) - lengths
            before += len(flat)
            return [pa.array(np.full(len(lengths), number, np.int32)), pa.array(offsets), pa.array(lengths), id_lists(flat, lengths)]

        return work

    return append_columns(docs, text, fields, make, keep, SLICE_BYTES)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write the ids of all documents as ORC files at ``path``, in ascending order of document id."""
    chosen = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = chosen.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    encoded(ordered, tokenizer_path, end_id, keep=["doc_id"]).write.options(**ORC_OPTIONS).orc(path)


SCHEMA = "doc_id long, file_no int, offset long, n_tokens long, ids array<int>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files as doc_id, start (ids of all documents before it), n_tokens and ids.

    The joined side has one row per file.
    """
    files = spark.read.schema(SCHEMA).orc(path)
    totals = files.groupBy("file_no").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(bases), "file_no").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The stored ids of some documents; file, stripe and Bloom filter metadata keep the rest unread."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def checksums(df: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """``df`` with the CRC-32 of each id array as little-endian unsigned 32-bit integers instead of the array."""
    carried = [c for c in df.columns if c not in (ids, out)]
    schema = T.StructType([df.schema[c] for c in carried]).add(out, T.LongType())

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            data = np.asarray(lists.flatten()).astype("<u4", copy=False)
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), dtype=np.int64)
            view = memoryview(np.ascontiguousarray(data)).cast("B")
            sums = [zlib.crc32(view[a * 4 : b * 4]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums, pa.int64())], names=[*carried, out])

    return df.mapInArrow(run, schema)
