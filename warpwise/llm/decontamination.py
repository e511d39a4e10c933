"""Benchmark decontamination: size-partitioned MinHash containment search, verified shingle by shingle.

Words are runs of letters, digits and characters beyond ASCII in the lower-cased text; a text is its set
of runs of five words. A document is contaminated by an item if it holds at least 0.8 of the item's
shingles, however long the document is.

Items are partitioned by the number of their shingles. An item with n shingles of which at most
(1 - 0.8) n are missing has one of any floor(0.2 n) + 1 of them in the document, so each partition keeps,
per item, the MinHash sketch of its floor(0.2 u) + 1 smallest shingle hashes, u being the partition's
largest size. The sketches of all partitions make one table that is searched for every shingle
hash of every document, in numpy over whole slices of text; a hit makes a candidate, and no match is
without one. Candidates are verified by comparing the shingles themselves.

The benchmark is a query set: it is taken in blocks of at most BLOCK_BYTES of text, measured first, and
each block is broadcast and searched for in one pass over all documents (one block is the usual case).

Defined cases: a text with fewer than five words has one shingle, its whole word sequence; a text
without words has none, and an item without shingles matches nothing; null texts are empty; repeated
items and documents each get their own matches; a further column named ``matches`` is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import materialise
from .columns import append_columns, column, free, texts_of

WORDS = 5
CONTAINMENT = (4, 5)  # at least 4 of 5 shingles
BLOCK_BYTES = 16 << 20  # benchmark text that is broadcast at once
PIECE_BYTES = 1 << 20  # text whose bytes are hashed at once

_RUN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_BASE, _SEED = 0x9E3779B97F4A7C15 | 1, 20240607


@lru_cache(maxsize=1)
def _tables():
    """A random 64-bit number for each byte, and which bytes belong to words."""
    numbers = np.random.default_rng(_SEED).integers(0, 1 << 63, 256, dtype=np.uint64)
    inside = np.array([b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" for b in range(256)])
    return numbers, inside


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2 ** 64, and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every shingle of lower-cased texts, repeats included."""
    numbers, inside = _tables()
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*encoded, b""]), np.uint8)
    all_starts, all_hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    at = 0
    while at < len(data):
        piece = data[at : at + PIECE_BYTES]
        if at + len(piece) < len(data):  # end at a gap between words; a longer word is a piece of its own
            gaps = np.flatnonzero(~inside[piece])
            if len(gaps):
                piece = piece[: gaps[-1] + 1]
            else:
                piece = data[at : at + len(piece) + int(np.argmin(inside[data[at + len(piece) :]])) + 1]
        word = inside[piece]
        edges = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        up, down = _powers(1 << max(20, (len(piece) - 1).bit_length()))  # few different tables
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers[piece] * up[: len(piece)], dtype=np.uint64)])
        all_hashes.append(_mixed((sums[ends] - sums[starts]) * down[starts]))
        all_starts.append(starts + at)
        at += len(piece)
    starts, hashes = np.concatenate(all_starts), np.concatenate(all_hashes)
    limits = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)
    owner = np.searchsorted(limits, starts, side="right")
    # runs of five words; a text with fewer has the run of all its words
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    runs = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(np.int64))
    of = np.repeat(np.arange(len(texts)), runs)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    length = np.minimum(counts, WORDS)[of]
    out = length.astype(np.uint64)
    for k in range(WORDS):
        more = length > k
        step = _mixed(out * np.uint64(_BASE) + hashes[np.minimum(at + k, max(len(hashes) - 1, 0))])
        out = np.where(more, step, out)
    return out, of


def shingles(text: str) -> set[str]:
    """The shingles of a lower-cased text."""
    words = _RUN.findall(text)
    if len(words) < WORDS:
        return {" ".join(words)} - {""}
    return {" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)}


def size_class(n: int) -> int:
    """Largest size of the partition that items with ``n`` shingles belong to."""
    return max(4, 1 << (n - 1).bit_length())


def sketch_size(largest: int) -> int:
    """How many of an item's smallest hashes are kept, for items of at most ``largest`` shingles."""
    good, whole = CONTAINMENT
    return (whole - good) * largest // whole + 1


class Index:
    """The sketches of a block of items, and the items' shingles."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        self.shingles = [shingles(t.lower()) for _, t in items]
        hashes, owner = shingle_hashes([t.lower() for _, t in items])
        keep_hash, keep_item = [], []
        order = np.lexsort([hashes, owner])
        hashes, owner = hashes[order], owner[order]
        for item in range(len(items)):
            own = np.unique(hashes[np.searchsorted(owner, item) : np.searchsorted(owner, item, side="right")])
            if len(own):
                kept = own[: sketch_size(size_class(len(self.shingles[item])))]
                keep_hash.append(kept)
                keep_item.append(np.full(len(kept), item))
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *keep_hash])
        self.items = np.concatenate([np.zeros(0, np.int64), *keep_item])
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.items = self.hashes[order], self.items[order]
        self.low = np.zeros(1 << 20, bool)  # a first look at 20 bits of a hash
        self.low[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def matches(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Per text the (item number, shared shingles) of the items it holds."""
        lowered = [t.lower() for t in texts]
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        hashes, owner = shingle_hashes(lowered)
        some = self.low[(hashes & np.uint64(0xFFFFF)).astype(np.int64)]
        hashes, owner = hashes[some], owner[some]
        first, last = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, side="right")
        hit = first < last
        pairs = {
            (text, item)
            for text, a, b in zip(owner[hit].tolist(), first[hit].tolist(), last[hit].tolist())
            for item in self.items[a:b].tolist()
        }
        good, whole = CONTAINMENT
        known: dict[int, set[str]] = {}
        for text, item in sorted(pairs):
            if text not in known:
                known = {text: shingles(lowered[text])}
            shared = len(self.shingles[item] & known[text])
            if whole * shared >= good * len(self.shingles[item]):
                out[text].append((item, shared))
        return out


MATCHES = T.ArrayType(
    T.StructType(
        [T.StructField("item_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())]
    )
)


def indexes(items: DataFrame):
    """The broadcast index of each block of ``items`` (item_id, text); one after the other comes to the driver."""
    asked = items.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1  # half full on average, as a hash deals them out
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else asked
        rows = sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield items.sparkSession.sparkContext.broadcast(Index(rows))


def with_matches(docs: DataFrame, index, text: str = "text", out: str = "matches", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the array ``out`` of the items of a broadcast index that each document holds."""

    def make():
        items = index.value

        def search(batch):
            ids, sizes, shared, offsets = [], [], [], [0]
            for matched in items.matches(texts_of(batch, "text")):
                for item, common in matched:
                    ids.append(items.ids[item])
                    sizes.append(len(items.shingles[item]))
                    shared.append(common)
                offsets.append(len(ids))
            values = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, sizes, shared)], ["item_id", "n_shingles", "n_shared"]
            )
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]

        return search

    return append_columns(docs, text, T.StructType([T.StructField(out, MATCHES)]), make, keep, PIECE_BYTES)


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of all documents and the items they hold.

    Each block of items is one pass over the documents.
    """
    chosen = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    passes = [
        with_matches(chosen, index, keep=["doc_id"]).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
        for index in indexes(items)
    ]
    pairs = reduce(DataFrame.unionByName, passes)
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with their columns; what one block of items leaves is written for the next."""
    mark, left = free(docs, "__matches"), docs
    for number, index in enumerate(indexes(items)):
        left = materialise(left, "decontaminated") if number else left
        left = with_matches(left, index, text, out=mark).where(F.size(mark) == 0).drop(mark)
    return left
