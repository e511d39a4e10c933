"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits, each read as a word of the
perfect (23, 12) Golay code. Two fingerprints that differ in at most three bits have two segments that
differ in at most one bit each. Every 23-bit word lies within three bits of exactly one codeword, and the
index of that codeword is the segment's key. A segment also takes the indices of the codewords of its
one-bit neighbours, as far as they are larger than its own: of two words one bit apart, the one with the
smaller index then has the other's index too. The keys of two segments together are one join key, so
each fingerprint has some thirty keys of 24 bits, and every linked pair shares one.

The join sorts (key, fingerprint) rows inside hash partitions and verifies the fingerprints of one key by
exact bit counts. Of each key only a spanning forest of its links leaves the task, never all pairs: a
fingerprint found linked to the forest is not compared again with its other members. Keys with more than
HOT_KEY distinct fingerprints are cut into blocks, each two of which meet in a group of their own.
Copies of one text never meet: links are sought between distinct fingerprints.

Defined cases: a null text or one without words has fingerprint zero, which links like any other; a text
with fewer words than a shingle has one shingle, its whole sequence; rows without document id take part,
but do not name a component (null if no row of it has an id); repeated rows get the same result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import materialise
from .columns import append_columns, column, free, texts_of
from .components import connected_components

DISTANCE = 3  # differing bits of a link; the keys are made for this
HOT_KEY = 20_000  # distinct fingerprints that one group compares at most; larger ones are cut into blocks
SMALL_RUN = 24  # up to this size, the fingerprints of a key are compared by shifts of whole batches
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and length
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 makes the (23, 12) code


# --- fingerprints ------------------------------------------------------------------------------


def shingle_hashes(text: str, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words of a text, A-Z lower-cased, joined by blanks."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1 :].tolist()
    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: len(last)].tolist(), last)]
    return np.array(hashes, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # long texts in bounded pieces
        block = np.ascontiguousarray(hashes[at : at + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a (signed) long."""

    def make():
        def work(batch):
            prints = [fingerprint(shingle_hashes(t)) for t in texts_of(batch, "text")]
            return [pa.array(np.array(prints, np.uint64).view(np.int64))]

        return work

    return append_columns(docs, text, T.StructType([T.StructField(out, T.LongType())]), make, keep)


def hexadecimal(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- Golay keys --------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 12-bit and 11-bit halves of a word, and the error pattern of each syndrome."""

    def syndrome(word):
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [syndrome(1 << bit) for bit in range(23)]

    def sums(bits):
        out = np.zeros(1, np.int64)
        for s in bits:
            out = np.concatenate([out, out ^ s])
        return out

    errors = np.zeros(2048, np.int64)
    for a in range(23):
        errors[single[a]] = 1 << a
        for b in range(a):
            errors[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
    return np.concatenate([sums(single[:12]), sums(single[12:])]), errors


def codeword_index(word: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    halves, errors = _golay()
    return (word ^ errors[halves[word & 4095] ^ halves[4096 + (word >> 12)]]) >> 11


def segment_keys(word: np.ndarray, bits: int) -> np.ndarray:
    """Per word its index and the larger indices of its one-bit neighbours, ascending; -1 fills the rest."""
    own = codeword_index(word)
    near = codeword_index(word[:, None] ^ (1 << np.arange(bits)))
    all_keys = np.sort(np.concatenate([own[:, None], np.where(near > own[:, None], near, own[:, None])], axis=1), axis=1)
    all_keys[:, 1:][all_keys[:, 1:] == all_keys[:, :-1]] = -1
    return all_keys


def join_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all join keys of unsigned fingerprints."""
    per_segment = []
    for first, bits in SEGMENTS:
        word = (prints >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
        per_segment.append(segment_keys(word, bits))
    rows, keys = [], []
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        row_a, at_a = np.nonzero(per_segment[a] >= 0)
        key_a = per_segment[a][row_a, at_a]
        row_b, at_b = np.nonzero(per_segment[b] >= 0)
        key_b = per_segment[b][row_b, at_b]
        # each key of segment a with each of segment b, row by row
        many = np.bincount(row_b, minlength=len(prints))
        first = np.cumsum(many) - many
        times = many[row_a]
        ends = np.cumsum(times)
        inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - times, times)
        other = np.repeat(first[row_a], times) + inside
        rows.append(np.repeat(row_a, times))
        keys.append(number << 24 | np.repeat(key_a, times) << 12 | key_b[other])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(prints: DataFrame) -> DataFrame:
    """(key, fp) rows of distinct fingerprints (column ``fp``)."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                fp = whole.column(0).slice(start, 4096).to_numpy(zero_copy_only=False)
                rows, keys = join_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


# --- links -------------------------------------------------------------------------------------


def _forest(prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among unsigned fingerprints."""
    found, roots = [], []
    rest = prints
    while len(rest):
        root, rest = rest[0], rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            some, front = front[:64], front[64:]
            near = (np.bitwise_count(some[:, None] ^ rest[None, :]) <= DISTANCE).any(axis=0)
            if near.any():
                fresh, rest = rest[near], rest[~near]
                found.append(fresh)
                roots.append(np.full(len(fresh), root))
                front = np.concatenate([front, fresh])
    return found, roots


def _links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    """Links inside each run of equal keys: all of a small run, a spanning forest of a large one."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [], []
    for start, size in zip(starts[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist()):
        found, roots = _forest(prints[start : start + size])
        left += found
        right += roots
    small = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
    key, fp = keys[small], prints[small]
    for shift in range(1, min(SMALL_RUN, len(key))):
        same = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same + shift] ^ fp[same]) <= DISTANCE]
        left.append(fp[near + shift])
        right.append(fp[near])
    none = np.zeros(0, np.uint64)
    u, v = np.concatenate([none, *left]), np.concatenate([none, *right])
    if len(u):  # the same link often shows under several keys
        u, v = np.unique(np.stack([u, v], axis=1), axis=0).T
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (u, v)], names=["u", "v"]
    )


def _linked(rows: DataFrame, group: list[str]) -> DataFrame:
    """Links between the fingerprints of each group; a group lies in one task and is bounded by HOT_KEY."""
    number = F.col(group[0]) if len(group) == 1 else F.xxhash64(*group)
    ordered = rows.select(number.alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        keys, prints, waiting = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy(zero_copy_only=False))
            prints.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            waiting += batch.num_rows
            if waiting < 100_000:
                continue
            key, fp = np.concatenate(keys), np.concatenate(prints)
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
            if cut:
                yield _links(key[:cut], fp[:cut])
            keys, prints, waiting = [key[cut:]], [fp[cut:]], 0
        if keys:
            key, fp = np.concatenate(keys), np.concatenate(prints)
            if len(key):
                yield _links(key, fp)

    return ordered.mapInArrow(run, "u long, v long")


def links(prints: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column ``fp``) within DISTANCE bits of each other.

    Their connected components are those of all such pairs.
    """
    rows = keyed(prints)
    counts = rows.groupBy("key").count().where(F.col("count") > hot_key)
    hot = materialise(counts.select("key", F.ceil(F.col("count") / (hot_key / 2)).cast("int").alias("blocks")), "hot-keys")
    if hot.isEmpty():
        return _linked(rows, ["key"]).distinct()
    plain = _linked(rows.join(hot, "key", "left_anti"), ["key"])
    # a hot key: its fingerprints are dealt to blocks, and block i meets block j in the group (i, j), i <= j
    dealt = rows.join(hot, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp"
    )
    return plain.unionByName(_linked(pairs, ["key", "i", "j"])).distinct()


def _grouped(docs: DataFrame, text: str, doc_id: str, hot_key: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, tie (a hash of the text), fp, root (a fingerprint of the component)
    and component_id."""
    chosen = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    printed = materialise(fingerprints(chosen, keep=["doc_id", "tie"]), "fingerprints")
    firsts = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    parts = materialise(connected_components(links(firsts, hot_key), "fp", "root"), "fingerprint-components")
    # only fingerprints with links need the join; the others name their own smallest document
    least = parts.join(firsts, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = (
        firsts.join(parts, "fp", "left")
        .join(least, "root", "left")
        .select(
            "fp",
            F.coalesce("root", "fp").alias("root"),
            F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    return printed.join(named, "fp").select("doc_id", "tie", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot_key: int = HOT_KEY) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id reachable through links)."""
    return _grouped(docs, text, doc_id, hot_key).select("doc_id", "fp", "component_id")


def copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot_key: int = HOT_KEY) -> DataFrame:
    """(tie, root) of every row of ``docs``: a hash of its text, and a fingerprint that names its component."""
    return _grouped(docs, text, doc_id, hot_key).select("tie", "root")


def first_rows(docs: DataFrame, found: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of ``docs`` that come first in their root, as ``found`` (doc_id, tie, root) names it."""
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("best"))
    own, of, mark = (free(docs, n) for n in ("__tie", "__of", "__mark"))
    stay = best.select(F.col("best.doc_id").alias(of), F.col("best.tie").alias(mark))
    marked = docs.withColumn(own, F.xxhash64(column(text)))
    same = column(doc_id).eqNullSafe(F.col(of)) & (F.col(own) == F.col(mark))
    return marked.join(stay, same, "left_semi").dropDuplicates([doc_id, own]).drop(own)


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot_key: int = HOT_KEY) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Between rows of one id a hash of the text decides; rows without id stay only where no other row does.
    """
    return first_rows(docs, _grouped(docs, text, doc_id, hot_key), text, doc_id)
