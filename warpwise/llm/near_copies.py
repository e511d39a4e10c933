"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A text is the set of XXH64 hashes of its runs of five words. Texts of one set are one node, so copies
never meet. Each node has a MinHash signature of BANDS x ROWS numbers; nodes that agree in all ROWS
numbers of a band share that band's key. A pair of similarity s shares one with probability
1 - (1 - s ** ROWS) ** BANDS: all but about 1 of 80,000 pairs at 0.8, and practically all above. That is the
only place where a pair can be lost.

The nodes of a key are tied to its smallest one, in rows of two numbers, and the connected components of
these ties are the groups in which near copies are sought. Only the texts of such groups are shingled
again. A group is compared in one task on the shingle sets themselves; one of more than BLOCK_SHINGLES
shingles is cut into blocks, each two of which meet in a group of their own. Of each group only a spanning
forest of its links leaves the task. The connected components of the links are the groups of near copies.
Groups of texts that operator 8 found by its fingerprints can be given; they link their nodes as well.

Defined cases: a null text or one without words has the empty set, and all of these are copies; a text with
fewer words than a shingle has one shingle, its whole sequence; rows without document id take part; of
repeated rows one stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import materialise
from .columns import append_columns, column, texts_of
from .components import connected_components
from .simhash import first_rows, shingle_hashes

WORDS = 5
SIMILARITY = (4, 5)  # at least 4 of 5 shingles of the union are shared
BANDS, ROWS = 48, 7
BLOCK_SHINGLES = 1_000_000  # shingles of a block; a task holds two blocks at once
PIECE = 512  # shingles permuted at once

_random = np.random.default_rng(20240608)
_FACTOR = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ROW = _random.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _random.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, WORDS))


def node_of(hashes: np.ndarray) -> int:
    """A signed number that names a shingle set."""
    from xxhash import xxh64_intdigest

    return int(np.array(xxh64_intdigest(hashes.tobytes()), np.uint64).view(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The key of each band of a shingle set; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), PIECE):
        np.minimum(least, (_FACTOR[:, None] * folded[at : at + PIECE] + _SHIFT[:, None]).min(axis=1), out=least)
    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) * _ROW).sum(axis=1, dtype=np.uint64) ^ _BAND
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)])
    values = np.concatenate([np.zeros(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, node, bands) of docs (doc_id, tie, text)."""

    def make():
        def work(batch):
            sets = [shingle_set(t) for t in texts_of(batch, "text")]
            return [pa.array([node_of(s) for s in sets], pa.int64()), _lists([band_keys(s) for s in sets])]

        return work

    fields = T.StructType([T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return append_columns(docs, "text", fields, make, ["doc_id", "tie"])


def sets_of(texts: DataFrame) -> DataFrame:
    """(node, part, hashes) of texts (node, part, text)."""

    def make():
        def work(batch):
            return [_lists([shingle_set(t).view(np.int64) for t in texts_of(batch, "text")])]

        return work

    return append_columns(texts, "text", T.StructType([T.StructField("hashes", T.ArrayType(T.LongType()))]), make, ["node", "part"])


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the links among distinct non-empty sets."""
    good, whole = SIMILARITY
    sizes = np.array([len(s) for s in sets], np.int64)
    names, number = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(number, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(names), bool)
    found = []
    rest = np.argsort(sizes, kind="stable")
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            # only sets of near sizes can be similar
            low = np.searchsorted(sizes[rest], -(-good * sizes[one] // whole))
            high = np.searchsorted(sizes[rest], whole * sizes[one] // good, side="right")
            if low == high:
                continue
            some = rest[low:high]
            mark[parts[one]] = True
            shared = np.add.reduceat(mark[np.concatenate([parts[k] for k in some])].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            mark[parts[one]] = False
            near = whole * shared >= good * (sizes[one] + sizes[some] - shared)
            front += some[near].tolist()
            found += [(int(one), int(k)) for k in some[near]]
            rest = np.concatenate([rest[:low], some[~near], rest[high:]])
    return found


def _linked(rows: DataFrame) -> DataFrame:
    """Links between the nodes of each group (group, node, hashes); a group lies in one task."""
    ordered = rows.repartition("group").sortWithinPartitions("group")

    def links(nodes, sets):
        pairs = forest(sets) if len(sets) > 1 else []
        u, v = ([nodes[p[side]] for p in pairs] for side in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches):
        group, nodes, sets = None, [], []
        for batch in batches:
            hashes = batch.column(2)
            for k, (g, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if g != group:
                    if len(sets) > 1:
                        yield links(nodes, sets)
                    group, nodes, sets = g, [], []
                nodes.append(node)
                sets.append(hashes[k].values.to_numpy(zero_copy_only=False).copy())
        if len(sets) > 1:
            yield links(nodes, sets)

    return ordered.select("group", "node", "hashes").mapInArrow(run, "u long, v long")


def links(docs: DataFrame, printed: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (u, v) between the nodes of ``printed`` (tie, node, bands) that hold near copies.

    ``docs`` (tie, text) has the texts.
    """
    nodes = printed.groupBy("node").agg(F.min(F.struct("tie", "bands")).alias("one")).select("node", "one.tie", "one.bands")
    nodes = materialise(nodes, "shingle-nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    ties = keys.join(shared, "key").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    parts = materialise(connected_components(ties, "node", "part"), "candidate-groups")
    wanted = materialise(nodes.select("node", "tie").join(parts, "node"), "candidate-texts")
    texts = docs.join(wanted, "tie").groupBy("node", "part").agg(F.first("text").alias("text"))
    sets = materialise(sets_of(texts), "shingle-sets")
    sizes = sets.groupBy("part").agg(F.sum(F.size("hashes")).alias("all")).where(F.col("all") > block_shingles)
    large = materialise(sizes.select("part", F.ceil(2 * F.col("all") / block_shingles).cast("int").alias("blocks")), "large-groups")
    plain = sets.join(large, "part", "left_anti").select(F.col("part").alias("group"), "node", "hashes")
    found = _linked(plain)
    if not large.isEmpty():
        dealt = sets.join(large, "part").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        group = F.xxhash64("part", F.least("block", "other"), F.greatest("block", "other"))
        found = found.unionByName(_linked(pairs.select(group.alias("group"), "node", "hashes")))
    return found.distinct()


def ties_of(printed: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (u, v) between the nodes of ``printed`` (tie, node) that lie in one of the ``groups`` (tie, root)."""
    grouped = printed.join(groups.distinct(), "tie").select("root", "node").distinct()
    least = grouped.groupBy("root").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("root", "low")
    return grouped.join(least, "root").where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v"))


def one_of_each(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_shingles: int = BLOCK_SHINGLES, groups: DataFrame | None = None
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group, connected by links, the row with the smallest doc_id stays.

    ``groups`` (tie, root) are texts, by their XXH64 as Spark has it, that another operator found to be copies; they link too.
    Between rows of one id a hash of the text decides; rows without id stay only where no other row does.
    """
    chosen = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    printed = materialise(signed(chosen), "shingle-signatures")
    found = links(chosen.select("tie", "text"), printed, block_shingles)
    if groups is not None:
        found = found.unionByName(ties_of(printed, groups))
    parts = materialise(connected_components(found, "node", "root"), "near-copies")
    found = printed.select("doc_id", "tie", "node").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return first_rows(docs, found, text, doc_id)
