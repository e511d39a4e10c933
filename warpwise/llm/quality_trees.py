"""A quality classifier: histogram gradient-boosted trees over document statistics.

Tasks turn each whole text into a row of statistics. A bounded sample of the labelled rows (TRAIN_ROWS,
drawn by a hash of the document id) comes to the driver and trains the trees in numpy; the fitted
trees are a few kilobytes. They are complete trees in flat arrays, so scoring walks all rows down one level
of one tree at a time, without branches.

Only statistics of the text are inputs of a score. Every fifth document by the CRC-32 of its id is held
out: its label is never learned from.

Defined cases: a null or empty text has the statistics of an empty text and gets a score like any
other; documents without id are not held out and have no label; rows of ``labels`` without id or quality
are left out, of several labels of one document the largest counts; without any label to learn
from, every score is one half, and with a single class it is that class's smoothed share.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import materialise
from .columns import append_columns, column, texts_of

TRAIN_ROWS = 20_000  # labelled rows to learn from, in expectation; fewer labels are all used
THRESHOLD = 0.3  # predicted 1 from this score on
TREES, DEPTH, RATE, BINS = 80, 4, 0.15, 64
LEAST_LEAF, L2 = 10.0, 1.0  # least sum of hessians times four in a leaf; shrinkage of leaf values

SYMBOLS = "#*$%&|<>"
STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "log_lines", "line_words", "upper", "digit", "blank", "symbol", "bang",
    "comma_stop", "other_mark", "beyond_ascii", "byte_entropy", "distinct_words", "touching_repeats", "top_word", "repeated_lines",
    "capital_words", "symbol_ends", "one_letter_words",
)

_CLASSES = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _at = (
        0 if "A" <= _c <= "Z" else 1 if "0" <= _c <= "9" else 2 if _c in " \t\n\r\v\f" else 3 if _c in SYMBOLS
        else 4 if _c == "!" else 5 if _c in ",." else 6 if _b < 128 and not _c.isalnum() else 7
    )
    if _at < 7 or _b >= 128:
        _CLASSES[_b, _at] = 1


def statistics(text: str) -> list[float]:
    """The values of STATISTICS for one text."""
    data = text.encode("utf-8", "surrogatepass")
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(len(data), 1)
    share = histogram[histogram > 0] / size
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    n, m = max(len(words), 1), max(len(lines), 1)
    counts = Counter(words)
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        max(map(len, words), default=0),
        np.log1p(len(lines)),
        len(words) / m,
        *(histogram @ _CLASSES / size),
        float(-(share * np.log2(share)).sum()),
        len(counts) / n,
        sum(map(eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n,
        1 - len(set(lines)) / m if lines else 0.0,
        sum(map(str.isupper, words)) / n,
        sum(w[-1] in SYMBOLS for w in words) / n,
        sum(map((1).__eq__, map(len, words))) / n,
    ]


def with_statistics(docs: DataFrame, text: str = "text", out: str = "statistics", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the statistics of ``text`` as an array."""

    def make():
        def work(batch):
            rows = np.array([statistics(t) for t in texts_of(batch, "text")], np.float32).reshape(-1, len(STATISTICS))
            return [pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATISTICS)).cast(pa.list_(pa.float32()))]

        return work

    return append_columns(docs, text, T.StructType([T.StructField(out, T.ArrayType(T.FloatType()))]), make, keep)


# --- the trees ---------------------------------------------------------------------------------


@dataclass
class Forest:
    """Complete trees of one depth: node ``i`` of a tree has the children ``2 i + 1`` and ``2 i + 2``."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; larger values go right
    leaf: np.ndarray  # trees x leaves

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        inner = self.feature.shape[1]
        depth = inner.bit_length()
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def _best_splits(codes, node, nodes, grad, hess):
    """Per node the feature and bin of the best split (bin BINS where none helps)."""
    best = np.zeros(nodes)
    feature, cut = np.zeros(nodes, np.int64), np.full(nodes, BINS)
    for f in range(codes.shape[1]):
        cell = node * BINS + codes[:, f]
        g = np.bincount(cell, grad, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
        h = np.bincount(cell, hess, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
        right_g, right_h = g[:, -1:] - g, h[:, -1:] - h
        gain = g**2 / (h + L2) + right_g**2 / (right_h + L2) - g[:, -1:] ** 2 / (h[:, -1:] + L2)
        gain[(h < LEAST_LEAF / 4) | (right_h < LEAST_LEAF / 4)] = 0
        at = gain.argmax(axis=1)
        value = gain[np.arange(nodes), at]
        better = value > best + 1e-12
        best[better], feature[better], cut[better] = value[better], f, at[better]
    return feature, cut


def train(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Fit the trees to labels 0 and 1 by second-order steps of the logistic loss."""
    ones = float(labels.sum())
    base = float(np.log((ones + 0.5) / (len(labels) - ones + 0.5)))
    inner = 2**DEPTH - 1
    if not 0 < ones < len(labels):
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    # bins end at quantiles of the sample; the last one has no end
    edges = [np.unique(np.quantile(rows[:, f], np.arange(1, BINS) / BINS)) for f in range(rows.shape[1])]
    codes = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    ends = np.full((rows.shape[1], BINS + 1), np.inf)
    for f, e in enumerate(edges):
        ends[f, : len(e)] = e
    margin = np.full(len(labels), base)
    features, cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - labels, p * (1 - p)
        node = np.zeros(len(labels), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            nodes, first = 2**level, 2**level - 1
            f, b = _best_splits(codes, node, nodes, grad, hess)
            feature[first : first + nodes], cut[first : first + nodes] = f, ends[f, b]
            node = 2 * node + (codes[np.arange(len(node)), f[node]] > b[node])
        g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
        leaf = -RATE * g / (h + L2)
        margin += leaf[node]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Forest(base, np.stack(features), np.stack(cuts), np.stack(leaves))


# --- on Spark ----------------------------------------------------------------------------------


def held_out(doc_id: str):
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(column(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality) of about ``rows`` labelled ids that are not held out; which ones, a hash of the id decides."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(~held_out("doc_id"))
    spread = 1 << 30
    share = min(1.0, rows / max(known.count(), 1))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < int(share * spread))


def fit(featured: DataFrame, chosen: DataFrame) -> Forest:
    """Train on the rows of ``featured`` (doc_id, statistics) whose ids are in the sample ``chosen``, which is brought to the driver.

    An id is one row, however many documents have it: the one with the smallest statistics.
    """
    joined = featured.select("doc_id", "statistics").join(chosen, "doc_id")
    found = joined.groupBy("doc_id").agg(F.min("statistics").alias("statistics"), F.min("quality").alias("quality")).toArrow()
    x = np.asarray(found["statistics"].combine_chunks().flatten(), np.float32).reshape(-1, len(STATISTICS)).astype(np.float64)
    y = np.asarray(found["quality"].combine_chunks(), np.float64)
    order = np.lexsort([*x.T, y, np.asarray(found["doc_id"].combine_chunks())])  # the same trees however rows arrive
    return train(x[order], y[order])


def scored(featured: DataFrame, forest: Forest, out: str = "score", drop: str = "statistics") -> DataFrame:
    """``featured`` with the score of its column ``statistics``, which is dropped."""
    carried = [c for c in featured.columns if c not in (out, drop)]
    schema = T.StructType([featured.schema[c] for c in carried]).add(out, T.DoubleType())

    def run(batches):
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(drop)).flatten()
            rows = np.asarray(values, np.float32).reshape(-1, len(STATISTICS)).astype(np.float64)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(forest.scores(rows))], names=[*carried, out])

    return featured.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Forest]:
    """The stored statistics of all documents (doc_id, statistics) and the trees fitted to their labels."""
    featured = materialise(with_statistics(docs, keep=["doc_id"]), "statistics")
    return featured, fit(featured, sample(labels))


def fitted(docs: DataFrame, labels: DataFrame) -> Forest:
    """The trees fitted to the labels of ``docs``; statistics are made of the sampled documents only."""
    chosen = materialise(sample(labels), "label-sample")
    # about TRAIN_ROWS ids
    some = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    return fit(with_statistics(some, keep=["doc_id"]), chosen)


def scored_texts(docs: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with all its columns and the score of ``text``."""

    def make():
        def work(batch):
            rows = np.array([statistics(t) for t in texts_of(batch, "text")], np.float32).reshape(-1, len(STATISTICS))
            return [pa.array(forest.scores(rows.astype(np.float64)))]

        return work

    return append_columns(docs, text, T.StructType([T.StructField(out, T.DoubleType())]), make)
