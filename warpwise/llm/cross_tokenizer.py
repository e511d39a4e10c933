"""Alignment of two tokenizers over a corpus, with counts of the id pairs that they link.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library and reads a space and the text; tokenizer B is a
SentencePiece model and reads the text, before which it puts that space itself. Both cover the same bytes. Places
where a token of A and one of B end together cut the tokens into groups; two tokens are linked if their bytes overlap. In
order of the bytes every end, of A or B or both, closes one link, so links follow from one marked array of ends.

A pair's count is the number of documents that hold it linked. Counting has a fast path: a vocabulary-length array
gives each id of A the id of B with the same bytes, and pairs of that kind are counted in a vector of that length inside each
task, so only one row per id and task is shuffled for them. Only the other pairs, of irregular groups, are
counted by a shuffle, which sums inside tasks first.

Counts return to the documents by a bound that holds at every size: of all T rows (document, pair), fewer than HOT pairs can have
more than T / HOT rows each. Those, the vector and each A id's highest count are broadcast; the other pairs
are joined, and none of them has more than T / HOT rows there, so no key is hot.

Documents are encoded once; what the counts need of them (distinct pairs with their occurrences) is written to the shared folder.

Defined cases: a text that is null or empty, or whose tokens of A or of B do not spell the space and the text, has no tokens: zeros, and
an empty digest; the strings of special tokens inside texts are plain text; repeated rows are documents of their
own; an empty table gives an empty table; columns of ``keep`` named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..runtime import materialise
from .columns import append_columns, column, without
from .words import WordIds, id_lists, spans

SLICE_BYTES = 1 << 20
HOT = 500_000  # pairs that are broadcast, at most
CACHED_WORDS = 150_000  # words remembered for each tokenizer

# A blank before white space or the end (there A's words are not those between blanks), or B's sign for a space.
_UNEVEN = "^ | ([\t-\r\u001c-\u0020\u0085\u00a0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]|$)|\u2581"


class _Side:
    """One tokenizer: ids of texts and the bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.widths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.words = WordIds(self._flat, CACHED_WORDS)

    def _lists(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._lists(texts)
        return np.fromiter((i for x in ids for i in x), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def __call__(self, texts: pa.Array, uneven: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text; texts marked uneven are not cut at blanks."""
        if not uneven.any():
            ids, lengths = self.words(texts)
            return ids.astype(np.int64), lengths
        even, even_lengths = self.words(texts.filter(pa.array(~uneven)))
        odd, odd_lengths = self._flat(texts.filter(pa.array(uneven)).to_pylist())
        lengths, starts = np.empty(len(uneven), np.int64), np.empty(len(uneven), np.int64)
        lengths[~uneven], lengths[uneven] = even_lengths, odd_lengths
        starts[~uneven] = np.cumsum(even_lengths) - even_lengths
        starts[uneven] = len(even) + np.cumsum(odd_lengths) - odd_lengths
        return np.concatenate([even, odd])[spans(starts, lengths)].astype(np.int64), lengths

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[spans(self.starts[ids], self.widths[ids])]


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # printable ones stand for themselves
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteSide(_Side):
    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        byte = _byte_of_char()
        tokens = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            tokens[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__(tokens)

    def _lists(self, texts):
        return [e.ids for e in self.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide(_Side):
    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        super().__init__(
            [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        )

    def _lists(self, texts):
        return self.library.encode(texts, num_threads=1)


class Aligner:
    """Aligns the tokens of many texts at once in numpy."""

    def __init__(self, definition: str, proto: bytes):
        self.a, self.b = ByteSide(definition), PieceSide(proto)
        self.b_size = len(self.b.widths)
        by_bytes = {self._spelling(self.b, i): i for i in reversed(range(self.b_size))}
        # the id of B with the same bytes; -1 where there is none
        self.same = np.array([by_bytes.get(self._spelling(self.a, i), -1) for i in range(len(self.a.widths))], np.int64)
        names = [str(i).encode() + b"," for i in range(max(len(self.a.widths), self.b_size))]
        self.name_widths = np.array([len(n) for n in names], np.int64)
        self.name_starts = np.cumsum(self.name_widths) - self.name_widths
        self.names = np.frombuffer(b"".join(names), np.uint8)

    @staticmethod
    def _spelling(side: _Side, i: int) -> bytes:
        return side.bytes[side.starts[i] : side.starts[i] + side.widths[i]].tobytes()

    def _encoded(self, texts: pa.Array):
        """Ids of A and B and their numbers per text; none where they do not spell the text."""
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        wanted = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
        sizes = pc.binary_length(wanted).to_numpy(zero_copy_only=False).astype(np.int64)
        sides = []
        good = sizes > 0
        for side in (self.a, self.b):
            ids, lengths = side(texts, uneven)
            ends = np.concatenate([[0], np.cumsum(side.widths[ids])])[np.cumsum(lengths)]
            good &= np.diff(ends, prepend=0) == sizes
            sides.append([side, ids, lengths])
        for _ in range(2):  # by size first, then by content
            for one in sides:
                one[1] = one[1][np.repeat(good, one[2])]
                one[2] = np.where(good, one[2], 0)
            kept = wanted.filter(pa.array(good))
            content = np.frombuffer(b"".join(kept.cast(pa.binary()).to_pylist()), np.uint8)
            owner = np.repeat(np.flatnonzero(good), sizes[good])
            for side, ids, _ in sides:
                good[owner[side.spelled(ids) != content]] = False
            if good[owner].all():
                break
        (_, a, n_a), (_, b, n_b) = sides
        return a, n_a, b, n_b

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        a, n_a, b, n_b = self._encoded(texts)
        count = len(n_a)
        ends_a, ends_b = np.cumsum(self.a.widths[a]), np.cumsum(self.b.widths[b])
        mark = np.zeros((int(ends_a[-1]) if len(ends_a) else 0) + 1, np.uint8)
        mark[ends_a] = 1
        mark[ends_b] |= 2
        ends = np.flatnonzero(mark)
        kind = mark[ends]
        of_a = np.cumsum(kind & 1) - (kind & 1)  # the tokens that a link joins
        of_b = np.cumsum(kind >> 1) - (kind >> 1)
        common = kind == 3
        document = np.repeat(np.arange(count), n_a)[of_a]
        group = np.cumsum(common) - common
        left, right = a[of_a], b[of_b]
        n_links = np.bincount(document, minlength=count)

        # distinct pairs of a document, and how many of its links they are
        wide = len(self.a.widths) * self.b_size
        pairs, links = np.unique(document * wide + left * self.b_size + right, return_counts=True)
        owner, pair = pairs // wide, pairs % wide
        same = self.same[pair // self.b_size] == pair % self.b_size
        return {
            "a": a, "n_a": n_a, "b": b, "n_b": n_b, "n_links": n_links, "n_groups": np.bincount(document[common], minlength=count),
            "group_a": group[(kind & 1) > 0], "group_b": group[(kind & 2) > 0], "last_a": common[(kind & 1) > 0], "last_b": common[(kind & 2) > 0],
            "same": pair[same] // self.b_size, "same_links": links[same], "n_same": np.bincount(owner[same], minlength=count),
            "pair": pair[~same], "pair_links": links[~same], "n_pair": np.bincount(owner[~same], minlength=count),
        }

    def digests(self, x: dict[str, np.ndarray]) -> list[str]:
        """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; empty for a text without tokens."""
        order = np.argsort(np.concatenate([2 * x["group_a"], 2 * x["group_b"] + 1]), kind="stable")
        ids = np.concatenate([x["a"], x["b"]])[order]
        closing = np.concatenate([np.where(x["last_a"], ord("|"), ord(",")), np.where(x["last_b"], ord(";"), ord(","))])[order]
        widths = self.name_widths[ids]
        data = self.names[spans(self.name_starts[ids], widths)]
        ends = np.cumsum(widths)
        data[ends - 1] = closing
        view = memoryview(data)
        stops = np.concatenate([[0], ends])[np.cumsum(x["n_a"] + x["n_b"])].tolist()
        return [hashlib.sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in zip([0, *stops], stops)]

    def sizes(self, x: dict[str, np.ndarray], side: str) -> pa.Array:
        """Tokens of one side in each group of each text."""
        count = int(x["n_groups"].sum())
        return id_lists(np.bincount(x[f"group_{side}"], minlength=count), x["n_groups"])


@lru_cache(maxsize=1)
def aligner_of(definition: str, proto: bytes) -> Aligner:
    return Aligner(definition, proto)


def _files(docs: DataFrame, a_path: str, b_path: str):
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def _longs(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the tokens of both sides, a_ids and b_ids, and their numbers in each group, a_sizes and b_sizes."""
    files = _files(docs, a_path, b_path)
    names = ("a_ids", "b_ids", "a_sizes", "b_sizes")
    fields = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in names])

    def make():
        aligner = aligner_of(*files.value)

        def work(batch):
            x = aligner(batch.column(batch.schema.get_field_index("text")))
            return [id_lists(x["a"], x["n_a"]), id_lists(x["b"], x["n_b"]), aligner.sizes(x, "a"), aligner.sizes(x, "b")]

        return work

    return append_columns(docs, text, fields, make, keep, SLICE_BYTES)


def _stored(docs: DataFrame, files, text: str, carried: list[str]) -> DataFrame:
    """Per document, written: row, doc (the carried columns), counts, digest, and its distinct pairs with their links."""
    chosen = docs.select(F.struct(*[column(c) for c in carried]).alias("doc"), column(text).cast("string").alias("text"))
    numbers = T.ArrayType(T.LongType())
    fields = T.StructType(
        [T.StructField(n, T.LongType()) for n in _COUNTS]
        + [T.StructField("groups_sha256", T.StringType())]
        + [T.StructField(n, numbers) for n in ("same", "same_links", "pair", "pair_links")]
    )

    def make():
        aligner = aligner_of(*files.value)

        def work(batch):
            x = aligner(batch.column(batch.schema.get_field_index("text")))
            lists = [_longs(x[n], x["n_same" if n.startswith("same") else "n_pair"]) for n in ("same", "same_links", "pair", "pair_links")]
            return [*[pa.array(x[n], pa.int64()) for n in _COUNTS], pa.array(aligner.digests(x), pa.string()), *lists]

        return work

    made = append_columns(chosen, "text", fields, make, ["doc"], SLICE_BYTES)
    return materialise(made.withColumn("row", F.monotonically_increasing_id()), "aligned")


def _same_counts(stored: DataFrame, size: int) -> np.ndarray:
    """Documents of each id of A that is linked to the id of B with the same bytes: a vector as long as the vocabulary."""

    def add(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["a", "n"])

    sums = stored.select("same").mapInArrow(add, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(size, np.int64)
    found[sums["a"].to_numpy()] = sums["n"].to_numpy()
    return found


def counted(
    docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None, hot: int = HOT
) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best counts the links whose pair's count is the highest of its A id, count_sum is the sum of the counts of all
    links. ``hot`` bounds the number of pairs that are broadcast.
    """
    spark = docs.sparkSession
    files = _files(docs, a_path, b_path)
    aligner = aligner_of(*files.value)
    a_size, b_size, same_id = len(aligner.a.widths), aligner.b_size, aligner.same
    names = [*_COUNTS, "n_best", "count_sum", "groups_sha256"]
    carried = without(docs.select(*[column(c) for c in keep]) if keep is not None else docs, names)
    stored = _stored(docs, files, text, carried)

    same_counts = _same_counts(stored, a_size)
    pairs = materialise(stored.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    per_a = pairs.groupBy(F.expr(f"pair div {b_size}").alias("a")).agg(F.max("n").alias("n"), F.sum("n").alias("rows")).toArrow()
    highest = same_counts.copy()  # of each id of A
    np.maximum.at(highest, per_a["a"].to_numpy(), per_a["n"].to_numpy())
    total = int(same_counts.sum()) + int(pc.sum(per_a["rows"]).as_py() or 0)
    limit = total // hot
    frequent = pairs.where(F.col("n") > limit).toArrow()  # fewer than ``hot`` rows
    keys = frequent["pair"].to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((same_counts, highest, keys[order], frequent["n"].to_numpy()[order]))

    def score(batches):
        same_counts, highest, keys, counts = shared.value
        for batch in batches:
            rows = batch.num_rows

            def lists(name):
                values = batch.column(batch.schema.get_field_index(name))
                return values.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(values).to_numpy(zero_copy_only=False)

            same, n_same = lists("same")
            pair, n_pair = lists("pair")
            of_same, of_pair = np.repeat(np.arange(rows), n_same), np.repeat(np.arange(rows), n_pair)
            links, pair_links = lists("same_links")[0], lists("pair_links")[0]
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            left = np.concatenate([same, pair[known] // b_size])
            count = np.concatenate([same_counts[same], counts[at[known]] if len(keys) else np.zeros(0, np.int64)])
            weight, owner = np.concatenate([links, pair_links[known]]), np.concatenate([of_same, of_pair[known]])
            sums, best = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(sums, owner, weight * count)
            np.add.at(best, owner, weight * (count == highest[left]))
            rest = np.bincount(of_pair[~known], minlength=rows)
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("doc", "row", *_COUNTS, "groups_sha256")]
            arrays = [*kept, pa.array(best), pa.array(sums), _longs(pair[~known], rest), _longs(pair_links[~known], rest)]
            yield pa.RecordBatch.from_arrays(arrays, names=scored_schema.names)

    scored_schema = T.StructType(
        [stored.schema[n] for n in ("doc", "row", *_COUNTS, "groups_sha256")]
        + [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")]
        + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("pair", "pair_links")]
    )
    scored = stored.mapInArrow(score, scored_schema)
    rare = pairs.where(F.col("n") <= limit)
    if not rare.isEmpty():
        scored = materialise(scored, "aligned-scored")
        best_of = spark.createDataFrame(pa.table({"a": np.arange(a_size), "highest": highest}))
        rare = rare.join(F.broadcast(best_of), F.expr(f"pair div {b_size}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("is_best"))
        open_links = scored.select("row", F.explode(F.arrays_zip("pair", "pair_links")).alias("p")).select("row", "p.pair", "p.pair_links")
        more = (
            open_links.join(rare, "pair")
            .groupBy("row")
            .agg(F.sum(F.col("pair_links") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("is_best"), F.col("pair_links")).otherwise(0)).alias("more_best"))
        )
        nothing = F.lit(0).cast("long")
        scored = scored.join(more, "row", "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("more_best", nothing), "count_sum": F.col("count_sum") + F.coalesce("more_sum", nothing)}
        )
    return scored.select(*[F.col("doc").getField(c).alias(c) for c in carried], *names)
