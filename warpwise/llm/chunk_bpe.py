"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last WINDOW bytes cuts texts into chunks of about 2 ** MASK_BITS bytes: there is a cut
where the hash's high bits are zero, so cuts depend on the bytes just before them only, and texts that share a passage
share its chunks, wherever it stands. A chunk is encoded once and then found by its bytes in the store of the
Python worker, which lives across the worker's tasks and starts afresh after STORE_BYTES.

A cut may lie inside a word, so the ids at both ends of a chunk are not those of the text. What a chunk
gives away is what lies between its first and its last blank. A join is repaired by re-encoding what is left of
both sides; while the next chunk has no blank the join is widened by that chunk. It ends when a blank stands at
both sides: the tokenizer drops white space and merges nothing across it, so there the ids of the join and of
its neighbours agree exactly with those of the whole text.

Nothing is shuffled: sending every chunk to its copies would move the whole text once and all its ids twice, while
a worker finds the passages that many documents share in its own store. Bounded memory: slices of text, the
store, and the words that are remembered.

The tokenizer has to lower-case, to drop white space, to keep runs of letters and runs of marks apart, and to have no
decoder (then decoding joins the tokens by single spaces). :func:`encode` raises for a tokenizer with a decoder.

Defined cases: a null or empty text has no ids and decodes to an empty text; the strings of special tokens inside
texts are those tokens, as in the library; repeated rows are encoded alike; an empty table gives an empty table;
columns named like the outputs are replaced, all others are carried. In :func:`decode` a null id array is empty and ids
outside the vocabulary are left out, as in the library.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from .columns import append_columns, without
from .words import WordIds, id_lists, spans

WINDOW_STEPS = 5  # the hash is taken over 2 ** WINDOW_STEPS bytes
WINDOW = 1 << WINDOW_STEPS
MASK_BITS = 10  # chunks of about a kilobyte
SHORTEST = 128  # bytes between cuts at least
STORE_BYTES = 16 << 20  # bytes of chunks that a worker remembers
CACHED_WORDS = 300_000  # words that a worker remembers

# Special tokens are told apart by case, and a letter and its mark may be composed in one case only.
_CASED = "<\\||[\u0300-\u036f]"

_TABLE = np.random.default_rng(20260611).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the last WINDOW bytes at each byte: the sum of table[byte] << age, by doubling."""
    found = _TABLE[data]
    for step in range(WINDOW_STEPS):
        age = 1 << step
        older = found[:-age] << np.uint32(age)
        found = found.copy()
        found[age:] += older
    return found


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each text, data[start:end] in UTF-8, the ends of its chunks; the last one is the text's end.

    No cut lies inside a character or depends on bytes of another text.
    """
    if not len(data):
        return [[] for _ in starts]
    at = np.flatnonzero(rolling(data) >> np.uint32(32 - MASK_BITS) == 0) + 1
    at = at[at < len(data)]
    for _ in range(3):  # to the next character's first byte
        at = at + ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
    owner = np.searchsorted(starts, at, side="right") - 1
    inside = (at - starts[owner] >= WINDOW) & (at < ends[owner])
    at, owner = at[inside], owner[inside]
    first, last = np.searchsorted(owner, np.arange(len(starts))), np.searchsorted(owner, np.arange(len(starts)), side="right")
    every = at.tolist()
    out = []
    for start, end, low, high in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist()):
        chosen, before = [], start
        for cut in every[low:high]:
            if cut - before >= SHORTEST:
                chosen.append(cut)
                before = cut
        if end > start:
            chosen.append(end)
        out.append(chosen)
    return out


class ChunkEncoder:
    """Encodes texts chunk by chunk; remembers chunks and words."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = WordIds(self._encode_words, CACHED_WORDS)
        self.encoded = self.reused = 0  # bytes of chunks
        self._forget()

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _ids(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches of text, made of few distinct words: a word never goes on from a letter to a mark."""
        texts = pc.replace_substring(pa.array(stretches, pa.binary()).cast(pa.string()), "\n", " ")
        texts = pc.if_else(pc.match_substring_regex(texts, _CASED), texts, pc.ascii_lower(texts))
        return self.words(pc.replace_substring_regex(texts, r"(\pL)([.,;:!?])", r"\1 \2"))

    def _forget(self):
        self.numbers: dict[bytes, int] = {}
        self.held = 0
        self.edges: list[tuple[int, int]] = []  # first and last blank; (-1, -1) where there is none
        self.flat = np.zeros(0, np.int32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        if self.held > STORE_BYTES:
            self._forget()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base, stop = int(offsets[0]), int(offsets[-1])
        data = memoryview(texts.buffers()[2] or b"")[base:stop]
        starts, ends = offsets[:-1] - base, offsets[1:] - base

        known, bodies = len(self.numbers), []  # bodies of chunks not met before
        joins: list[bytes] = []
        inner: list[int] = []  # chunk numbers, one between two joins of a text
        inner_of = np.zeros(len(texts), np.int64)
        for text, ends_of in enumerate(cuts(np.frombuffer(data, np.uint8), starts, ends)):
            before, left = int(starts[text]), []
            for cut in ends_of:
                chunk = data[before:cut].tobytes()
                before = cut
                number = self.numbers.get(chunk)
                if number is None:
                    number = self.numbers[chunk] = len(self.numbers)
                    low = min((at for at in map(chunk.find, (b" ", b"\n")) if at >= 0), default=-1)
                    high = max(map(chunk.rfind, (b" ", b"\n")))
                    self.edges.append((low, high))
                    bodies.append(chunk[low + 1 : high] if low < high else b"")
                    self.held += len(chunk)
                    self.encoded += len(chunk)
                else:
                    self.reused += len(chunk)
                low, high = self.edges[number]
                if low < 0:
                    left.append(chunk)
                    continue
                left.append(chunk[:low])
                joins.append(b"".join(left))
                left = [chunk[high + 1 :]]
                inner.append(number)
                inner_of[text] += 1
            joins.append(b"".join(left))
        if bodies:
            ids, lengths = self._ids(bodies)
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, ids)
        assert len(self.starts) == known + len(bodies)

        ids, join_lengths = self._ids(joins)
        # the pieces of a text: join, chunk, join, chunk, ..., join
        sizes = 2 * inner_of + 1
        first = np.cumsum(sizes) - sizes
        order = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        is_join = order % 2 == 0
        number = np.array(inner, np.int64)
        piece_starts, piece_lengths = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        piece_starts[is_join] = len(self.flat) + np.cumsum(join_lengths) - join_lengths
        piece_lengths[is_join] = join_lengths
        piece_starts[~is_join], piece_lengths[~is_join] = self.starts[number], self.lengths[number]
        found = np.concatenate([self.flat, ids])[spans(piece_starts, piece_lengths)]
        return found, np.add.reduceat(piece_lengths, first)


class TokenTexts:
    """Texts of id sequences: the tokens, joined by single spaces."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(definition)
        named = {i: token.encode() for token, i in library.get_vocab(with_added_tokens=True).items()}
        self.known = np.zeros(max(named, default=-1) + 1, bool)
        self.known[list(named)] = True
        tokens = [named.get(i, b"") + b" " for i in range(len(self.known))]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.widths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths

    def __call__(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        ids = ids.astype(np.int64, copy=False)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        good = (ids >= 0) & (ids < len(self.known))
        good[good] = self.known[ids[good]]
        if not good.all():
            ids, owner = ids[good], owner[good]
            lengths = np.bincount(owner, minlength=len(lengths))
        widths = self.widths[ids]
        ends = np.cumsum(lengths)
        widths[ends[lengths > 0] - 1] -= 1  # no space after the last token
        data = self.bytes[spans(self.starts[ids], widths)]
        offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(widths)])[ends]])
        return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())


@lru_cache(maxsize=1)
def encoder_of(definition: str) -> ChunkEncoder:
    """The encoder of this Python worker."""
    return ChunkEncoder(definition)


@lru_cache(maxsize=1)
def texts_of_tokens(definition: str) -> TokenTexts:
    return TokenTexts(definition)


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    if json.loads(definition).get("decoder") is not None:
        raise ValueError("only for tokenizers without a decoder")
    return definition


def encode(
    docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with the ids of column ``text`` as array ``ids``; special tokens are not added.

    ``decoded`` names a further column with the text that decoding these ids gives. The tokenizer's
    file is read on the driver and sent to the tasks (a few megabytes).
    """
    definition = docs.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))
    fields = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        fields = fields.add(decoded, T.StringType())

    def make():
        encoder = encoder_of(definition.value)
        texts = texts_of_tokens(definition.value) if decoded else None

        def work(batch):
            flat, lengths = encoder(batch.column(batch.schema.get_field_index("text")))
            return [id_lists(flat, lengths), texts(flat, lengths)] if texts else [id_lists(flat, lengths)]

        return work

    return append_columns(docs, text, fields, make, keep)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of the id array ``ids`` as column ``decoded``; special tokens are not skipped."""
    definition = df.sparkSession.sparkContext.broadcast(read_definition(tokenizer_path))
    carried = without(df, [decoded])
    at = df.columns.index(ids)
    places = [df.columns.index(c) for c in carried]
    schema = T.StructType([df.schema[i] for i in places]).add(decoded, T.StringType())

    def run(batches):
        texts = texts_of_tokens(definition.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                lists = batch.column(at)
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], texts(flat, lengths)], names=schema.names)

    return df.mapInArrow(run, schema)
