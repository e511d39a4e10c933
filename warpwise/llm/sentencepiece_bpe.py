"""SentencePiece BPE encoding and decoding in rounds of vectorised merges.

The library's model file gives pieces and scores; the merging itself is numpy work inside tasks.
All distinct words of a slice lie in one flat array of symbols. A round finds the best (lowest) pair
rank of every word by a segmented minimum, merges that pair at its leftmost places in all words at
once, compacts the arrays and sets aside the words that have no pair left.

A word may merge all places of its best pair in one round unless that creates a pair that ranks as
good or better, also between a merged symbol and its right neighbour as it was before the round; then only
the leftmost place is merged, which is what one merge at a time would do.

Defined cases: a null text is empty and has no ids; characters without a piece become byte pieces; a
literal U+2581 is a space, as in the library; columns named like the outputs are replaced.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .columns import append_columns, texts_of
from .words import WordIds, id_lists, spans

SPACE = "▁"
CACHED_WORDS = 200_000  # words a task remembers
_NONE = np.int64(1) << 60


def _bytewise(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("wp_bytewise", _bytewise)


class PieceModel:
    """Pieces, pair ranks and byte pieces of one model file."""

    def __init__(self, proto: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(self.size)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(self.size)]
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        # equal scores share a rank, so that the leftmost of them goes first
        levels = {s: r for r, s in enumerate(sorted({library.get_score(i) for i in ids.values()}, reverse=True))}
        rank = np.zeros(self.size, np.int64)
        for i in ids.values():
            rank[i] = levels[library.get_score(i)]
        pairs = {}
        for piece, merged in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = merged
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.ranks = rank[self.merged]
        self.chars = np.arange(0x110000, dtype=np.int64) + self.size  # without a piece: size + code point
        for piece, i in ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        self.bytes = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # neighbours that no piece holds can never be merged across: words are cut there
        near = {ord(p[i]) << 21 | ord(p[i + 1]) for p in ids for i in range(len(p) - 1)}
        self.near = np.array(sorted(near), np.int64)
        self.near_latin = np.zeros(1 << 20, bool)
        self.near_latin[[(k >> 21) << 10 | k & 1023 for k in near if k >> 21 < 1024 and (k & 0x1FFFFF) < 1024]] = True
        assert not any(SPACE in p.lstrip(SPACE) for p in ids), "a piece spans two words"

        byte = {int(i): bytes([b]) for b, i in enumerate(self.bytes.tolist())}
        surface = [
            byte[i] if i in byte
            else library.decode([i]).encode() if library.is_unknown(i)
            else b"" if special[i]
            else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_length = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.opens_word = np.array([p.startswith(SPACE) and not s for p, s in zip(pieces, special)])
        self.silent = np.array([len(s) == 0 for s in surface])

    def _near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some piece holds the two code points side by side."""
        out = self.near_latin[(left & 1023) << 10 | right & 1023]
        far = np.flatnonzero((left | right) >= 1024)
        if len(far):
            key = left[far] << 21 | right[far]
            out[far] = self.near[np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)] == key
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of symbol pairs; rank _NONE where there is no such piece."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), self.merged[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words and the number of ids of each word."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not len(points):
            return np.zeros(0, np.int64), lengths
        owner = np.repeat(np.arange(len(words)), lengths)
        joined = (owner[:-1] == owner[1:]) & self._near(points[:-1], points[1:])
        # segments: stretches of a word inside which merges can happen
        segment = np.concatenate([[0], np.cumsum(~joined)])
        symbol = self.chars[points]
        place = np.arange(len(points))
        settled_symbols, settled_places = [], []

        rank = np.full(len(symbol), _NONE)
        rank[:-1], merged = self._pairs(symbol[:-1], symbol[1:])
        rank[:-1][~joined] = _NONE
        merged = np.append(merged, 0)
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            alive = np.repeat(best < _NONE, sizes)
            if not alive.all():
                settled_symbols.append(symbol[~alive])
                settled_places.append(place[~alive])
                symbol, place, segment, rank, merged = (a[alive] for a in (symbol, place, segment, rank, merged))
                sizes, best = sizes[best < _NONE], best[best < _NONE]
                if not len(symbol):
                    break
            lowest = np.repeat(best, sizes)
            at = np.flatnonzero(rank == lowest)
            # every second place of a run of touching places, from its left end
            opens = np.concatenate([[True], at[1:] != at[:-1] + 1])
            order = np.arange(len(at))
            at = at[(order - np.maximum.accumulate(np.where(opens, order, 0))) % 2 == 0]
            state = self._merged_at(at, symbol, place, segment, rank, merged)
            worse = state[5]
            if len(worse):
                of = segment[at]
                first = np.concatenate([[True], of[1:] != of[:-1]])
                free = np.ones(of[-1] + 1, bool)
                free[worse] = False
                state = self._merged_at(at[first | free[of]], symbol, place, segment, rank, merged)
            symbol, place, segment, rank, merged = state[:5]

        symbol, place = np.concatenate(settled_symbols), np.concatenate(settled_places)
        order = np.argsort(place)
        symbol, word = symbol[order], owner[place[order]]
        ids, counts = self._with_bytes(symbol)
        return ids, np.bincount(word, weights=counts, minlength=len(words)).astype(np.int64)

    def _merged_at(self, at, symbol, place, segment, rank, merged):
        """The arrays after merging the pairs that begin at ``at``; last, the segments in which that
        made a pair at least as good as the merged one although they had several places."""
        level = rank[at]
        # where the next place touches, the merged symbol meets its right neighbour before that is merged
        touching = np.flatnonzero((at[1:] == at[:-1] + 2) & (segment[at[1:]] == segment[at[:-1]]))
        early, _ = self._pairs(merged[at[touching]], symbol[at[touching + 1]])
        early = segment[at[touching]][early <= level[touching]]
        symbol, rank, merged = symbol.copy(), rank.copy(), merged.copy()
        symbol[at] = merged[at]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        new = np.cumsum(keep)[at] - 1  # where the merged symbols are after compaction
        symbol, place, segment, rank, merged = (a[keep] for a in (symbol, place, segment, rank, merged))
        mask = np.zeros(len(symbol) + 1, bool)
        mask[new] = mask[new - 1] = True  # at 0 this marks the spare last entry
        touched = np.flatnonzero(mask[:-1])
        last = touched == len(symbol) - 1
        right = np.minimum(touched + 1, len(symbol) - 1)
        fresh, made = self._pairs(symbol[touched], symbol[right])
        fresh[last | (segment[touched] != segment[right])] = _NONE
        rank[touched], merged[touched] = fresh, made
        of = segment[new]
        several = of[1:][of[1:] == of[:-1]]
        if not len(several):
            return symbol, place, segment, rank, merged, several
        limit = np.full(of[-1] + 2, -1)
        limit[several] = level[1:][of[1:] == of[:-1]]
        owners = np.minimum(segment[touched], of[-1] + 1)
        return symbol, place, segment, rank, merged, np.concatenate([early, owners[fresh <= limit[owners]]])

    def _with_bytes(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, those without a piece as their UTF-8 bytes, and the ids of each symbol."""
        point = symbol - self.size
        bare = point >= 0
        counts = np.ones(len(symbol), np.int64)
        if not bare.any():
            return symbol, counts
        counts[bare] = 1 + (point[bare] >= 0x80) + (point[bare] >= 0x800) + (point[bare] >= 0x10000)
        starts = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int64)
        ids[starts[~bare]] = symbol[~bare]
        text = "".join(map(chr, point[bare].tolist())).encode("utf-8", "surrogatepass")
        ids[spans(starts[bare], counts[bare])] = self.bytes[np.frombuffer(text, np.uint8)]
        return ids, counts

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Texts of id sequences, ``lengths[i]`` ids each, as the library decodes them."""
        ends = np.cumsum(lengths)
        widths, starts = self.surface_length[ids], self.surface_start[ids]
        # the first audible piece of a sequence loses the space that encoding put before the text
        heard = np.flatnonzero(~self.silent[ids])
        first = np.searchsorted(heard, ends - lengths)
        some = first < len(heard)
        head = heard[first[some]]
        head = head[head < ends[some]]
        head = head[self.opens_word[ids[head]]]
        widths[head] -= 1
        starts = starts.copy()
        starts[head] += 1
        data = self.surface[spans(starts, widths)].tobytes()
        offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(widths)])[ends]])
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            cut = [data[a:b].decode("utf-8", "wp_bytewise") for a, b in zip(offsets[:-1], offsets[1:])]
            return pa.array(cut, pa.string())
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def spaced(text: str) -> str:
    """A text as words between single blanks, its spaces as U+2581 and a leading one added.

    A word begins at a run of spaces or a line end; no piece goes on from one word into the next.
    """
    if not text:
        return ""
    if "  " in text or SPACE in text or text[0] == " ":
        return " ".join(WORDS.findall(SPACE + text.replace(" ", SPACE)))
    return SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")


@lru_cache(maxsize=2)
def model_of(proto: bytes) -> PieceModel:
    return PieceModel(proto)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with the ids of column ``text`` as array ``ids``, without begin or end ids.

    ``decoded`` names a further column with the text that decoding these ids gives. The model file
    is read on the driver and sent to the tasks (half a megabyte).
    """
    proto = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    fields = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        fields = fields.add(decoded, T.StringType())

    def make() -> Callable:
        model = model_of(proto.value)
        encoder = WordIds(model.merge, CACHED_WORDS)  # lives as long as the task

        def work(batch):
            flat, lengths = encoder([spaced(t) for t in texts_of(batch, "text")])
            out = [id_lists(flat, lengths)]
            return [*out, model.decode(flat, lengths)] if decoded else out

        return work

    return append_columns(docs, text, fields, make, keep)


def decode(df: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text of the id array ``ids`` as column ``decoded``; a null array gives an empty text."""
    proto = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    carried = [c for c in df.columns if c.lower() != decoded.lower()]
    schema = T.StructType([df.schema[c] for c in carried]).add(decoded, T.StringType())

    def run(batches):
        model = model_of(proto.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
                rows = [np.array(x if x else [], np.int64) for x in lists]
                lengths = np.array([len(x) for x in rows], np.int64)
                texts = model.decode(np.concatenate(rows), lengths)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in carried]
                yield pa.RecordBatch.from_arrays([*columns, texts], names=[*carried, decoded])

    return df.mapInArrow(run, schema)
