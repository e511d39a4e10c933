"""Ids of texts put together from the ids of their distinct words."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS = 400_000  # words a Python worker remembers between slices; then it starts afresh


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class WordIds:
    """Ids of texts made of words between single blanks.

    ``encode_words`` gives flat ids and the number of ids of each word; it is asked once for each word
    that is not remembered, so what it returns may depend on the word only.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cached: int = CACHED_WORDS):
        self.encode_words, self.cached = encode_words, cached
        self._forget()

    def _forget(self):
        self.words = Numbers()
        self.flat = np.zeros(0, np.int32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        if len(self.words) > self.cached:
            self._forget()
        known = len(self.words)
        lists = pc.split_pattern(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        number = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        if len(self.words) > known:
            ids, lengths = self.encode_words(list(islice(self.words, known, None)))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, np.asarray(ids, np.int32))
        code = number[words.indices.to_numpy()]
        lengths = self.lengths[code]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        return self.flat[spans(self.starts[code], lengths)], np.diff(before[ends])


def id_lists(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))
