"""Ids of words, each worked out once in a process and kept in flat arrays, so that texts are put together by numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Words that a process keeps; then it starts anew.
KEPT = 1_000_000
#: Bytes of texts that are handled at once.
CHUNK = 1 << 23


def chunks_of(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes together, a row at least."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        to = min(max(int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1, at + 1), len(column))
        yield at, to
        at = to


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordIds:
    """learn: ids of a list of words, one after the other, and how many each has. Row 0 is `end`, ids that stand after each text."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], end: list[int], kind: str, most: int = KEPT):
        self.learn, self.end, self.kind, self.most = learn, end, np.dtype(kind), most
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat, self.used, self.n = np.zeros(1 << 18, self.kind), 0, 0
        self.add(np.array(self.end, self.kind), np.array([len(self.end)]))

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        total, n = len(ids), len(lengths)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + total] = ids
        self.starts[self.n : self.n + n] = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        self.lengths[self.n : self.n + n] = lengths
        self.used, self.n = self.used + total, self.n + n

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each of these words, all different."""
        get = self.row.get
        found = np.array([get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new) and self.n + len(new) > self.most:
            self.clear()
            new = np.arange(len(words))
        if len(new):
            fresh = [words[i] for i in new]
            found[new] = np.arange(self.n, self.n + len(new))
            self.row.update(zip(fresh, found[new].tolist(), strict=True))
            self.add(*self.learn(fresh))
        return found

    def texts(self, words: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts words[offsets[i]:offsets[i+1]], each with the end after it, and the offsets of texts in them."""
        coded = words.dictionary_encode()
        rows = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        if self.end:
            rows = np.insert(rows, offsets[1:], 0)
            offsets = offsets + np.arange(len(offsets))
        lengths = self.lengths[rows].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[gathered(self.starts[rows], lengths)], ends[offsets]
