"""Token ids of whole texts by way of their distinct words.

A tokenizer that never joins text across certain places gives the same ids when it sees the pieces between those places one by
one.  Texts repeat their pieces, so a worker tokenizes each distinct piece once and copies the ids from there on.  Pieces are
looked up by a 64-bit hash, and every hit is compared byte by byte, so two pieces are never taken for each other.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from docmill.llm.textkernel import span_hashes


class WordCache:
    """``encode(list of bytes)`` gives the ids of each piece.  With over ``most`` pieces the cache forgets them all."""

    def __init__(self, encode: Callable[[list[bytes]], list], most: int):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        # hashes of the pieces that can be looked up, in order, and their numbers
        self.known, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.count = 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0
        self.raw_starts, self.raw_sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.raw, self.raw_used = np.zeros(1 << 20, np.uint8), 0

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, their n + 1 offsets) for rows of pieces; ``last``: an id after each row's own."""
        if self.count > self.most:
            self.clear()
        keys, first, inverse = np.unique(span_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, keys)
        new = np.flatnonzero(np.append(self.known, ~keys[-1:])[place] != keys) if len(keys) else place
        if len(new):
            self.numbers = np.insert(self.numbers, place[new], self._add(data, starts[first[new]], ends[first[new]]))
            self.known = np.insert(self.known, place[new], keys[new])
            place = np.searchsorted(self.known, keys)
        number = self.numbers[place[inverse]]
        other = np.flatnonzero(~self._same(number, data, starts, ends))
        if len(other):  # pieces whose hash another piece has: each is tokenized by itself
            number[other] = self._add(data, starts[other], ends[other])
        sizes = self.sizes[number]
        per_row = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts[number] - (np.cumsum(sizes) - sizes), sizes)
        ids = self.flat[at]
        if last is not None:
            ids = np.insert(ids, per_row[1:], last)
            per_row = per_row + np.arange(len(per_row))
        return ids, per_row

    def _same(self, number: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each piece's bytes are those of the piece of that number, eight bytes at a time."""
        size = ends - starts
        out = self.raw_sizes[number] == size
        own = np.zeros(len(data) + 8, np.uint8)
        own[: len(data)] = data
        one, two = (np.ndarray(len(x) - 7, "<u8", x, strides=(1,)) for x in (own, self.raw))
        live, done = np.flatnonzero(out), 0
        while len(live):
            rest = np.minimum(size[live] - done, 8)
            differs = (one[starts[live] + done] ^ two[self.raw_starts[number[live]] + done]) << (8 * (8 - rest)).astype(np.uint64)
            out[live[differs != 0]] = False
            done += 8
            live = live[(differs == 0) & (size[live] > done)]
            if len(live) <= 16:  # a few long ones
                for i in live.tolist():
                    a = int(self.raw_starts[number[i]])
                    out[i] = np.array_equal(self.raw[a : a + size[i]], data[starts[i] : ends[i]])
                break
        return out

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokenizes pieces; the numbers that they have from now on."""
        pieces = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        ids = self.encode(pieces)
        number, n = self.count, len(ids)
        sizes, raw_sizes = np.fromiter(map(len, ids), np.int64, n), ends - starts
        total, raw_total = int(sizes.sum()), int(raw_sizes.sum())
        while number + n > len(self.starts):
            self.starts, self.sizes, self.raw_starts, self.raw_sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.raw_starts, self.raw_sizes))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.raw_used + raw_total + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.raw[self.raw_used : self.raw_used + raw_total] = np.frombuffer(b"".join(pieces), np.uint8)
        self.starts[number : number + n], self.sizes[number : number + n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.raw_starts[number : number + n], self.raw_sizes[number : number + n] = self.raw_used + np.cumsum(raw_sizes) - raw_sizes, raw_sizes
        self.used += total
        self.raw_used += raw_total
        self.count += n
        return np.arange(number, number + n)
