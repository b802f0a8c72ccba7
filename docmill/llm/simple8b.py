"""Simple-8b word-aligned integer coding.

A 64-bit word has a selector in its top four bits and, below, as many integers as the selector says, each with as many bits as it
says, the first in the lowest bits.  Selectors 0 and 1 stand for runs of zeros.  The integers are dealt into blocks of ``BLOCK``;
words don't cross blocks, and each block's word offset is kept, so blocks are coded and decoded side by side: a step handles one
word of every block (coding) or all words of one selector (decoding) in one vector operation.  An integer of over 60 bits, or of
60 ones, is an escape: a word of selector 15 with 60 ones, and the integer itself in the word after it.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# Fixed values of the format: bits of each integer, and integers in a word, by selector.
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
ESCAPE = np.uint64(2**60 - 1)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; 61 if it needs an escape."""
    out = np.zeros(len(values), np.uint8)
    for bits in BITS[1:]:
        out += values > np.uint64((1 << int(bits)) - 1)
    # as an index into BITS[1:], the first selector class whose bits suffice
    return np.where(values >= ESCAPE, np.uint8(len(BITS)), out)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, the blocks' offsets into them) of unsigned 64-bit integers."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    need = np.zeros(blocks * BLOCK, np.uint8)
    need[:n] = _widths(values)
    need = need.reshape(blocks, BLOCK)
    # selector s takes values of class s - 1 or less; 0 and 1 those of class 0
    choice = np.full(need.shape, 16, np.uint8)
    most, width = need, 1
    for s in range(15, -1, -1):
        count = int(COUNTS[s])
        while width * 2 <= count:
            most = _slide(most, width)
            width *= 2
        top = most if width == count else _slide(most, count - width)
        choice = np.where(top <= max(s - 1, 0), np.uint8(s), choice)
    steps = np.append(COUNTS, 1)
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    found_block, found_at, found_selector = [], [], []
    while len(live):
        s = choice[live, at[live]]
        found_block.append(live)
        found_at.append(at[live])
        found_selector.append(s)
        at[live] += steps[s]
        live = live[at[live] < length[live]]
    block, place, selector = (np.concatenate(x) for x in (found_block, found_at, found_selector))
    order = np.argsort(block * BLOCK + place, kind="stable")
    block, start, selector = block[order], (block * BLOCK + place)[order], selector[order]
    size = np.where(selector == 16, 2, 1)
    word_at = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            index = start[rows, None] + np.arange(COUNTS[s])
            inside = index < np.minimum((block[rows, None] + 1) * BLOCK, n)
            part = np.where(inside, values[np.minimum(index, n - 1)], np.uint64(0)) << (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
            words[word_at[rows]] = np.bitwise_or.reduce(part, axis=1) | np.uint64(s << 60)
    words[word_at[selector == 1]] = np.uint64(1 << 60)
    rows = np.flatnonzero(selector == 16)
    words[word_at[rows]] = ESCAPE | np.uint64(15 << 60)
    words[word_at[rows] + 1] = values[start[rows]]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(block, size, blocks))])
    return words, bounds.astype(np.uint32)


def _slide(x: np.ndarray, by: int) -> np.ndarray:
    out = x.copy()
    np.maximum(out[:, : x.shape[1] - by], x[:, by:], out=out[:, : x.shape[1] - by])
    return out


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers of whole blocks."""
    out = np.empty(n, np.uint64)
    if not n:
        return out
    escape = np.flatnonzero(words == (ESCAPE | np.uint64(15 << 60)))
    raw = np.zeros(len(words), bool)
    last = -2
    for i in escape.tolist():  # a raw integer may look like an escape; escapes are rare
        if i - 1 != last:
            raw[i + 1], last = True, i
    selector = np.where(raw, 0, words >> np.uint64(60)).astype(np.int64)
    count = np.where(raw, 0, COUNTS[selector])
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    before = np.cumsum(count) - count
    place = before - before[offsets[:-1].astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for s in range(16):
        rows = np.flatnonzero((selector == s) & ~raw)
        if not len(rows):
            continue
        index = place[rows, None] + np.arange(COUNTS[s])
        if s < 2:
            part = np.zeros(index.shape, np.uint64)
        else:
            part = words[rows, None] >> (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64) & np.uint64((1 << int(BITS[s])) - 1)
        inside = index < end[rows, None]
        out[index[inside]] = part[inside]
    rows = np.flatnonzero(raw)
    out[place[rows - 1]] = words[rows]
    return out
