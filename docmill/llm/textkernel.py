"""Vectorised byte and word kernels shared by the corpus operators.

Texts come as Arrow string columns.  A *chunk* is a run of rows whose texts hold about ``CHUNK_BYTES`` bytes (a longer text is
a chunk of its own), so the numpy temporaries of a task are bounded by the longest text and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: What a span's length adds, and the last bytes of an 8-byte load that a shorter rest does not reach.
_SIZE = np.uint64(0x9E3779B97F4A7C15)
_REST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one, with XXH3.
LONG_SPAN = 64


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and the n + 1 offsets of its rows; null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) with at most ``chunk_bytes`` bytes each, but at least one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + chunk_bytes, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def text_chunks(batches, column: str = "text", chunk_bytes: int = CHUNK_BYTES):
    """(record batch of a chunk, its bytes, its offsets) for each chunk of each batch."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        for a, b in row_chunks(offsets, chunk_bytes):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Separators of plain words: all of ASCII but letters and digits.
NOT_ALPHANUMERIC = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the n + 1 offsets of the rows into them.  Words do not cross rows."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    edges = offsets[1:-1]
    first[edges[edges < n]] = True
    last[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, each a family of its own by ``seed``; ``lower`` takes A-Z as a-z.

    A span's bytes go in eight at a time, each time through a bijection of the state, so that no two spans of up to eight bytes
    and one length share a hash, and longer ones by chance alone (there are no texts that collide under every seed).
    """
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))
    size = ends - starts
    out = mix((eight[starts] & _REST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) + np.uint64(1 + (seed << 40))) * _SIZE)
    at = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    done = 8
    while len(at):
        out[at] = mix(out[at] * _SIZE ^ eight[starts[at] + done] & _REST[np.minimum(size[at] - done, 8)])
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].data, seed)
    return out


def row_of(word_offsets: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))


_SHINGLE = _rng.integers(2**62, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, word_offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each row, and the rows' offsets into them.

    A row with fewer words, but one at least, has its whole sequence as its single run; a row without words has none.
    """
    counts = np.diff(word_offsets)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    run_offsets = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(run_offsets[-1]) - np.repeat(run_offsets[:-1] - word_offsets[:-1], runs)
    length = np.repeat(np.minimum(counts, size), runs)
    total = length.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    short = bool((counts < size).any())
    for k in range(size):
        part = padded[at + k] * _SHINGLE[k]
        if short:
            part = np.where(length > k, part, np.uint64(0))
        total = total + part
    return mix(total), run_offsets
