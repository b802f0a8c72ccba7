"""Suffix-array dedup by a depth-limited radix sort (operator 1).

Suffixes are ordered only through their first ``LENGTH`` bytes, by most-significant-digit passes; a pass keeps the groups with
two suffixes or more, and the groups equal after the last pass are exactly the repeated windows.  The digits are:

1. The *anchor* of a window: of its 32-byte grams the one with the least hash (the first of equals).  Equal windows have equal
   anchors at equal places.  Windows that follow each other and share an anchor form a *span*, so one digit stands for some
   35 suffixes; an anchor that occurs once ends all of its suffixes.
2. The whole span: equal spans have all of their windows equal.  Of a class of equal spans only the first is sorted further.
3. For first spans whose anchor stands in other spans too, the windows themselves, by two digits: either is a fingerprint of
   the window's first and last 64 bytes, which together cover it.

Within a block the passes go on with the bytes themselves, eight of them a digit, over the groups that still have others, so what
is equal there is equal byte by byte.  Between blocks, digits go through the block exchange (``docmill.llm.blocks``): a block sends each
distinct one once, with the smallest document that holds it there, so a passage of a third of all documents is as cheap in a
bucket as any other.  There spans and windows are told apart by two hashes of 64 bits, each of all of their bytes and of a family of
its own, so neither a shared part nor an equal hash of one family makes the other hash equal.  A suffix is repeated if its group has
an earlier member.

Defined cases: null and texts under ``LENGTH`` bytes lose nothing; a text of any length is judged whole, in a block of its own if it
is longer than one; rows with equal ids are ordered by text; columns beside id and text are not looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from docmill.llm.blocks import Blocks, answer_of, answered, decode, encode_answer, split, unpack
from docmill.llm.labelled import others
from docmill.llm.storage import stored, tidy
from docmill.llm.textkernel import mix, utf8

LENGTH = 100
GRAM = 32
SPAN, ANCHOR, WINDOW = 0, 1, 2
SHARED = np.int32(2**31 - 1)

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_E, _F = (np.uint64(x) for x in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5))


def msd_groups(digits: list, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Most-significant-digit radix order of items: (order, group number of each ordered item, size of its group).

    A digit is an array, or a function that gives the digits of some items.  Each pass orders by one more digit only the items whose
    group still has others.  Within a group items stand by ``rank``.
    """
    n = len(rank)
    order = np.argsort(digits[0], kind="stable")
    first = np.ones(n, bool)
    if n:
        d = digits[0][order]
        first[1:] = d[1:] != d[:-1]
    for digit in [*digits[1:], rank]:
        group = np.cumsum(first)
        alone = first & np.append(first[1:], True)
        live = np.flatnonzero(~alone)
        if not len(live):
            break
        items = order[live]
        own = digit(items) if callable(digit) else digit[items]
        again = np.lexsort((own, group[live]))
        order[live] = items[again]
        if digit is not rank:
            d, g = own[again], group[live]
            first[live] = np.append(True, (d[1:] != d[:-1]) | (g[1:] != g[:-1]))
    group = np.cumsum(first) - 1
    return order, group, np.bincount(group, minlength=1)[group] if n else group


def byte_digits(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list:
    """The bytes of spans as digits, eight of them at a time, the first the most significant; ``words``: those from each place."""

    def digit(k: int):
        def of(items: np.ndarray) -> np.ndarray:
            at = np.minimum(starts[items] + 8 * k, ends[items])
            rest = np.minimum(ends[items] - at, 8).astype(np.uint64)
            own = words[at].byteswap()
            return np.where(rest == 0, np.uint64(0), own >> (np.uint64(8) * (np.uint64(8) - np.maximum(rest, np.uint64(1)))))

        return of

    return [digit(k) for k in range(-(-int((ends - starts).max(initial=0)) // 8))]


class Spans:
    """The windows of a block's texts, in spans, and their digits."""

    def __init__(self, payload, length: int = LENGTH):
        rows = self.rows = unpack(payload)
        self.ids = rows.column("doc_id").to_numpy()
        self.data, self.offsets = utf8(rows.column("text"))
        self.length = length
        n = len(self.data)
        padded = np.zeros(n + 256, np.uint8)
        padded[:n] = self.data
        m = n + 128
        self.words = np.ndarray(m + 64, "<u8", padded[: m + 72].tobytes(), strides=(1,))
        h8 = self.words.astype(np.uint64)
        h32, self.h64 = _fingerprints(h8, m, _A, _B)
        self.g64 = _fingerprints(h8, m, _E, _F)[1]
        sizes = np.diff(self.offsets)
        windows = np.maximum(sizes - length + 1, 0)
        skipped = np.concatenate([[0], np.cumsum(windows)])[:-1]
        self.starts = np.arange(int(windows.sum())) + np.repeat(self.offsets[:-1] - skipped, windows)
        place = np.arange(n, dtype=np.uint64)
        low = ((h32[:n] * _C) >> np.uint64(32) << np.uint64(32)) | place
        least = _sliding_min(low, length - GRAM + 1)[self.starts] & np.uint64(0xFFFFFFFF)
        edge = np.ones(len(self.starts), bool)
        edge[1:] = (least[1:] != least[:-1]) | (np.diff(self.starts) != 1)
        self.first = np.flatnonzero(edge)
        self.last = np.append(self.first, len(self.starts))[1:] - 1
        a, z = self.starts[self.first], self.starts[self.last] + length
        anchor = least[self.first].astype(np.int64)
        self.gram = mix(h32[anchor])
        middle = (a + z - 64) // 2
        place = ((z - a) * 256 + anchor - a).astype(np.uint64) * _D
        self.whole, self.second = (mix(h[a] * _A + h[middle] * _B + h[z - 64] * _C + place) for h in (self.h64, self.g64))
        # classes of equal spans, each by its first member, in the order of their digit
        order, group, _ = msd_groups([self.whole, place, *byte_digits(self.words, a, z)], np.arange(len(a)))
        lead = np.append(True, group[1:] != group[:-1]) if len(a) else np.empty(0, bool)
        self.classes = order[lead]
        self.copies = order[~lead]
        order, group, size = msd_groups([self.gram[self.classes]], np.arange(len(self.classes)))
        lead = np.append(True, group[1:] != group[:-1]) if len(order) else np.empty(0, bool)
        self.grams = self.gram[self.classes][order[lead]]
        self.gram_of_class = np.empty(len(order), np.int64)
        self.gram_of_class[order] = group
        self.varied = size[lead] > 1

    def doc(self, window: np.ndarray) -> np.ndarray:
        """The document ids of windows."""
        return self.ids[np.searchsorted(self.offsets, self.starts[window], side="right") - 1]

    def wide(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of spans, first of equals (their digits, in digit order), and all others of them."""
        spans = np.sort(classes)
        counts = self.last[spans] - self.first[spans] + 1
        windows = np.arange(int(counts.sum())) + np.repeat(self.first[spans] - np.concatenate([[0], np.cumsum(counts)])[:-1], counts)
        s = self.starts[windows]
        one, two = (mix(h[s] * _A + h[s + self.length - 64] * _B) for h in (self.h64, self.g64))
        order, group, _ = msd_groups([one, *byte_digits(self.words, s, s + self.length)], windows)
        lead = np.append(True, group[1:] != group[:-1]) if len(order) else np.empty(0, bool)
        kept = order[lead]
        return windows[kept], one[kept], two[kept], windows[order[~lead]]

    def open_classes(self, answers) -> tuple[np.ndarray, np.ndarray]:
        """Of the classes: which have an earlier member in another block; which first ones share their anchor with others."""
        spans, grams = answer_of(answers, SPAN, "<i4"), answer_of(answers, ANCHOR, "<i4")
        later = spans < 0
        return later, ~later & (grams[self.gram_of_class] > np.abs(spans))

    def repeated(self, answers) -> np.ndarray:
        """For each window whether it also starts earlier."""
        flags = np.zeros(len(self.starts) + 1, np.int32)
        later, is_open = self.open_classes(answers)
        whole = np.concatenate([self.copies, self.classes[later]])
        np.add.at(flags, self.first[whole], 1)
        np.add.at(flags, self.last[whole] + 1, -1)
        out = np.cumsum(flags[:-1]) > 0
        windows, _, _, others = self.wide(self.classes[is_open])
        out[others] = True
        out[windows[answer_of(answers, WINDOW, "<i4") < 0]] = True
        return out


def _fingerprints(h8: np.ndarray, m: int, a: np.uint64, b: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Of the 32 and of the 64 bytes from each place, in the family of a and b; ``h8``: the 8 bytes from each place."""
    h16 = _join(h8[: m + 48], h8[8 : m + 56], a, b)
    h32 = _join(h16[: m + 32], h16[16 : m + 48], a, b)
    return h32, _join(h32[:m], h32[32 : m + 32], a, b)


def _join(left: np.ndarray, right: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    x = left * a
    x ^= x >> np.uint64(29)
    x += right * b
    x ^= x >> np.uint64(32)
    return x


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``values[i : i + width]`` for each i (near the end: of fewer)."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _merge(kind: int, payloads: list) -> list[bytes]:
    """The answers of a bucket.  Spans, windows: in how many blocks the group is, negative if the first is in another one.
    Anchors: in how many blocks the gram is, or SHARED if a block has it in different spans."""
    if kind == ANCHOR:
        parts = [decode(p, "u1") for p in payloads]
        keys, varied = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.argsort(keys, kind="stable")
        edge = np.append(True, keys[order][1:] != keys[order][:-1])
        group = np.cumsum(edge) - 1
        count = np.where(np.maximum.reduceat(varied[order], np.flatnonzero(edge)) > 0, SHARED, np.bincount(group))
        out = np.empty(len(keys), "<i4")
        out[order] = count[group]
    else:
        parts = [decode(p, "<u8", "<i8") for p in payloads]
        keys, more, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
        sizes = [len(p[0]) for p in parts]
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((np.repeat(np.arange(len(parts)), sizes), ids))] = np.arange(len(keys))
        order, group, size = msd_groups([keys, more], rank)
        lead = np.append(True, group[1:] != group[:-1])
        out = np.empty(len(keys), "<i4")
        out[order] = np.where(lead, size, -size)
    bounds = np.cumsum([0, *(len(p[0]) for p in parts)])
    return [encode_answer(out[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def _spans(docs: DataFrame, finish, schema, id_col: str, text_col: str, length: int, carry: Column | None = None) -> DataFrame:
    blocks = Blocks(docs, "suffixes", id_col, text_col, carry)
    buckets = blocks.buckets

    def digits(block, payload):
        x = Spans(payload, length)
        yield from split(SPAN, buckets, x.whole[x.classes], x.second[x.classes], x.doc(x.first[x.classes]))
        yield from split(ANCHOR, buckets, x.grams, x.varied.astype("u1"))

    first = blocks.few(answered(blocks.send(digits), _merge, buckets))
    first = stored(first, f"{blocks.root}/first")

    def windows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = Spans(row["payload"], length)
                _, is_open = x.open_classes(row["answers"])
                places, one, two, _ = x.wide(x.classes[is_open])
                rows = list(split(WINDOW, buckets, one, two, x.doc(places)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([row["block"]] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["kind", "bucket", "block", "payload"],
                )

    second = blocks.few(answered(blocks.with_answers(first).mapInArrow(tidy(windows), "kind int, bucket int, block long, payload binary"), _merge, buckets))
    second = stored(second, f"{blocks.root}/second")

    def last(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = Spans(row["payload"], length)
                hits = x.starts[x.repeated(row["answers"])]
                cover = np.zeros(len(x.data) + 1, np.int32)
                cover[hits] += 1
                np.subtract.at(cover, hits + length, 1)
                yield finish(x, np.cumsum(cover[:-1]) > 0)

    return blocks.few(blocks.with_answers(first, second).mapInArrow(tidy(last), schema))


def _ids(x: Spans) -> pa.Array:
    return pa.array(x.ids, pa.int64(), mask=x.ids == -(2**63))


def _digest(x: Spans, removed: np.ndarray) -> pa.RecordBatch:
    sizes, cut, runs, digests = np.diff(x.offsets), [], [], []
    for a, b in zip(x.offsets[:-1], x.offsets[1:]):
        gone = removed[a:b]
        cut.append(int(gone.sum()))
        runs.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum()) if cut[-1] else 0)
        digests.append(hashlib.sha256((x.data[a:b][~gone] if cut[-1] else x.data[a:b]).tobytes()).hexdigest())
    return pa.RecordBatch.from_arrays([_ids(x), pa.array(sizes, pa.int64()), pa.array(cut, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(x: Spans, removed: np.ndarray) -> pa.RecordBatch:
    """The kept texts.  A character goes only if all of its bytes go, so the result is text again."""
    lead = np.flatnonzero((x.data & 0xC0) != 0x80)
    if len(lead):
        whole = np.logical_and.reduceat(removed, lead)
        removed = np.repeat(whole, np.diff(np.append(lead, len(x.data))))
    kept = ~removed
    offsets = np.concatenate([[0], np.cumsum(kept)])[x.offsets]
    texts = pa.LargeStringArray.from_buffers(len(x.ids), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(x.data[kept].tobytes()))
    cut = np.diff(x.offsets) - np.diff(offsets)
    return pa.RecordBatch.from_arrays([_ids(x), texts.cast(pa.string()), pa.array(cut, pa.int64()), x.rows.column("row")], names=["doc_id", "kept_text", "n_removed", "row"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    return _spans(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col, length)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """For each row: doc_id, kept_text (whole characters), n_removed (bytes), and its other columns in ``row``."""
    carry = others(docs, text_col)
    schema = T._parse_datatype_string("doc_id long, kept_text string, n_removed long")
    return _spans(docs, _texts, T.StructType([*schema.fields, T.StructField("row", docs.select(carry.alias("r")).schema["r"].dataType)]), id_col, text_col, length, carry)
