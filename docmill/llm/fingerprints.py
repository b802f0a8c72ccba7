"""Document fingerprints by prefix polynomial hashes (operator 5).

For a run of texts, a prefix array holds at place i the polynomial hash, modulo 2^31 - 1, of the first i code points.  Two entries
give the hash of any span in a few operations, wherever the span stands, so span equality is a comparison of numbers and the
longest common extension of two places is found by binary search (``Prefix.extension``).  Two bases make 62 bits.

A fingerprint is a string with three parts, all read off the prefix arrays:

* the number of code points and the hash of the whole text (equal texts have equal fingerprints);
* a *ladder* of hashes of the prefixes of 1, 2, 3, 4, 6, 8, 12, ... code points;
* a *sketch* of the hashes of all spans of ``SPAN`` code points: the least of each of ``BINS`` classes.

The likeness of two texts is the share of their code points, of both together, that stand in common stretches.  Stretches grow out
of *seeds*: both texts' beginnings, their ends, and the places of spans that both sketches hold.  From a seed, the longest common
extension to either side is found by binary search over the prefix arrays, so what counts as common is settled by hashes of whole
stretches; the sketch only says where to look.  ``likeness`` estimates the same from two stored fingerprints alone.

Order: documents descend by id, and the next one after the last is the first.  Ranges of ids become partitions by id itself
(``repartitionById``); a range needs only the first document of the next one besides its own.

Defined cases: null is an empty text, whose fingerprint is like no other's but an empty text's; a text under ``SPAN`` code points
is one span; a text of any length is fingerprinted whole, in a run of its own if it is long; rows with equal ids stand in the order of their texts, null ids last; a single row is next to itself; no rows give
no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.storage import partitions
from docmill.llm.textkernel import mix, row_chunks

PRIME = np.uint64(2**31 - 1)
BASES = (1_000_003_337, 1_729_404_049)
SPAN = 16
BINS = 64
EMPTY = np.uint32(2**32 - 1)
CHUNK = 1 << 19
NULL_ID = -(2**63)
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _reduce(x: np.ndarray) -> np.ndarray:
    """Modulo 2^31 - 1 of numbers under 2^63."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, up to n."""
    if not _tables or len(_tables[0][0]) <= n:
        size = max(n + 1, CHUNK + 1)
        _tables.clear()
        for base in BASES:
            pair = []
            for b in (base, pow(base, -1, int(PRIME))):
                table, done = np.ones(size, np.uint64), 1
                while done < size:  # doubling: b^(done + i) = b^done * b^i
                    take = min(done, size - done)
                    table[done : done + take] = _reduce(table[:take] * np.uint64(pow(b, done, int(PRIME))))
                    done += take
                pair.append(table)
            _tables.append(tuple(pair))
    return _tables


class Prefix:
    """Prefix arrays over code points; ``hash(starts, ends)`` of spans, which may stand in any texts of the run."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.tables = _powers(self.n)
        x = points.astype(np.uint64) + np.uint64(1)
        self.arrays = []
        for power, _ in self.tables:
            out = np.zeros(self.n + 1, np.uint64)
            out[1:] = _reduce(np.cumsum(_reduce(x * power[: self.n])))
            self.arrays.append(out)

    def one(self, k: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a = self.arrays[k]
        return _reduce(_reduce(a[ends] + PRIME - a[starts]) * self.tables[k][1][starts])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans."""
        return self.one(0, starts, ends) << np.uint64(31) | self.one(1, starts, ends)

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The longest common extension of places a and b, up to ``most`` code points, by binary search."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            equal = self.hash(a, a + middle) == self.hash(b, b + middle)
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The longest common stretch that ends before places a and b, up to ``most`` code points."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            equal = self.hash(a - middle, a) == self.hash(b - middle, b)
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)
        return low


RUNGS = np.unique([r for k in range(62) for r in (1 << k, 3 << k >> 1)])[0:]


class Prints:
    """Fingerprints of texts, given as code points and offsets."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        prefix, a, z = Prefix(points), offsets[:-1], offsets[1:]
        self.prefix, self.a, self.z, self.size = prefix, a, z, z - a
        self.whole = prefix.hash(a, z)
        rungs = np.searchsorted(RUNGS, self.size, side="right")
        which = np.arange(int(rungs.sum())) - np.repeat(np.cumsum(rungs) - rungs, rungs)
        start = np.repeat(a, rungs)
        self.rung_at = np.concatenate([[0], np.cumsum(rungs)])
        self.rungs = prefix.hash(start, start + RUNGS[which]).astype(np.uint32)
        spans = np.where(self.size >= SPAN, self.size - SPAN + 1, (self.size > 0).astype(np.int64))
        row = np.repeat(np.arange(len(a)), spans)
        start = np.arange(int(spans.sum())) + np.repeat(a - (np.cumsum(spans) - spans), spans)
        h = mix(prefix.one(0, start, np.minimum(start + SPAN, z[row])) + np.uint64(1))
        # the least hash of each class, and the first place that has it
        least = np.full(len(a) * BINS, np.uint64(EMPTY) << np.uint64(32), np.uint64)
        np.minimum.at(least, row * BINS + (h >> np.uint64(58)).astype(np.int64), (h & np.uint64(0xFFFFFFFE)) << np.uint64(32) | start.astype(np.uint64))
        self.sketch = (least >> np.uint64(32)).astype(np.uint32).reshape(-1, BINS)
        self.places = (least & np.uint64(0xFFFFFFFF)).astype(np.int64).reshape(-1, BINS)

    def likeness(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(likeness, code points of the common prefix) of pairs of texts; no text may be in a list more than once."""
        pair, bin_ = np.nonzero((self.sketch[one] == self.sketch[two]) & (self.sketch[one] != EMPTY))
        every = np.arange(len(one))
        pair = np.concatenate([every, every, pair])
        a = np.concatenate([self.a[one], self.z[one], self.places[one[pair[2 * len(one) :]], bin_]])
        b = np.concatenate([self.a[two], self.z[two], self.places[two[pair[2 * len(one) :]], bin_]])
        of_a, of_b = one[pair], two[pair]
        after = self.prefix.extension(a, b, np.minimum(self.z[of_a] - a, self.z[of_b] - b))
        back = self.prefix.before(a, b, np.minimum(a - self.a[of_a], b - self.a[of_b]))
        common = sum(np.bincount(pair, self._covered(x - back, x + after), len(one)) for x in (a, b))
        total = self.size[one] + self.size[two]
        return np.where(total > 0, common / np.maximum(total, 1), 1.0), after[: len(one)]

    @staticmethod
    def _covered(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each stretch what no stretch before it (in the order of starts) covers."""
        order = np.argsort(starts, kind="stable")
        done = np.maximum.accumulate(np.append(0, ends[order][:-1]))
        out = np.empty(len(starts), np.int64)
        out[order] = np.maximum(ends[order] - np.maximum(starts[order], done), 0)
        return out

    def text(self, i: int) -> str:
        return f"{self.size[i]:x}.{self.whole[i]:016x}.{self.rungs[self.rung_at[i] : self.rung_at[i + 1]].astype('>u4').tobytes().hex()}.{self.sketch[i].astype('>u4').tobytes().hex()}"


def likeness(one: str, two: str) -> float:
    """Of two stored fingerprints, from 0 to 1: an estimate, the larger of the shares of the common prefix (by the ladder, a
    lower bound) and of common spans (by the sketch)."""
    (n, whole, rungs, sketch), (m, other, rungs2, sketch2) = one.split("."), two.split(".")
    n, m = int(n, 16), int(m, 16)
    if n == m and whole == other:
        return 1.0
    if not n or not m:
        return 0.0
    a, b = (np.frombuffer(bytes.fromhex(x), ">u4") for x in (rungs, rungs2))
    low, high = 0, min(len(a), len(b))
    while low < high:  # the rungs up to the common prefix are equal, later ones differ
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[middle - 1] == b[middle - 1] else (low, middle - 1)
    common = int(RUNGS[low - 1]) if low else 0
    s, t = (np.frombuffer(bytes.fromhex(x), ">u4") for x in (sketch, sketch2))
    used = (s != EMPTY) | (t != EMPTY)
    share = float(((s == t) & used).sum()) / int(used.sum())
    return min(max(common / max(n, m), 2 * share / (1 + share)), 1.0)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _concatenated(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """The result for all texts but the last, which is only the next one of the one before."""
    points, n = [_points(t) for t in texts], len(texts) - 1
    edited = [np.concatenate([p[: len(p) - len(p) // 2], q[: len(p) // 2]]) for p, q in zip(points[:-1], points[1:])]
    run = Prints(*_concatenated(points + edited))
    own = np.arange(n)
    (near_edited, prefix_edited), (near_next, prefix_next) = run.likeness(own, n + 1 + own), run.likeness(own, own + 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if i == NULL_ID else i for i in ids[:-1]], pa.int64()),
            pa.array([len(p) for p in points[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
            pa.array([run.text(i) for i in range(n)], pa.string()),
            pa.array([run.text(n + 1 + i) for i in range(n)], pa.string()),
            *(pa.array(x) for x in (near_edited, near_next, prefix_edited, prefix_next)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "prefix_edited", "prefix_next"],
    )


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_edited long, prefix_next long"


def _fingerprint(batches):
    """Rows of a range in order, then the first of the next range, marked."""
    held: tuple[int, str] | None = None
    for batch in batches:
        ids, texts, marks = (batch.column(c).to_pylist() for c in ("doc_id", "text", "mark"))
        if True in marks:
            end = marks.index(True) + 1
            ids, texts = ids[:end], texts[:end]
        sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        for a, b in row_chunks(sizes, CHUNK):
            some = [*([held] if held else []), *zip(ids[a:b], texts[a:b])]
            if len(some) > 1:
                yield _rows([i for i, _ in some], [t for _, t in some])
            held = some[-1]
        if True in marks:
            return


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, the edited text's, its text's likeness to the edited and to the next one, and the code points
    that they have in common from their beginnings on; see the module."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = rows.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    cuts = np.unique(np.array([int(c) for c in cuts], np.int64))

    def part_of(ids: np.ndarray) -> np.ndarray:
        """Parts descend with the ids."""
        return (len(cuts) - np.searchsorted(cuts, ids)).astype(np.int32)

    def parts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(part_of(batch.column("doc_id").to_numpy()))], names=["doc_id", "part"])

    # one number for each part that has rows
    heads = rows.select("doc_id").mapInArrow(parts, "doc_id long, part int").groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    # the head of each part also goes to the part before it, and that of the first to the last
    goes = {r["head"]: heads[i - 1]["part"] for i, r in enumerate(heads)}
    head_ids = np.array(sorted(goes), np.int64)

    def deal(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            columns = [batch.column("doc_id"), batch.column("text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(part_of(ids)), pa.array(np.zeros(len(ids), bool))], names=["doc_id", "text", "part", "mark"])
            at = np.flatnonzero(np.isin(ids, head_ids))
            if len(at):
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in columns), pa.array([goes[i] for i in ids[at].tolist()], pa.int32()), pa.array(np.ones(len(at), bool))], names=["doc_id", "text", "part", "mark"])

    dealt = rows.mapInArrow(deal, "doc_id long, text string, part int, mark boolean")
    return dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("mark", F.desc("doc_id"), "text").mapInArrow(_fingerprint, RESULT)
