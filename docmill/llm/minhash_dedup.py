"""MinHash near-dedup by min-max hashing, with links confirmed on full sets (operator 8).

A document's set has the hashes of its five-word shingles, 128 bits each.  Each permutation yields two signature values, the
least and the largest image of the set; either is equal between two sets with the probability of their Jaccard similarity, so
half the hash evaluations give as many values, of which bands are made.  Bands only propose: ``band_plan`` takes so many that a
pair at the threshold is missed with a probability under a millionth.  (The two values of a permutation are equal together less
often than independent ones would be, which only lowers the chance that all bands miss; a band has values of one kind.)

1. Equal sets fall into one class, so thousands of copies go on as one row.
2. Classes that share a band key are tied to the least class of that bucket (a star, never all pairs).  The connected
   components of the stars are candidate clusters; every proposed pair lies within one.
3. Only then do texts travel: each class' once, to its cluster.  A cluster of over ``PART`` classes, or ``PART_SHINGLES``
   shingles, is dealt by hash into parts, and each pair of parts is a task of its own, so no task holds more than two parts,
   however large the cluster; the tasks of one cluster go round the partitions in turn.  A task finds the pairs that can reach
   the threshold at all by their sizes and their rarest shingles (two sets that similar share one of the rarest few), counts
   these pairs' exact intersections, those across its two parts only, and returns a spanning forest of the links.
4. The components of the forests are the answer.

Defined cases: null, empty and wordless texts have an empty set (n_shingles 0) and are linked with nothing; one to four words
are one shingle; a text of any length is one set, whose shingles one task holds; rows with equal ids are one document; rows
without an id are linked with nothing, have no component and are kept; other columns are not looked at; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.components import connected, forest
from docmill.llm.storage import partitions, shared_root, stored, tidy
from docmill.llm.textkernel import mix, shingle_hashes, span_hashes, text_chunks, word_spans

WORDS = 5
MISS = 1e-6
PART, PART_SHINGLES = 256, 500_000
BROADCAST_ROWS = 100_000
NULL_ID = -(2**63)


def band_plan(percent: int) -> tuple[int, int]:
    """(rows of a band, number of bands) that miss a pair at the threshold with a probability of at most ``MISS``."""
    t = percent / 100
    rows = 7 if percent >= 85 else 6
    return rows, math.ceil(math.log(MISS) / math.log(1 - t**rows))


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (128-bit hashes), in order of their first halves."""
    order = np.argsort(a)
    a, b = a[order], b[order]
    same = a[1:] == a[:-1]
    if (b[1:][same] != b[:-1][same]).any():
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    keep = np.append(True, ~same)[: len(a)]
    return a[keep], b[keep]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row its distinct shingles: the two halves of their hashes, which are of two families."""
    starts, ends, word_offsets = word_spans(data, offsets)
    halves = [shingle_hashes(span_hashes(data, starts, ends, seed=seed), word_offsets, WORDS) for seed in (0, 1)]
    (one, at), (two, _) = halves
    return [distinct(one[a:b], two[a:b]) for a, b in zip(at[:-1], at[1:])]


class MinMax:
    """Signatures of ``bands`` x ``rows`` values out of half as many permutations of the 32-bit words."""

    def __init__(self, rows: int, bands: int):
        self.rows, self.bands = rows, bands
        r = np.random.Generator(np.random.PCG64(85))
        n = (rows * bands + 1) // 2
        self.factor, self.shift = r.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)
        self.weight = r.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of rows * bands values for each of the sets, of which none is empty."""
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
        n = len(self.factor)
        out = np.empty((2 * n, len(sets)), np.uint32)
        for k in range(n):
            image = x * self.factor[k] + self.shift[k]
            out[k] = np.minimum.reduceat(image, at)
            out[n + k] = np.maximum.reduceat(image, at)
        return out[: self.rows * self.bands].T

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of band keys for each set."""
        values = self.signatures(sets).reshape(len(sets), self.bands, self.rows).astype(np.uint64)
        total = (values * self.weight).sum(axis=2, dtype=np.uint64)
        return mix(total + np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _sketch(plan: tuple[int, int]):
    def run(batches):
        minmax = MinMax(*plan)
        for batch, data, offsets in text_chunks(batches):
            found = shingle_sets(data, offsets)
            sets, others = [s for s, _ in found], [s for _, s in found]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            if some:
                for i, row in zip(some, minmax.keys([sets[i] for i in some])):
                    keys[i] = row
            known = (batch.column("doc_id").to_numpy() != NULL_ID).tolist()
            prints = [xxhash.xxh3_128_digest(s.tobytes() + other.tobytes()) if len(s) and k else None for s, other, k in zip(sets, others, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "print", "bands"],
            )

    return run


class Group:
    """The sets of one task, their shingles numbered by rarity, those of a set in that order."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.sizes = np.array([len(s) for s, _ in sets])
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        one, two = (np.concatenate([s[i] for s in sets]) for i in (0, 1))
        order = np.argsort(one, kind="stable")
        a, b = one[order], two[order]
        if (b[1:] != b[:-1])[a[1:] == a[:-1]].any():
            order = np.lexsort((two, one))
            a, b = one[order], two[order]
        number = np.empty(len(one), np.int64)
        number[order] = np.cumsum(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) - 1
        counts = np.bincount(number)
        rare = np.argsort(counts, kind="stable")
        rank = np.empty(len(rare), np.int64)
        rank[rare] = np.arange(len(rare))
        self.count = counts[rare]
        self.row = np.repeat(np.arange(len(sets)), self.sizes)
        self.terms = np.sort(self.row * len(rare) + rank[number]) - self.row * len(rare)

    def postings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each term, of the chosen places: (rows by term, the terms' offsets)."""
        at = np.flatnonzero(chosen)
        order = at[np.argsort(self.terms[at], kind="stable")]
        return self.row[order], np.concatenate([[0], np.cumsum(np.bincount(self.terms[order], minlength=len(self.count)))])


def _rows_of(terms: np.ndarray, postings: np.ndarray, start: np.ndarray) -> np.ndarray:
    a, counts = start[terms], start[terms + 1] - start[terms]
    places = np.arange(int(counts.sum())) + np.repeat(a - (np.cumsum(counts) - counts), counts)
    return postings[places]


def links_of(sets: list[tuple[np.ndarray, np.ndarray]], percent: int, left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x < y) with 100 * intersection >= percent * union; with ``left``, x is of the first so many sets and y of the rest."""
    group, n = Group(sets), len(sets)
    sizes, at = group.sizes, group.at
    # a pair at the threshold shares at least one of either set's rarest size - ceil(percent * size / 100) + 1 shingles
    prefix = sizes + (-percent * sizes // 100) + 1
    place = np.arange(at[-1]) - at[:-1][group.row]
    right = group.row >= (left or 0)
    probe, probe_at = group.postings(right & (place < prefix[group.row]) & (group.count[group.terms] > 1))
    full = None
    xs, ys = [], []
    for x in range(n - 1 if left is None else left):
        terms = group.terms[at[x] : at[x] + prefix[x]]
        found = _rows_of(terms, probe, probe_at)
        found = found[found > x]
        found = found[100 * np.minimum(sizes[x], sizes[found]) >= percent * np.maximum(sizes[x], sizes[found])]
        if len(found):
            full = full or group.postings(right)
            found = np.unique(found)
            common = np.bincount(_rows_of(group.terms[at[x] : at[x + 1]], *full), minlength=n)[found]
            found = found[100 * common >= percent * (sizes[x] + sizes[found] - common)]
            xs += [x] * len(found)
            ys += found.tolist()
    return np.array(xs, np.int64), np.array(ys, np.int64)


def _confirm(percent: int):
    def links(rows: list[tuple[int, int, tuple]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[:2])  # by part and id
        nodes = np.array([r[1] for r in rows], np.int64)
        left = sum(r[0] == rows[0][0] for r in rows)
        a, b = links_of([r[2] for r in rows], percent, None if left == len(rows) else left)
        # the forest's root should be the least id
        order = np.argsort(nodes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        root = forest(len(nodes), place[a], place[b])
        moved = root != np.arange(len(nodes))
        nodes = nodes[order]
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["u", "v"])

    def run(batches):
        """Rows stand sorted by cluster and pair of parts, which may go on in the next batch."""
        task, rows = None, []
        for batch, data, offsets in text_chunks(batches):
            sets = shingle_sets(data, offsets)
            for key, part, doc_id, own in zip(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j"))), batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), sets):
                if key != task:
                    if len(rows) > 1 and (task[1] == task[2] or len({r[0] for r in rows}) > 1):
                        yield links(rows)
                    task, rows = key, []
                if len(own[0]):
                    rows.append((part, doc_id, own))
        if len(rows) > 1 and (task[1] == task[2] or len({r[0] for r in rows}) > 1):
            yield links(rows)

    return run


def _few(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers for a join: to all tasks if some 4 MB hold them, else both sides are shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (least id reachable by links), kept (it is that id) and text_hash (Spark's
    xxhash64 of the text, which tells rows with equal ids apart)."""
    spark = docs.sparkSession
    root = shared_root(spark, "minhash")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    plan = band_plan(percent)
    sketches = stored(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(tidy(_sketch(plan)), "doc_id long, text_hash long, n_shingles long, print binary, bands array<long>"), f"{root}/sketches")

    some = sketches.where("print is not null")
    classes = stored(some.groupBy("print").agg(F.min("doc_id").alias("class")), f"{root}/classes")
    of_class = some.select("print", F.col("doc_id").alias("class"), "bands").join(classes, ["print", "class"]).select("class", F.explode("bands").alias("key"))
    buckets = stored(of_class.groupBy("key").agg(F.min("class").alias("pivot"), F.max("class").alias("last")).where("pivot <> last").select("key", "pivot"), f"{root}/buckets")
    stars = of_class.join(buckets, "key").where("class <> pivot").select(F.col("class").alias("u"), F.col("pivot").alias("v")).distinct()
    clusters = connected(stars, f"{root}/clusters")

    nodes = clusters.select(F.col("u").alias("doc_id"), F.col("v").alias("cluster")).unionByName(clusters.select(F.col("v").alias("doc_id"), F.col("v").alias("cluster")).distinct())
    sized = some.select("print", F.col("doc_id").alias("class"), "n_shingles").join(classes, ["print", "class"]).groupBy(F.col("class").alias("doc_id")).agg(F.max("n_shingles").alias("size"))
    # merged by hash: a broadcast would read the nodes as their files lie, and a large cluster lies in one
    sizes = nodes.join(sized.hint("merge"), "doc_id").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / part), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int").alias("parts"))
    # clusters of one part, nearly all, need no number; of the others there is one for hundreds of nodes
    large = stored(sizes.where("parts > 1"), f"{root}/large")
    nodes = nodes.join(_few(large), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    nodes = stored(nodes.select("doc_id", "cluster", "parts", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part")), f"{root}/nodes")
    own = F.col("part")
    sent = rows.join(_few(nodes), "doc_id").where("text is not null").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    sent = sent.select("cluster", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), own, "doc_id", "text", "parts")
    # the pairs of a cluster's parts, one after the other, go round the partitions in turn
    n = partitions(spark)
    turn = F.pmod(F.xxhash64("cluster") + F.col("i").cast("long") * F.col("parts") - F.expr("i * (i + 1) div 2") + F.col("j"), F.lit(n)).cast("int")
    sent = sent.repartitionById(n, turn).select("cluster", "i", "j", "part", "doc_id", "text")
    links = sent.sortWithinPartitions("cluster", "i", "j").mapInArrow(tidy(_confirm(percent)), "u long, v long").distinct()
    components = connected(links, f"{root}/components", contract=False)

    out = sketches.select("doc_id", "text_hash", "n_shingles", "print").join(classes, "print", "left")
    out = out.join(components.select(F.col("u").alias("class"), F.col("v").alias("least")), "class", "left")
    component = F.coalesce("least", "class", "doc_id")
    shown = lambda c: F.when(c != NULL_ID, c)
    return out.select(shown(F.col("doc_id")).alias("doc_id"), "n_shingles", shown(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"), "text_hash")
