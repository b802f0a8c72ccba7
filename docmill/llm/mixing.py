"""Mixing sources to target weights by iterative proportional fitting (operator 9).

The cells of a corpus are its combinations of source, language and topic.  Their token masses are counted over all documents,
then raked: the weights are scaled to meet the targets of one margin after the other, again and again, until all three hold.
A document is kept with a probability of its cell, raked to the targets' shares of the ``budget`` under the bound of 1, and by a
number between 0 and 1 that depends on its id alone, so the sample can be made anew.  A category that has fewer tokens than its
share of the budget is kept whole, and the others of its margin share the rest by their targets.

Targets default to the margins' own shares to the power ``TEMPER``, which lifts small sources and languages against large ones.
Given targets may name some of a margin's categories only: the others keep their own shares, and the named ones share what is
left of the margin in proportion to their targets.  ``margin_gap`` beside each row says by how much a margin's weighted share
misses its target at most: near 0, or more where no weights of the given cells meet all targets at once.

Topics are ``TOPICS`` clusters of all documents, by spherical k-means over word vectors: a word weighs by one plus the logarithm
of its count in the text, and by its inverse document frequency (exact counts over all documents, of words hashed to 2^18 slots),
and adds to one of ``DIMS`` coordinates by another part of its hash, with a sign.  The first centres are the sums of the vectors by their sides
of the mean in three principal directions, then ``TURNS`` rounds of means follow, each over all documents.  What tasks send is
sums of fixed size.

Up to ``CELLS`` cells (of sources times languages times ``TOPICS`` at most) are raked on the driver.  More stay in tables: margins are
aggregated and steps joined back, to a gap of ``FRAME_CLOSE``, and documents meet their cells in a join.  Nothing is dropped.

Defined cases: null sources and languages are a source and a language; null, empty and wordless texts have topic 0 and no tokens, a
cell without tokens keeps its documents with probability 1; a text of any length is counted whole; rows with equal ids are kept
or left together; no rows give no rows; the columns of the documents pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.labelled import others
from docmill.llm.storage import partitions, shared_root, stored, tidy
from docmill.llm.textkernel import row_of, span_hashes, text_chunks, word_spans

TOPICS, DIMS, TURNS = 8, 128, 4
SLOT_BITS, SLICES = 18, 64
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.7}
BUDGET = 0.8
CELLS = 100_000
ROUNDS, CLOSE = 1000, 1e-9
FRAME_ROUNDS, FRAME_CLOSE = 100, 1e-4
MARGINS = ("source", "lang", "topic")
SLICE_SCHEMA = "slice int, payload binary"


def slots_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct words of each row, and the rows' numbers of words."""
    starts, ends, at = word_spans(data, offsets)
    hashes, row = span_hashes(data, starts, ends), row_of(at)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[: len(row)])
    return row[first], hashes[first], np.diff(np.append(first, len(row))), np.diff(at)


def vectors_of(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vector of each row, its number of words); zeros without words, or if all of them are in every document."""
    row, hashes, count, n = slots_of(data, offsets)
    weight = (1 + np.log(count)) * idf[hashes >> np.uint64(64 - SLOT_BITS)]
    weight = np.where(hashes & np.uint64(1 << 20), weight, -weight)
    at = row * DIMS + (hashes >> np.uint64(8)).astype(np.int64) % DIMS
    out = np.bincount(at, weight, len(n) * DIMS).reshape(-1, DIMS)
    # in whole numbers, so that sums do not depend on their order
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.rint(out / np.maximum(length, 1e-9) * 1000).astype(np.int32), n


def topics_of(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, the first of equals; 0 for no vector."""
    return np.argmax(vectors @ centres.T, axis=1).astype(np.int32)


def _summed(rows: DataFrame, payload_rows: int) -> dict[int, np.ndarray]:
    """The sums of whole numbers that tasks give in slices; as many numbers reach the driver as one task has."""

    def add(batches):
        own, total = None, None
        for batch in batches:
            for k, payload in zip(batch.column("slice").to_pylist(), batch.column("payload").to_pylist()):
                if k != own and own is not None:
                    yield _slice(own, total)
                    total = None
                own, values = k, np.frombuffer(payload, "<i8")
                total = values if total is None else total + values
        if own is not None:
            yield _slice(own, total)

    n = min(payload_rows, partitions(rows.sparkSession))
    found = rows.repartitionById(n, F.col("slice") % n).sortWithinPartitions("slice").mapInArrow(add, SLICE_SCHEMA).collect()
    return {r["slice"]: np.frombuffer(r["payload"], "<i8") for r in found}


def _slice(k: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([values.astype("<i8").tobytes()], pa.binary())], names=["slice", "payload"])


def frequencies(texts: DataFrame) -> np.ndarray:
    """The inverse document frequency of each word slot, over all documents."""

    def count(batches):
        total, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch, data, offsets in text_chunks(batches):
            row, hashes, _, words = slots_of(data, offsets)
            slots = np.unique(row << SLOT_BITS | (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
            total += np.bincount(slots & (1 << SLOT_BITS) - 1, minlength=1 << SLOT_BITS)
            n += int((words > 0).sum())
        for k, part in enumerate(np.array_split(total, SLICES)):
            if n:
                yield _slice(k, np.append(part, n))

    found = _summed(texts.mapInArrow(tidy(count), SLICE_SCHEMA), SLICES)
    if not found:
        return np.zeros(1 << SLOT_BITS)
    return np.log((found[0][-1] + 1) / (np.concatenate([found[k][:-1] for k in range(SLICES)]) + 1))


def _vectors(batches):
    """All vectors but those of wordless texts, as whole numbers."""
    for batch in batches:
        raw = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i2").reshape(-1, DIMS).astype(np.int64)
        yield raw[raw.any(1)]


def principal(moments: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, the three directions of largest variance) of n vectors, from the sums of their products and of themselves."""
    mean = moments[DIMS] / n
    _, directions = np.linalg.eigh(moments[:DIMS] / n - np.outer(mean, mean))
    directions = directions[:, ::-1][:, :3]
    return mean, directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(3)])


def centres_of(vectors: DataFrame) -> np.ndarray:
    """The topics' centres, by rounds of means over a stored table of vectors."""

    def moments(batches):
        total, n = np.zeros((DIMS + 1, DIMS), np.int64), 0
        for raw in _vectors(batches):
            total[:DIMS] += (raw.T.astype(float) @ raw).astype(np.int64)  # whole numbers below 2^53
            total[DIMS] += raw.sum(0)
            n += len(raw)
        if n:
            yield _slice(0, np.append(total.ravel(), n))

    found = _summed(vectors.mapInArrow(tidy(moments), SLICE_SCHEMA), 1)
    if not found:
        return np.zeros((TOPICS, DIMS))
    mean, sides = principal(found[0][:-1].reshape(DIMS + 1, DIMS), int(found[0][-1]))

    def sums(centres):
        def run(batches):
            total = np.zeros((TOPICS, DIMS), np.int64)
            for raw in _vectors(batches):
                topic = ((raw - mean) @ sides > 0) @ np.array([1, 2, 4]) if centres is None else topics_of(raw, centres)
                np.add.at(total, topic, raw)
            for k in range(TOPICS):
                yield _slice(k, total[k])

        return tidy(run)

    centres = None
    for _ in range(TURNS + 1):
        found = _summed(vectors.mapInArrow(sums(centres), SLICE_SCHEMA), TOPICS)
        own = np.array([found.get(k, np.zeros(DIMS)) for k in range(TOPICS)], float)
        length = np.sqrt((own * own).sum(1, keepdims=True))
        # a topic that has lost all documents stays where it was
        centres = np.where(length > 0, own / np.maximum(length, 1e-9), 0.0 if centres is None else centres)
    return centres


def rake(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Factors of cells that bring the masses' margins to the targets (shares of each category, by its code), and the largest
    difference of shares that is left: near 0, or more if no weights of these cells meet all targets."""
    factor, total = np.ones(len(mass)), mass.sum()
    gaps = lambda: max(float(np.abs(np.bincount(code, mass * factor, len(target)) / total - target).max(initial=0.0)) for code, target in zip(codes, targets))
    for _ in range(ROUNDS):
        for code, target in zip(codes, targets):
            now = np.bincount(code, mass * factor, len(target)) / total
            factor *= np.divide(target, now, out=np.ones_like(now), where=now > 0)[code]
        gap = gaps()
        if gap < CLOSE:
            break
    return factor, gap


def probabilities(mass: np.ndarray, factor: np.ndarray, budget: float) -> np.ndarray:
    """min(1, scale * factor), with the scale that makes the expected mass ``budget`` of all."""
    want, low, high = budget * mass.sum(), 0.0, 1.0
    if not want:
        return np.ones(len(mass))
    while (mass * np.minimum(1, high * factor)).sum() < want and high < 2.0**60:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (mass * np.minimum(1, middle * factor)).sum() < want else (low, middle)
    return np.where(mass > 0, np.minimum(1, high * factor), 1.0)


def _steps(mass: np.ndarray, factor: np.ndarray, code: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each category the step that makes the mass of min(1, step * factor) what it should be."""
    part = mass * factor
    own = np.bincount(code, part, len(want))
    step = np.divide(want, own, out=np.ones_like(want), where=own > 0)
    for _ in range(60):  # Newton's method from below on a concave function of straight pieces
        scaled = factor * step[code]
        slope = np.bincount(code, part * (scaled < 1), len(want))
        short = want - np.bincount(code, mass * np.minimum(1, scaled), len(want))
        more = np.divide(short, slope, out=np.zeros_like(want), where=slope > 0).clip(0)
        if (more <= 1e-13 * step).all():
            break
        step += more
    return step


def bounded(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], budget: float) -> np.ndarray:
    """Probabilities of cells, raked until each margin's kept masses are its targets' shares of the budget, or all there is."""
    factor, total, wants = np.ones(len(mass)), mass.sum(), []
    for code, target in zip(codes, targets):
        own = np.bincount(code, mass, len(target))
        wants.append(own * probabilities(own, np.divide(target, own, out=np.zeros_like(own), where=own > 0) * total, budget))
    for _ in range(ROUNDS):
        worst = 0.0
        for code, want in zip(codes, wants):
            worst = max(worst, float(np.abs(np.bincount(code, mass * np.minimum(1, factor), len(want)) - want).max(initial=0.0)) / total)
            factor = np.clip(factor * _steps(mass, factor, code, want)[code], 0, 1e200)
        if worst < CLOSE:
            break
    return probabilities(mass, np.minimum(1, factor), budget)


def _targets(name: str, values: list, mass: np.ndarray, given: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """(code of each cell, target share by code)"""
    categories = sorted(set(values), key=lambda v: (v is not None, str(v)))
    number = {v: i for i, v in enumerate(categories)}
    code = np.array([number[v] for v in values], np.int64)
    own = np.bincount(code, mass, len(categories))
    own = own / max(own.sum(), 1e-300)
    if not given:
        share = own ** TEMPER[name]
    else:
        named = np.array([v in given and own[i] > 0 for i, v in enumerate(categories)], bool)
        asked = np.array([float(given.get(v, 0.0)) for v in categories]) * named
        left = 1 - own[~named].sum()
        share = np.where(named, asked / max(asked.sum(), 1e-300) * left, own)
    share = np.where(own > 0, share, 0.0)
    return code, share / max(share.sum(), 1e-300)


def _key(value: Column | str) -> Column:
    """A category as text, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(value).cast("string")), F.lit(""))


def _scale(rows: DataFrame, mass: str, factor: str, want: float) -> float:
    """The scale that makes the sum of mass * min(1, scale * factor) as large as wanted; 32 tried at once, closer each time."""
    low, high = 2.0**-60, 2.0**60
    for _ in range(8):
        tried = np.geomspace(low, high, 34)
        sums = rows.agg(*(F.sum(F.col(mass) * F.least(F.lit(1.0), F.col(factor) * float(t))) for t in tried)).first()
        at = min(max(int(np.searchsorted(np.array(sums, float), want)), 1), 33)
        low, high = tried[at - 1], tried[at]
    return float(np.sqrt(low * high))


def _raked_frame(cells: DataFrame, wants: dict[str, DataFrame], total: float, bound: bool, root: str) -> tuple[DataFrame, float]:
    """Cells with a factor each, as ``rake`` or ``bounded`` do, in tables; and the largest gap of a share that is left."""
    current, gap = cells.withColumn("factor", F.lit(1.0)), 1.0
    used = F.least(F.lit(1.0), F.col("factor")) if bound else F.col("factor")
    for k in range(FRAME_ROUNDS):
        for name, want in wants.items():
            now = current.groupBy(name).agg(F.sum(F.col("n") * used).alias("now"))
            step = want.join(now, name).select(name, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(1.0).alias("step"))
            current = current.join(step, name, "left").select(*MARGINS, "n", (F.col("factor") * F.coalesce("step", F.lit(1.0))).alias("factor"))
        current = stored(current, f"{root}/{k}")
        gap = max(
            want.join(current.groupBy(name).agg(F.sum(F.col("n") * used).alias("now")), name).agg(F.max(F.abs(F.col("want") - F.col("now")))).first()[0] / total for name, want in wants.items()
        )
        if gap < FRAME_CLOSE:
            break
    return current, gap


def raked_frames(cells: DataFrame, given: dict[str, dict], budget: float, root: str) -> tuple[DataFrame, float]:
    """(source, lang, topic as texts, weight, probability) of any number of cells, and the gap of the weights."""
    spark = cells.sparkSession
    cells = stored(cells.select(*(_key(m).alias(m) for m in MARGINS), F.col("n").cast("double").alias("n")), f"{root}/cells")
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    if not total:
        return cells.select(*MARGINS, F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability")), 0.0
    asked, bounds = {}, {}
    for name in MARGINS:
        own = cells.groupBy(name).agg(F.sum("n").alias("own")).where("own > 0")
        if given.get(name):
            named = spark.createDataFrame([("" if v is None else f"={v}", float(x)) for v, x in given[name].items()], f"{name} string, asked double")
            own = stored(own.join(named, name, "left"), f"{root}/{name}")
            rest, sums = own.agg(F.sum(F.when(F.col("asked").isNull(), F.col("own"))), F.sum("asked")).first()
            share = F.when(F.col("asked").isNull(), F.col("own") / total).otherwise(F.col("asked") / (sums or 1.0) * (1 - (rest or 0.0) / total))
        else:
            share = F.pow(F.col("own") / total, F.lit(TEMPER[name]))
        own = stored(own.select(name, "own", share.alias("share")), f"{root}/{name}-shares")
        sums = own.agg(F.sum("share")).first()[0]
        own = own.withColumn("ratio", F.col("share") / sums * total / F.col("own"))
        asked[name] = own.select(name, (F.col("ratio") * F.col("own")).alias("want"))
        scale = _scale(own, "own", "ratio", budget * total)
        bounds[name] = own.select(name, (F.col("own") * F.least(F.lit(1.0), F.col("ratio") * scale)).alias("want"))
    weights, gap = _raked_frame(cells, asked, total, False, f"{root}/weights")
    chances, _ = _raked_frame(cells, bounds, total, True, f"{root}/chances")
    chances = chances.select(*MARGINS, "n", F.least(F.lit(1.0), "factor").alias("factor"))
    scale = _scale(chances, "n", "factor", budget * total)
    p = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("factor") * scale)).otherwise(1.0)
    return weights.select(*MARGINS, F.col("factor").alias("weight")).join(chances.select(*MARGINS, p.alias("probability")), list(MARGINS)), gap


def mixed(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Text, the documents' other columns in ``row``, and topic, n_tokens, weight, probability, sampled, margin_gap beside it."""
    spark = docs.sparkSession
    given, root = targets or {}, shared_root(spark, "mixing")
    rows = docs.select(
        others(docs, text_col).alias("row"), F.col(id_col).cast("string").alias("key"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    idf = spark.sparkContext.broadcast(frequencies(rows.select("text")).astype(np.float32))

    def project(batches):
        for batch, data, offsets in text_chunks(batches):
            vectors, n = vectors_of(data, offsets, idf.value)
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("lang"), pa.array([v.astype("<i2").tobytes() for v in vectors], pa.binary()), pa.array(n, pa.int64())], names=["source", "lang", "vector", "n"])

    vectors = stored(rows.select("source", "lang", "text").mapInArrow(tidy(project), "source string, lang string, vector binary, n long"), f"{root}/vectors")
    centres = centres_of(vectors.select("vector"))

    def count(batches):
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<i2").reshape(-1, DIMS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("lang"), pa.array(topics_of(own, centres)), batch.column("n")], names=["source", "lang", "topic", "n"])

    cells = vectors.mapInArrow(count, "source string, lang string, topic int, n long").groupBy("source", "lang", "topic").agg(F.sum("n").alias("n"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "key"), 11) / F.lit(float(2**53))
    result = lambda out, gap: out.select("text", "row", "topic", "n_tokens", "weight", "probability", (draw < F.col("probability")).alias("sampled"), F.lit(gap).alias("margin_gap"))
    cells = stored(cells, f"{root}/cells")
    if cells.count() > CELLS:
        weighed, gap = raked_frames(cells, given, budget, f"{root}/frames")
        new = T.StructType([*rows.schema.fields, *T._parse_datatype_string("topic int, n_tokens long").fields])

        def topics(batches):
            for batch, data, offsets in text_chunks(batches):
                vectors, n = vectors_of(data, offsets, idf.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(topics_of(vectors.astype(np.int64), centres)), pa.array(n, pa.int64())], names=[*batch.schema.names, "topic", "n_tokens"])

        out = rows.mapInArrow(tidy(topics), new).withColumns({f"cell_{m}": _key(m) for m in MARGINS})
        weighed = weighed.select(*(F.col(m).alias(f"cell_{m}") for m in MARGINS), "weight", "probability")
        return result(out.join(weighed, [f"cell_{m}" for m in MARGINS]), gap)
    found = sorted(cells.collect(), key=lambda r: tuple((v is not None, str(v)) for v in r[:3]))
    mass = np.array([r["n"] for r in found], float)
    margins = [_targets(name, [r[name] for r in found], mass, given.get(name)) for name in ("source", "lang", "topic")]
    codes, shares = [c for c, _ in margins], [t for _, t in margins]
    (factor, gap), p = (rake(mass, codes, shares), bounded(mass, codes, shares, budget)) if mass.sum() else ((np.ones(len(found)), 0.0), np.ones(len(found)))
    table = spark.sparkContext.broadcast({(r["source"], r["lang"], r["topic"]): (float(f), float(x)) for r, f, x in zip(found, factor, p)})
    new = T.StructType([rows.schema["text"], rows.schema["row"], rows.schema["key"], *T._parse_datatype_string("topic int, n_tokens long, weight double, probability double").fields])

    def weigh(batches):
        for batch, data, offsets in text_chunks(batches):
            vectors, n = vectors_of(data, offsets, idf.value)
            topic = topics_of(vectors.astype(np.int64), centres)
            own = [table.value[c] for c in zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), topic.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("text"), batch.column("row"), batch.column("key"), pa.array(topic), pa.array(n, pa.int64()), pa.array([w for w, _ in own], pa.float64()), pa.array([x for _, x in own], pa.float64())], names=["text", "row", "key", "topic", "n_tokens", "weight", "probability"]
            )

    return result(rows.mapInArrow(tidy(weigh), new), gap)
