"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 3).

Features of a text are its distinct words, word pairs and pairs with one word between, hashed to 2^20 coordinates.  FTRL keeps a
learning rate for each coordinate, and its L1 term leaves most weights at exactly zero, so the model is a short list that every
task gets.  It learns from at most ``BOUND`` labelled documents of either class (a documented bound); all documents are scored.
Where the bound cuts the classes at different rates, the log odds are put back to those of all labels (a logistic model of rows
sampled by class differs from that of all rows by the log ratio of the sampling rates, in its bias alone).

Defined cases: null is an empty text; a text of any length is scored whole; a text without features scores by the bias alone; without any labelled document all
scores are 0.5; rows with equal ids are scored each by itself; columns beside id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.labelled import sample, trained
from docmill.llm.textkernel import NOT_ALPHANUMERIC, mix, row_of, span_hashes, text_chunks, word_spans

BITS = 20
BOUND = 8000
EPOCHS = 5
ALPHA, BETA = 2.0, 1.0
L1 = 10.0

_PAIR, _SKIP = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of each word, pair and skip-gram, in no certain order and with repeats."""
    starts, ends, word_offsets = word_spans(data, offsets, NOT_ALPHANUMERIC)
    hashes, rows = span_hashes(data, starts, ends), row_of(word_offsets)
    found = [(rows, hashes)]
    for gap, (a, b) in ((1, _PAIR), (2, _SKIP)):
        same = np.flatnonzero(rows[gap:] == rows[:-gap])
        found.append((rows[same], mix(hashes[same] * a + hashes[same + gap] * b)))
    return np.concatenate([r for r, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal with a rate for each coordinate; the bias has no L1 term."""

    def __init__(self, size: int = 1 << BITS, l1: float = L1):
        self.z, self.n, self.bias, self.l1 = np.zeros(size), np.zeros(size), np.zeros(2), l1

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA))

    def bias_weight(self) -> float:
        return float(-self.bias[0] / ((BETA + np.sqrt(self.bias[1])) / ALPHA))

    def learn(self, at: np.ndarray, y: int) -> None:
        w, b = self.weights(at), self.bias_weight()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias += [g - (np.sqrt(self.bias[1] + g * g) - np.sqrt(self.bias[1])) / ALPHA * b, g * g]


def _train(batches):
    rows, weight = [], {}
    for batch, data, offsets in text_chunks(batches):
        row, at = features(data, offsets)
        order = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
        for i, y in enumerate(batch.column("y").to_pylist()):
            rows.append((np.unique(at[order[bounds[i] : bounds[i + 1]]]), y))
        weight.update(zip(batch.column("y").to_pylist(), batch.column("weight").to_pylist()))
    if rows:
        model = Ftrl()
        # rows come by the hash that a class is cut by, so the less cut class would stand alone at the end
        order = np.random.default_rng(3).permutation(len(rows))
        for _ in range(EPOCHS):
            for i in order:
                model.learn(*rows[i])
        weights = model.weights()
        at = np.flatnonzero(weights)
        shift = np.log(weight[1] / weight[0]) if len(weight) == 2 else 0.0
        raw = np.array([model.bias_weight() + shift]).tobytes() + at.astype("<i4").tobytes() + weights[at].astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["model"])


def _unpack(raw: bytes | None) -> tuple[float, np.ndarray]:
    weights = np.zeros(1 << BITS, np.float32)
    if raw is None:
        return 0.0, weights
    n = (len(raw) - 8) // 8
    weights[np.frombuffer(raw, "<i4", n, 8)] = np.frombuffer(raw, "<f4", n, 8 + 4 * n)
    return float(np.frombuffer(raw, "<f8", 1)[0]), weights


def scores(data: np.ndarray, offsets: np.ndarray, bias: float, weights: np.ndarray) -> np.ndarray:
    row, at = features(data, offsets)
    hit = np.flatnonzero(weights[at])
    pairs = np.unique(row[hit].astype(np.int64) << BITS | at[hit])
    total = bias + np.bincount(pairs >> BITS, weights[pairs & (1 << BITS) - 1], len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", bound: int = BOUND) -> DataFrame:
    """For each row: doc_id, score (probability of label 1) and predicted (1 from 0.5 on)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trained(sample(docs, labels, label, bound, learn, id_col, text_col), _train))

    def run(batches):
        bias, weights = _unpack(model.value)
        for batch, data, offsets in text_chunks(batches):
            p = scores(data, offsets, bias, weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
