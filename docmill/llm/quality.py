"""Quality by compression with labelled dictionaries (operator 4).

Two zstandard dictionaries are trained, on good and on bad labelled text.  A text is cut into pieces of ``PIECE`` bytes, and each
is compressed by itself with either dictionary, so that the dictionaries matter as much in a long text as in a short one.  The
normalised difference of the summed sizes, (bad - good) / (bad + good), and the sizes relative to the text's own give a
probability by logistic calibration.  The dictionaries learn from one half of at most ``BOUND`` labelled documents of either
class (a documented bound), all of whose pieces are used, the calibration from the other half.  All documents are scored by their
whole texts.

Defined cases: null is an empty text; a text of any length is scored whole, piece by piece; an empty text scores by the class rates alone; without labelled documents of both
classes all scores are 0.5; rows with equal ids are scored each by itself; columns beside id and text are not looked at.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.labelled import others, sample, trained
from docmill.llm.storage import tidy
from docmill.llm.textkernel import text_chunks

PIECE = 512
LEVEL = 1
DICTIONARY_BYTES = 128 << 10
BOUND = 4000


class Sizes:
    """Compressed sizes of texts with either dictionary."""

    def __init__(self, dictionaries: list[bytes]):
        self.compressors = []
        for raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None
            if d is not None:
                d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=0 if d is not None else LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, data: bytes) -> np.ndarray:
        """1, the normalised difference, both relative sizes, and the products of these three."""
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        bad, good = (float(sum(len(c.compress(p)) for p in pieces)) for c in self.compressors)
        if not pieces:
            return np.array([1.0] + [0.0] * 9)
        x = [10 * (bad - good) / (bad + good), good / len(data), bad / len(data)]
        return np.array([1.0, *x, *(x[i] * x[j] for i in range(3) for j in range(i, 3))])


def _dictionary(texts: list[bytes]) -> bytes:
    """Of all pieces: trained, with a quarter of their bytes up to ``DICTIONARY_BYTES``, or, of so little text that there is
    nothing to choose from, the distinct pieces themselves (as zstandard takes bytes that are no trained dictionary)."""
    pieces = [text[i : i + PIECE] for text in texts for i in range(0, len(text), PIECE)]
    size = min(DICTIONARY_BYTES, sum(map(len, pieces)) // 4)
    if size >= 1024:
        try:
            return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too few different pieces
            pass
    return b"".join(dict.fromkeys(pieces))[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method with a small ridge on all but the constant."""
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        slope = x.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, slope)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _train(batches):
    halves: list[list] = [[], []]
    n = [0, 0]
    for batch in batches:
        for y, weight, text in zip(*(batch.column(c).to_pylist() for c in ("y", "weight", "text"))):
            halves[n[y] % 2].append((y, weight, (text or "").encode()))
            n[y] += 1
    if min(n) >= 2:
        dictionaries = [_dictionary([t for y, _, t in halves[0] if y == q]) for q in (0, 1)]
        sizes = Sizes(dictionaries)
        rows = [r for r in halves[1] if r[2]]
        if not {y for y, _, _ in rows} >= {0, 1}:
            return
        x = np.array([sizes.features(t) for _, _, t in rows])
        y, weight = (np.array([r[i] for r in rows], float) for i in (0, 1))
        mean, scale = x.mean(0), x.std(0) + 1e-9
        mean[0], scale[0] = 0, 1
        rate = (y * weight).sum() / weight.sum()
        model = (dictionaries, mean, scale, _logistic((x - mean) / scale, y, weight), float(rate))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", bound: int = BOUND, with_row: bool = False) -> DataFrame:
    """For each row: doc_id, score (probability of label 1), predicted (1 from 0.5 on) and, if asked for, text and the other columns in ``row``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trained(sample(docs, labels, label, bound, learn, id_col, text_col), _train))

    def run(batches):
        if model.value is not None:
            dictionaries, mean, scale, beta, rate = pickle.loads(model.value)
            sizes = Sizes(dictionaries)
        for batch, data, offsets in text_chunks(batches):
            p = np.full(batch.num_rows, 0.5)
            if model.value is not None:
                raw = data.tobytes()
                x = np.array([sizes.features(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])
                p = 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ beta, -35, 35)))
                p[np.diff(offsets) == 0] = rate
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), *([batch.column("text"), batch.column("row")] if with_row else [])], names=["doc_id", "score", "predicted", "text", "row"][: 3 + 2 * with_row])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([others(docs, text_col).alias("row")] if with_row else []))
    schema = T._parse_datatype_string("doc_id long, score double, predicted int")
    return rows.mapInArrow(tidy(run), T.StructType([*schema.fields, *([rows.schema["text"], rows.schema["row"]] if with_row else [])]))
