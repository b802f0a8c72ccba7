import math
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.llm import quality, toxicity
from docmill.llm.labelled import remainder, sample, trained
from docmill.llm.textkernel import text_chunks


def corpus(n=600):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        toxic, good = int(r.random() < 0.2), int(r.random() < 0.7)
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        for _ in range(2 * toxic):
            text.insert(r.randrange(len(text)), r.choice(["Zorg,", "zorg", "QUUX!"]))
        text = " ".join(text) if good else " | ".join(w.upper() + "!!" for w in text)
        docs.append((i, text, "x", 0.5))
        labels.append((i, good, toxic))
    docs += [(n, None, None, None), (n + 1, "", None, None), (n + 1, "", None, None), (n + 2, "zorg " * 30000, None, None), (None, "zorg", None, None)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out_accuracy(rows, labels, folds, out):
    rows = {r["doc_id"]: r["predicted"] for r in rows}
    own = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % folds == out]
    return np.mean([rows[i] == y for i, y in own])


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    rows = toxicity.toxicity(docs, labels, remainder("doc_id", 5) != 0).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert held_out_accuracy(rows, [(r["doc_id"], r["toxic"]) for r in labels.collect()], 5, 0) > 0.95
    assert [r["predicted"] for r in rows if r["doc_id"] == 602] == [1]


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    rows = quality.quality(docs, labels, remainder("doc_id", 3) != 1).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert held_out_accuracy(rows, [(r["doc_id"], r["quality"]) for r in labels.collect()], 3, 1) > 0.95


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_no_labels_and_no_documents(tables, score):
    docs, labels = tables
    assert {r["score"] for r in score(docs, labels.where("false"), F.lit(True)).collect()} == {0.5}
    assert score(docs.where("false"), labels, F.lit(True)).collect() == []


def test_toxicity_keeps_the_rate_of_labels_where_the_bound_cuts_one_class(spark):
    # one document in ten is toxic, by chance alone, so the score should be near 0.1 whatever the bound
    r = random.Random(6)
    rows = [(i, "some words", int(r.random() < 0.1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    for bound in (200, 8000):
        out = toxicity.toxicity(df.drop("toxic"), df.select("doc_id", "toxic"), F.lit(True), bound=bound).collect()
        assert abs(np.mean([x["score"] for x in out]) - 0.1) < 0.06 and np.mean([x["predicted"] for x in out]) < 0.05


def test_held_out_labels_do_not_matter(tables):
    docs, labels = tables
    other = labels.withColumn("toxic", F.when(remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, t, remainder("doc_id", 5) != 0).collect()), key=str) for t in (labels, other))
    assert a == b


def test_features_are_words_pairs_and_skips_within_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["A b, c", "b", "", "c a b c"]})
    ((_, data, offsets),) = text_chunks([batch])
    rows, at = toxicity.features(data, offsets)
    assert np.bincount(rows, minlength=4).tolist() == [3 + 2 + 1, 1, 0, 4 + 3 + 2]
    own = [set(at[rows == i].tolist()) for i in range(4)]
    assert own[1] < own[0] and len(own[0] & own[3]) == 3 + 2 + 1 and len(own[3]) == 3 + 3 + 2


def test_ftrl_leaves_noise_at_zero():
    r, model = np.random.default_rng(0), toxicity.Ftrl(1000, l1=5.0)
    for _ in range(2000):
        y = int(r.random() < 0.5)
        model.learn(np.unique(np.concatenate([r.integers(1, 1000, 20), [0] if y else []]).astype(int)), y)
    w = model.weights()
    assert w[0] > 1 and (w != 0).mean() < 0.2


def test_compressed_sizes_of_empty_and_long_texts():
    sizes = quality.Sizes([b"", b""])
    assert sizes.features(b"").tolist() == [1.0] + [0.0] * 9
    assert sizes.features(b"ab" * 10**5)[1] == 0


def test_toxicity_scores_are_those_of_the_weights():
    """The features and the sum, one text at a time, in plain numbers."""
    from test_mixing import plain_hash

    def mix(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
        return x ^ x >> 32

    def coordinates(text):
        h = [plain_hash(w) for w in re.findall("[a-zA-Z0-9\x80-\U0010ffff]+", text)]
        pairs = [mix((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64) for a, b in zip(h, h[1:])]
        skips = [mix((a * 0xD6E8FEB86659FD93 + b * 0xA0761D6478BD642F) % 2**64) for a, b in zip(h, h[2:])]
        return {x >> 44 for x in h + pairs + skips}

    r = random.Random(8)
    texts = [" ".join(r.choice(["Über", "one", "TWO", "don't", "a|b", "x9", "漢字", "zwölf."]) for _ in range(r.randint(0, 30))) for _ in range(50)] + ["", "  "]
    weights = np.random.default_rng(1).normal(0, 1, 1 << toxicity.BITS).astype(np.float32)
    weights[np.random.default_rng(2).random(len(weights)) < 0.5] = 0
    ((_, data, offsets),) = text_chunks([pa.RecordBatch.from_pydict({"text": texts})])
    want = [1 / (1 + np.exp(-(0.3 + sum(float(weights[c]) for c in coordinates(t))))) for t in texts]
    assert np.allclose(toxicity.scores(data, offsets, 0.3, weights), want, atol=1e-9)


def test_ftrl_steps_are_those_of_the_update_rule():
    model, r = toxicity.Ftrl(6, l1=0.5), random.Random(3)
    z, n, bias = [0.0] * 6, [0.0] * 6, [0.0, 0.0]

    def weight(zi, ni, l1):
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((1 + math.sqrt(ni)) / 2)

    for _ in range(60):
        at, y = sorted(r.sample(range(6), 3)), r.randint(0, 1)
        model.learn(np.array(at), y)
        p = 1 / (1 + math.exp(-(sum(weight(z[i], n[i], 0.5) for i in at) + weight(*bias, 0.0))))
        g = p - y
        for i in at:
            z[i], n[i] = z[i] + g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 2 * weight(z[i], n[i], 0.5), n[i] + g * g
        bias = [bias[0] + g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / 2 * weight(*bias, 0.0), bias[1] + g * g]
    assert np.allclose(model.weights(), [weight(a, b, 0.5) for a, b in zip(z, n)]) and math.isclose(model.bias_weight(), weight(*bias, 0.0))


def test_quality_scores_are_those_of_the_dictionaries(tables, spark):
    """Compressed sizes piece by piece, and the logistic sum, from a model that the operator has trained."""
    import zstandard

    docs, labels = tables
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    learn = remainder("doc_id", 3) != 1
    dictionaries, mean, scale, beta, rate = pickle.loads(trained(sample(docs, labels, "quality", quality.BOUND, learn), quality._train))

    def score(text):
        data = (text or "").encode()
        if not data:
            return rate
        sizes = []
        for raw in dictionaries:
            own = zstandard.ZstdCompressionDict(raw)
            own.precompute_compress(level=1)
            sizes.append(sum(len(zstandard.ZstdCompressor(dict_data=own, level=0, write_content_size=False, write_dict_id=False, write_checksum=False).compress(data[i : i + 512])) for i in range(0, len(data), 512)))
        bad, good = sizes
        x = [10 * (bad - good) / (bad + good), good / len(data), bad / len(data)]
        x = [1, *x, x[0] * x[0], x[0] * x[1], x[0] * x[2], x[1] * x[1], x[1] * x[2], x[2] * x[2]]
        t = sum(b * (v - m) / s for b, v, m, s in zip(beta, x, mean, scale))
        return 1 / (1 + math.exp(-max(-35, min(35, t))))

    got = sorted(((r["doc_id"], r["score"]) for r in quality.quality(docs, labels, learn).collect()), key=str)
    want = sorted(((i, score(t)) for i, t in rows), key=str)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)


def test_dictionaries_learn_from_whole_texts():
    """What stands only at the end of long texts is in the dictionary."""
    r = random.Random(1)
    texts = [("".join(r.choice("abcdefgh ") for _ in range(20000)) + "the tail that only ends have, again and again; " * 40).encode() for _ in range(40)]
    assert b"ends have" in quality._dictionary(texts)
    assert quality._dictionary([b"little text"]) == b"little text" and quality._dictionary([]) == b""
