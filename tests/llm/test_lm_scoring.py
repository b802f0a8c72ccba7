import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from docmill.llm import lm_scoring
from docmill.llm.labelled import crc_remainder


def learner():
    return lambda doc_id: crc_remainder(doc_id, 10) != 0  # a closure, so that workers need no module of the tests


learns = learner()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def base(rows):
    count = Counter(t for i, text in rows for t in tokens(text) if zlib.crc32(str(i).encode()) % 10)
    n, v = sum(count.values()), len(count)
    return sorted((i, len(t := tokens(text)), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for i, text in rows)


def corpus(n=300):
    r = random.Random(4)
    languages = [[f"{''.join(r.choice(c) for _ in range(r.randint(1, 6)))}" for _ in range(300)] for c in ("abcdefg", "mnopqrs", "ßéüö")]
    rows = []
    for i in range(n):
        own = r.choice(languages)
        rows.append((i, " ".join(r.choice([own[r.randint(0, 20)], r.choice(own).title()]) + r.choice(["", "", "."]) for _ in range(r.randint(0, 120)))))
    return rows + [(n, None), (n + 1, ""), (n + 2, "\t\n"), (n + 3, "Never seen WORDS"), (n + 4, "a " * 50000)]


def test_base_scores_and_model(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, payload string, block int").repartition(5)
    got = sorted(lm_scoring.lm_scores(df, learner()).collect(), key=lambda r: r["doc_id"])
    for row, (i, n, known, total, score) in zip(got, base(rows), strict=True):
        assert (row["doc_id"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (i, n, known, total)
        assert math.isclose(row["base_score"], score, rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in got if not learns(r["doc_id"]) and r["n_tokens"] > 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the model knows more than word counts


def small_model(units=40, seed=0):
    r = np.random.default_rng(seed)
    bins, counts = r.integers(0, 5, units), r.integers(5, 500, units)
    words = lm_scoring.Words(np.sort(r.integers(0, 2**63, units).astype(np.uint64)), bins, counts, r.integers(0, 9, lm_scoring.BINS), r.integers(0, 4, lm_scoring.BINS), 30)
    seq = np.concatenate([np.append(r.integers(lm_scoring.WORD, lm_scoring.WORD + units, 9), lm_scoring.END) for _ in range(400)])
    return words, seq


def test_probabilities_are_those_of_the_parameters_and_add_up_to_one():
    words, seq = small_model()
    model = lm_scoring.Model(words)
    model.learn(seq, 1)
    first, second, cv, cb, uv, ub = (p.astype(float) for p in model.parts[:6])
    units = [u for u in range(len(words.classes)) if u != lm_scoring.START]

    def plain(one, two, unit):
        """The definition, one unit at a time."""
        h = first[one] + second[two]
        of_class = np.exp([h @ cv[k] + cb[k] for k in range(lm_scoring.CLASSES)])
        k = words.classes[unit]
        mates = [u for u in units if words.classes[u] == k]
        of_unit = {u: np.exp(h @ uv[words.place[u]] + ub[words.place[u]]) for u in mates}
        return math.log10(of_class[k] / of_class.sum() * of_unit[unit] / sum(of_unit.values()))

    one, two = lm_scoring.contexts(seq)
    got = model.log10(one[:60], two[:60], seq[:60])
    assert np.allclose(got, [plain(*x) for x in zip(one[:60], two[:60], seq[:60])], atol=1e-4)
    every = model.log10(np.full(len(units), seq[3]), np.full(len(units), seq[2]), np.array(units))
    assert math.isclose((10**every).sum(), 1, abs_tol=1e-4)


def test_contexts_end_with_texts():
    e, s = lm_scoring.END, lm_scoring.START
    one, two = lm_scoring.contexts(np.array([200, 201, 202, e, e, 203, e, 204]))
    assert one.tolist() == [s, 200, 201, 202, s, s, 203, s] and two.tolist() == [s, s, 200, 201, s, s, s, s]


def test_training_learns_what_follows_what():
    words, seq = small_model()
    seq = np.concatenate([np.append(np.array([lm_scoring.WORD + (i + k) % 40 for k in range(12)]), lm_scoring.END) for i in range(800)])
    model = lm_scoring.Model(words)
    before = model.log10(*lm_scoring.contexts(seq), seq).mean()
    for k in range(8):
        model.learn(seq, k)
    assert model.log10(*lm_scoring.contexts(seq), seq).mean() > before + 0.5


def test_more_learners_see_all_and_units_are_bounded(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    one = {r["doc_id"]: r for r in lm_scoring.lm_scores(df, learner()).collect()}
    monkeypatch.setattr(lm_scoring, "LEARNER_TOKENS", 10_000)
    many = {r["doc_id"]: r for r in lm_scoring.lm_scores(df, learner()).collect()}
    assert {i: r["base_score"] for i, r in one.items()} == {i: r["base_score"] for i, r in many.items()}
    held = [i for i, r in one.items() if not learns(i) and r["n_tokens"] > 1]
    assert sum(many[i]["score"] for i in held) > sum(many[i]["base_score"] for i in held)


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    rows = lm_scoring.lm_scores(df, lambda i: False).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows} == {(1, 3, 0, 0, 0.0), (None, 1, 0, 0, 0.0), (2, 1, 0, 0, 0.0)}
    assert lm_scoring.lm_scores(df.where("false"), learner()).collect() == []
