import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from docmill.llm import mixing
from docmill.llm.mixing import mixed, probabilities, rake


def test_raked_margins_meet_the_targets():
    r = np.random.default_rng(1)
    codes = [np.repeat(np.arange(4), 12), np.tile(np.repeat(np.arange(3), 4), 4), np.tile(np.arange(4), 12)]
    mass = r.integers(1, 1000, 48).astype(float)
    targets = [x / x.sum() for x in (r.random(4) + 0.2, r.random(3) + 0.2, r.random(4) + 0.2)]
    factor, gap = rake(mass, codes, targets)
    assert gap < 1e-8
    for code, target in zip(codes, targets):
        assert np.allclose(np.bincount(code, mass * factor) / mass.sum(), target, atol=1e-7)
    # raking keeps the odds ratios of the table
    t, u = (mass * factor).reshape(4, 3, 4), mass.reshape(4, 3, 4)
    odds = lambda x: x[0, 0, 0] * x[1, 1, 0] / (x[0, 1, 0] * x[1, 0, 0])
    assert np.isclose(odds(t), odds(u))


def test_probabilities_meet_the_budget():
    mass, factor = np.array([100.0, 10, 1, 0]), np.array([0.1, 1, 50, 3])
    for budget in (0.05, 0.5, 0.99, 1.0):
        p = probabilities(mass, factor, budget)
        assert p.max() <= 1 and abs((mass * p).sum() - budget * mass.sum()) < 1e-6 * mass.sum() and p[3] == 1


def corpus(n=3000):
    r = random.Random(8)
    return [(i, " ".join(f"w{r.randint(0, 999)}" for _ in range(r.randint(1, 30))), r.choice(["a", "a", "a", "b", None]), r.choice(["en", "en", "de"]), i, "x") for i in range(n)]


SCHEMA = "doc_id long, text string, source string, lang string, weight long, row string"


def plain_hash(word):
    """The words' hash, by its definition, in plain numbers (words of up to 64 bytes)."""
    m, size = 2**64, 0x9E3779B97F4A7C15

    def mix(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % m
        return x ^ x >> 32

    raw = re.sub("[A-Z]", lambda c: c[0].lower(), word).encode()
    out = mix(int.from_bytes(raw[:8], "little") ^ (len(raw) + 1) * size % m)
    for k in range(8, len(raw), 8):
        out = mix(out * size % m ^ int.from_bytes(raw[k : k + 8], "little"))
    return out


def plain_topics(rows):
    """Topics by k-means, one document at a time."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    counts = [Counter(plain_hash(w) for w in own) for own in words]
    seen = Counter(s for own in counts for s in {h >> 46 for h in own})
    n = sum(map(bool, words))
    idf = {s: float(np.float32(math.log((n + 1) / (c + 1)))) for s, c in seen.items()}
    vectors = []
    for own in counts:
        v = [0.0] * 128
        for h, c in own.items():
            v[(h >> 8) % 128] += (1 if h >> 20 & 1 else -1) * (1 + math.log(c)) * idf[h >> 46]
        length = math.sqrt(sum(x * x for x in v))
        vectors.append([round(x / max(length, 1e-9) * 1000) for x in v])
    nearest = lambda v: max(range(8), key=lambda k: (sum(a * b for a, b in zip(v, centres[k])), -k))
    full = np.array([v for v in vectors if any(v)])
    mean = full.mean(0)
    _, directions = np.linalg.eigh(np.cov(full.T, bias=True))
    directions = [max(d, -d, key=lambda x: x[np.abs(x).argmax()]) for d in directions.T[::-1][:3]]
    centres = None
    for _ in range(5):
        topic = [sum(int((np.array(v) - mean) @ d > 0) << k for k, d in enumerate(directions)) if centres is None else nearest(v) for v in vectors]
        sums = [[sum(v[d] for v, t in zip(vectors, topic) if t == k and any(v)) for d in range(128)] for k in range(8)]
        size = [math.sqrt(sum(x * x for x in s)) for s in sums]
        centres = [[x / z for x in s] if z else (centres[k] if centres else s) for k, (s, z) in enumerate(zip(sums, size))]
    return [nearest(v) for v in vectors]


def test_topics_probabilities_and_draws_against_plain_ones(spark):
    r = random.Random(5)
    fields = [[f"{c}{i}" for i in range(60)] for c in ("law", "sea", "cook")]
    rows = [(i, " ".join(r.choice(fields[i % 3]) if r.random() < 0.7 else r.choice(["the", "of", "AND"]) for _ in range(r.randint(8, 40))), r.choice("ab"), "en", 1, "x") for i in range(240)]
    rows += [(900, None, "a", "en", 1, "x"), (901, " ", "a", "en", 1, "x")]
    out = {x["row"]["doc_id"]: x for x in mixed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    topics = plain_topics(rows)
    assert [out[row[0]]["topic"] for row in rows] == topics
    # documents of one field mostly share their topics, which other fields' documents do not have
    home = [Counter(t for t, row in zip(topics, rows) if row[0] < 240 and row[0] % 3 == k) for k in range(3)]
    best = [max(range(3), key=lambda k: home[k][t]) for t in range(8)]
    assert np.mean([best[t] == row[0] % 3 for t, row in zip(topics, rows) if row[0] < 240]) > 0.8
    # the weighted margins are the tempered shares; draws depend on ids alone
    tokens = sum(x["n_tokens"] for x in out.values())
    for key in (lambda x: x["row"]["source"], lambda x: x["topic"]):
        own, got = Counter(), Counter()
        for x in out.values():
            own[key(x)] += x["n_tokens"]
            got[key(x)] += x["n_tokens"] * x["weight"]
        want = {k: (v / tokens) ** 0.7 for k, v in own.items()}
        assert all(abs(got[k] / tokens - want[k] / sum(want.values())) < 1e-6 for k in own)
    assert all(x["margin_gap"] < 1e-6 for x in out.values())
    for i, x in out.items():
        signed = xxhash.xxh64(str(i).encode(), seed=xxhash.xxh64(b"mix", seed=42).intdigest()).intdigest()
        assert x["sampled"] == ((signed >> 11) / 2**53 < x["probability"])


def test_targets_for_some_categories_and_targets_that_cannot_be_met(spark):
    rows = [(i, "one two three four", "abc"[i % 3], "en", 1, "x") for i in range(90)]
    share = lambda out, v: sum(x["n_tokens"] * x["weight"] for x in out if x["row"]["source"] == v) / sum(x["n_tokens"] for x in out)
    out = mixed(spark.createDataFrame(rows, SCHEMA), {"source": {"a": 3, "b": 1, "elsewhere": 9}}, budget=0.3).collect()
    assert [round(share(out, v), 6) for v in "abc"] == [0.5, round(1 / 6, 6), round(1 / 3, 6)] and out[0]["margin_gap"] < 1e-6
    # source and language are one and the same, so different targets contradict each other
    rows = [(i, "one two three four", "ab"[i % 2], "ab"[i % 2], 1, "x") for i in range(90)]
    out = mixed(spark.createDataFrame(rows, SCHEMA), {"source": {"a": 3, "b": 1}, "lang": {"a": 1, "b": 3}}, budget=0.3).collect()
    assert len(out) == 90 and out[0]["margin_gap"] > 0.1


def test_sample_follows_targets_and_repeats(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    targets = {"source": {"a": 1, "b": 1, None: 1}, "lang": {"en": 1, "de": 1}}
    out = mixed(df, targets, budget=0.4).collect()
    assert sorted(r["row"]["doc_id"] for r in out) == list(range(len(rows))) and {(r["row"]["doc_id"], r["text"], *r["row"][2:]) for r in out} == set(rows)
    assert all(r["n_tokens"] == len(r["text"].split()) and 0 <= r["topic"] < 8 for r in out)
    total = sum(r["n_tokens"] for r in out)
    kept = [r for r in out if r["sampled"]]
    assert abs(sum(r["n_tokens"] * r["probability"] for r in out) / total - 0.4) < 1e-6
    assert abs(sum(r["n_tokens"] for r in kept) / total - 0.4) < 0.04
    share = lambda col, v: sum(r["n_tokens"] for r in kept if r["row"][col] == v) / sum(r["n_tokens"] for r in kept)
    assert abs(share("source", "b") - 1 / 3) < 0.04 and abs(share("lang", "de") - 1 / 2) < 0.04
    again = mixed(df.repartition(2), targets, budget=0.4).where("sampled").select("row.doc_id").collect()
    assert sorted(r[0] for r in again) == sorted(r["row"]["doc_id"] for r in kept)


def test_nulls_empty_texts_long_texts_and_no_rows(spark):
    rows = [(None, None, None, None, None, None), (1, "", "a", "en", 1, ""), (2, "w " * 100000, "a", "en", 1, ""), (2, "w " * 100000, "a", "en", 1, "")]
    out = mixed(spark.createDataFrame(rows, SCHEMA), budget=1.0).collect()
    assert sorted(r["n_tokens"] for r in out) == [0, 0, 100000, 100000] and all(r["sampled"] for r in out)
    assert mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert all(r["sampled"] for r in mixed(spark.createDataFrame(rows[:2], SCHEMA)).collect())


def test_shares_meet_the_targets_where_probabilities_reach_one(spark):
    # a source of a third and twenty small ones; languages as 4 : 1; all at the production budget
    rows = [(i, "one two three four", "hot" if i % 3 == 0 else f"s{i % 20}", "en" if i // 60 % 5 else "de", i, "x") for i in range(3000)]
    out = mixed(spark.createDataFrame(rows, SCHEMA), budget=0.8).collect()
    kept = lambda f: sum(r["n_tokens"] * r["probability"] for r in out if f(r["row"])) / sum(r["n_tokens"] * r["probability"] for r in out)
    own = [1 / 3, *[1 / 30] * 20]
    assert abs(kept(lambda r: r["source"] == "hot") - own[0] ** 0.7 / sum(x**0.7 for x in own)) < 0.01
    assert abs(sum(r["probability"] for r in out) - 2400) < 1e-3 and max(r["probability"] for r in out) <= 1


@pytest.mark.parametrize("targets", [None, {"source": {"s1": 2, "s2": 1, None: 3}, "lang": {"de": 1}}])
def test_more_cells_than_the_driver_takes(spark, monkeypatch, targets):
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(0, 30))), r.choice([None, "s1", "s1", "s2", "s3"]), r.choice(["en", "en", "de"]), 1, "x") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    one = {x["row"]["doc_id"]: x for x in mixed(df, targets, budget=0.7).collect()}
    monkeypatch.setattr(mixing, "CELLS", 5)
    two = {x["row"]["doc_id"]: x for x in mixed(df, targets, budget=0.7).collect()}
    assert one.keys() == two.keys() and all(one[i]["topic"] == two[i]["topic"] and one[i]["text"] == two[i]["text"] for i in one)
    tokens = sum(x["n_tokens"] for x in one.values())
    assert abs(sum(x["n_tokens"] * x["probability"] for x in two.values()) / tokens - 0.7) < 1e-3
    assert max(abs(one[i]["probability"] - two[i]["probability"]) for i in one) < 0.02
    assert max(abs(one[i]["weight"] - two[i]["weight"]) / one[i]["weight"] for i in one) < 0.02
