import random
import re

import pytest

from docmill.llm.components import connected
from docmill.llm.minhash_dedup import MinMax, band_plan, near_duplicates
from docmill.llm.storage import shared_root


def brute(rows, percent=85):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[k + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed=3):
    r = random.Random(seed)
    prose = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    rows, n = [], 0
    for _ in range(25):
        base = prose(r.randint(1, 250))
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = "x%d" % r.randint(0, 10**6)
            text = " ".join(copy)
            rows.append((n, r.choice([str, str.upper])(text)))
            n += 1
    r.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)] + [(900, None), (901, ""), (902, " \n\t"), (903, "a b"), (904, "A\x0bB"), (905, "É"), (906, "é"), (907, "é")]


@pytest.mark.parametrize("percent,part", [(85, 1024), (80, 1024), (85, 2)])
def test_against_brute_force(spark, percent, part):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, cluster int, parts string").repartition(4)
    got = sorted(tuple(r)[:4] for r in near_duplicates(df, percent, part=part).collect())
    assert got == brute(rows, percent)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (7, text), (None, "other words here for this one text"), (None, "other words here for this one text"), (None, None)], "doc_id long, text string")
    got = sorted([tuple(r)[:4] for r in near_duplicates(df).collect()], key=str)
    assert got == sorted([(5, 26, 5, True), (5, 26, 5, True), (7, 26, 5, False), (None, 3, None, True), (None, 3, None, True), (None, 0, None, True)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 300)] + [(100, 41)]
    random.Random(1).shuffle(edges)
    got = {r["u"]: r["v"] for r in connected(spark.createDataFrame(edges, "u long, v long").repartition(6), shared_root(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 41 for i in range(300)}}


def test_signature_estimates_similarity_and_plan_misses_little():
    import numpy as np

    r = np.random.default_rng(1)
    common, rest = r.integers(0, 2**63, 850, dtype=np.uint64), r.integers(0, 2**63, 150, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, rest[:75]])), np.sort(np.concatenate([common, rest[75:]]))]
    a, b = MinMax(7, 100).signatures(sets)
    assert abs((a == b).mean() - 0.85) < 0.05
    for percent in (80, 85):
        rows, bands = band_plan(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_very_long_texts_and_a_large_cluster_in_many_parts(spark):
    r = random.Random(4)
    long = [f"w{r.randint(0, 10**6)}" for _ in range(60000)]
    near = list(long)
    for k in range(0, 60000, 1000):
        near[k] = "other"
    base = [f"b{i}" for i in range(120)]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:40000]))]
    for i in range(150):
        copy = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 4])):
            copy[r.randrange(120)] = f"x{r.randint(0, 10**6)}"
        rows.append((10 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(x)[:4] for x in near_duplicates(df, part=16).collect()) == brute(rows)


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("left", [None, 17])
def test_links_are_all_pairs_at_the_threshold(percent, left):
    import numpy as np

    from docmill.llm.minhash_dedup import links_of

    r = np.random.default_rng(percent)
    pool = np.sort(r.choice(10**6, 400, replace=False)).astype(np.uint64)
    base = [r.choice(pool, size, replace=False) for size in (1, 3, 7, 40, 60)]
    sets = []
    for _ in range(40):
        own = set(base[r.integers(5)].tolist())
        for _ in range(r.integers(0, 8)):
            own.discard(r.choice(pool)) if r.random() < 0.7 else own.add(int(r.choice(pool)))
        own = np.sort(np.array(sorted(own) or [1], np.uint64))
        sets.append((own, own * np.uint64(3)))
    plain = [set(s.tolist()) for s, _ in sets]
    pairs = ((x, y) for x in range(40) for y in range(x + 1, 40) if left is None or x < left <= y)
    want = {(x, y) for x, y in pairs if 100 * len(plain[x] & plain[y]) >= percent * len(plain[x] | plain[y])}
    assert set(zip(*(v.tolist() for v in links_of(sets, percent, left)))) == want and want
