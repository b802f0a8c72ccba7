import math
import random
import re
import struct
from collections import Counter

import xxhash

from docmill.llm import quality_rules as q


def slots(words):
    def word(w):
        return xxhash.xxh64(w.encode(), seed=42).intdigest()

    def pair(*hashes):
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64(struct.pack("<Q", h), seed=seed).intdigest()
        return seed

    h = [word(w) for w in words]
    return [x % q.BUCKETS for x in h] + [pair(a, b) % q.BUCKETS + q.BUCKETS for a, b in zip(h, h[1:])]


def brute(rows, trusted):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(slots(split(t)))
        if i in trusted:
            good.update(slots(split(t)))
    b = 2 * q.BUCKETS
    out = []
    for i, t in rows:
        t, w = t or "", split(t)
        lines = [x for x in t.split("\n") if split(x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {g for g, n in Counter(grams).items() if n > 1}
        covered = {k + j for k, g in enumerate(grams) if g in twice for j in range(5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        s = slots(w)
        llr = sum(math.log((good[x] + 1) / (good.total() + b)) - math.log((raw[x] + 1) / (raw.total() + b)) for x in s) / max(len(s), 1) if good else 0.0
        out.append((i, len(w), sum(map(len, w)), sum(c in q.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and llr >= q.THRESHOLD, round(llr, 9)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(6)
    words = ["alpha", "béta", "Gamma", "δ", "x#y", "$$", "|", "<b>", "😀", "zeta", "eta.", "theta,"]
    rows = []
    for i in range(150):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", "\t", "\x0b", "\n\n"]) for _ in range(r.randint(0, 80)))
        if i % 5 == 0:
            text += "\n".join(["the same line again, as before"] * r.randint(1, 4))
        if i % 9 == 0:
            text = " | ".join(f"Q{r.randint(0, 99)}!!" for _ in range(60))
        rows.append((i, text))
    return rows + [(500, None), (501, ""), (502, " \n\t\n "), (503, "a b c d e " * 4000), (504, "one two three four five six seven eight nine ten"), (504, "aa aa aa aa aa aa"), (505, "   ")]


def test_against_brute_force(spark):
    rows = corpus()
    trusted = [i for i, _ in rows if i % 9 and i < 120]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, w int, lines string").repartition(5)
    out = q.rules(df, spark.createDataFrame([(i, 1) for i in trusted], "doc_id long, quality int"))
    got = sorted([(*tuple(r)[:-1], round(r["llr"], 9)) for r in out.collect()], key=str)
    assert got == brute(rows, set(trusted))
    assert any(r[7] for r in got) and any(not r[6] and not r[7] for r in got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_no_trusted_documents_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "one two three four five six seven eight nine ten"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert sorted((r["doc_id"] or 0, r["base_failed"], r["kept"], r["llr"]) for r in q.rules(df, none).collect()) == [(0, False, True, 0.0), (1, True, False, 0.0)]
    assert q.rules(df.where("false"), none).collect() == []
