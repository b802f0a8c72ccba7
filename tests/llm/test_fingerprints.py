import hashlib
import random

import numpy as np
import pytest

from docmill.llm import fingerprints as fp


def points(text):
    return fp._points(text)


def test_span_equality_and_extension_against_strings():
    r = random.Random(1)
    text = "".join(r.choice("aé😀") for _ in range(400)) * 3
    prefix, n = fp.Prefix(points(text)), len(text)
    a, b = (np.array([r.randrange(n) for _ in range(500)]) for _ in range(2))
    size = np.minimum(np.array([r.randrange(30) for _ in range(500)]), n - np.maximum(a, b))
    equal = prefix.hash(a, a + size) == prefix.hash(b, b + size)
    assert equal.tolist() == [text[x : x + s] == text[y : y + s] for x, y, s in zip(a, b, size)]
    most = n - np.maximum(a, b)

    def brute(x, y):
        k = 0
        while max(x, y) + k < n and text[x + k] == text[y + k]:
            k += 1
        return k

    assert prefix.extension(a, b, most).tolist() == [brute(x, y) for x, y in zip(a.tolist(), b.tolist())]


def prints(texts):
    p = fp.Prints(*fp._concatenated([points(t) for t in texts]))
    return [p.text(i) for i in range(len(texts))]


def test_fingerprints_do_not_depend_on_the_place():
    texts = ["", "a", "abc", "x" * 15, "x" * 16, "hello world " * 50, "é😀" * 40]
    assert prints(texts) == [prints([t])[0] for t in texts] and len(set(prints(texts))) == len(texts)


def test_likeness():
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh ") for _ in range(4000))
    other = "".join(r.choice("abcdefgh ") for _ in range(4000))
    a, half, moved, b, empty = prints([text, text[:2000] + other[:2000], "new start " + text, other, ""])
    assert fp.likeness(a, a) == 1 and fp.likeness(empty, empty) == 1 and fp.likeness(a, empty) == 0
    assert 0.35 < fp.likeness(a, half) < 0.7 and fp.likeness(a, moved) > 0.9 and fp.likeness(a, b) < 0.1


def corpus():
    r = random.Random(3)
    rows = [(i * 13, "".join(r.choice("abc défg😀\n") for _ in range(r.randint(0, 120)))) for i in range(150)]
    return rows + [(5000, None), (5001, ""), (5002, "x"), (5003, "y" * 700), (5004, "z" * 33), (5005, "long text, " * 120), (5006, "a long text, " * 120)]


M = 2**31 - 1


def plain_hash(text, base):
    return sum((ord(c) + 1) * pow(base, k, M) for k, c in enumerate(text)) % M


def plain_mix(x):
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32


def plain_print(text):
    """(fingerprint, places of the sketch's spans by bin and hash), from the definition, in plain numbers."""
    one, two = (lambda t, b=b: plain_hash(t, b) for b in (1_000_003_337, 1_729_404_049))
    both = lambda t: one(t) << 31 | two(t)
    rungs = [r for r in sorted({x for k in range(20) for x in (1 << k, (3 << k) // 2)}) if r <= len(text)]
    spans = [(k, text[k : k + 16]) for k in range(max(len(text) - 15, 1))] if text else []
    bins = {}
    for k, span in spans:
        h = plain_mix(one(span) + 1)
        bins[h >> 58] = min(bins.get(h >> 58, (2**32 - 1, 0)), (h & 0xFFFFFFFE, k))
    sketch = "".join(f"{bins.get(k, (2**32 - 1, 0))[0]:08x}" for k in range(64))
    return f"{len(text):x}.{both(text):016x}.{''.join(f'{both(text[:r]) % 2**32:08x}' for r in rungs)}.{sketch}", bins


def plain_near(t, u):
    """(likeness, common prefix) by comparing letters around the seeds."""
    p, q = plain_print(t)[1], plain_print(u)[1]
    seeds = [(0, 0), (len(t), len(u)), *((p[k][1], q[k][1]) for k in p if k in q and p[k][0] == q[k][0])]
    own, other = set(), set()
    for a, b in seeds:
        k = 0
        while a + k < len(t) and b + k < len(u) and t[a + k] == u[b + k]:
            k += 1
        j = 0
        while a - j > 0 and b - j > 0 and t[a - j - 1] == u[b - j - 1]:
            j += 1
        own |= set(range(a - j, a + k))
        other |= set(range(b - j, b + k))
    prefix = next((k for k, (x, y) in enumerate(zip(t, u)) if x != y), min(len(t), len(u)))
    return ((len(own) + len(other)) / (len(t) + len(u)) if t or u else 1.0), prefix


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        (x, a), (y, b) = plain_near(t, e), plain_near(t, u)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_print(t)[0], plain_print(e)[0], x, y, a, b))
    return sorted(out)


def test_texts_that_share_a_middle_and_moved_parts():
    r = random.Random(5)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    x, y = prose(3000), prose(3000)
    texts = [x, "new start " + x, y, y[:1000] + x[1000:2500] + y[1000:], x[1500:] + x[:1500], x]
    run = fp.Prints(*fp._concatenated([points(t) for t in texts]))
    near, prefix = run.likeness(np.array([0, 2, 4, 1]), np.array([1, 3, 5, 2]))
    assert near[0] > 0.99 and near[1] > 0.6 and near[2] > 0.99 and near[3] < 0.05 and prefix.tolist()[:2] == [0, 1000]


def near(rows):
    return [tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in rows]


@pytest.mark.parametrize("shuffles", [1, 7])
def test_against_brute_force(spark, shuffles):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, mark string").repartition(5)
    got = sorted(map(tuple, fp.fingerprints(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert near(got) == near(brute(rows))


def test_very_long_texts_in_runs_of_their_own(spark):
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(fp.CHUNK + 5000))
    rows = fp.fingerprints(spark.createDataFrame([(3, long), (2, long), (1, "short"), (0, long[:1000])], "doc_id long, text string")).collect()
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["near_next"] == 1 and got[3]["fingerprint"] == got[2]["fingerprint"] and got[2]["near_next"] < 0.01
    assert 0.5 <= got[3]["near_edited"] < 1 and got[3]["prefix_edited"] >= len(long) - len(long) // 2 and got[0]["prefix_next"] == 1000


def test_one_row_none_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "abcdef"), (7, "q" * 40), (7, "q" * 40), (7, "p" * 40)], "doc_id long, text string")
    one = fp.fingerprints(df.where("doc_id is null")).collect()
    assert [(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in one] == [(None, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    rows = fp.fingerprints(df).collect()
    assert sorted((r["doc_id"] or -1) for r in rows) == [-1, 7, 7, 7] and len({r["fingerprint"] for r in rows}) == 3
    assert fp.fingerprints(df.where("false")).collect() == []
