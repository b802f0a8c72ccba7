import hashlib
import random

import numpy as np
import pyarrow as pa

from docmill.llm import blocks, suffix_dedup
from docmill.llm.suffix_dedup import byte_digits, msd_groups, repeated_spans, without_repeats


def brute(rows, length=100):
    """Expected (doc_id, n_bytes, n_removed, n_spans, sha256), by a dictionary of all windows."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéfghß ") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, rows = prose(40), []
    for i in range(60):
        text = prose(r.randint(0, 60))
        if i % 3 == 0:
            text += passage + prose(r.randint(0, 9))
        if i % 7 == 0 and rows:
            text = rows[r.randrange(len(rows))][1] or ""
        if i % 11 == 0 and rows:
            t = rows[r.randrange(len(rows))][1] or ""
            text = t[: len(t) // 2] + "X" + t[len(t) // 2 + 1 :]
        rows.append((i * 3 % 61, text))
    rows += [(100, None), (101, ""), (102, "a" * 700), (103, "ab" * 300), (104, "x" * 99), (105, "x" * 100), (106, "x" * 101), (None, passage), (107, passage), (107, passage), (108, "é" * 90)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in repeated_spans(df).collect()), key=str)
    assert got == brute(rows)


def test_hot_passage_extra_columns_and_custom_names(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{i * 7919} {passage} {i * 104729}", i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "key long, body string, block long, payload string").repartition(7)
    got = sorted((tuple(r) for r in repeated_spans(df, "key", "body").collect()), key=str)
    assert got == brute([r[:2] for r in rows])


def test_texts_stay_whole_characters(spark):
    rows = [(1, "é" * 60 + "q"), (2, "ß" + "é" * 60 + "z"), (3, None)]
    got = {r["doc_id"]: r for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["kept_text"].startswith("ß") and got[2]["kept_text"].endswith("z") and len(got[2]["kept_text"]) < 10
    assert got[3]["kept_text"] == ""


def test_empty_table(spark):
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_windows_that_share_their_first_64_bytes(spark):
    # of the last 64 bytes of either pair, the upper 32 bits of one 64-bit fingerprint are equal
    shared = "xtzuwptbgskuztnwzbeumhhgorngoxbrnjfpmpzxhqugjekgrkhzphqmdzifpyyt"
    ends = ["hsdzyyiacxhcshdslftqgyitkufqgoqibhri", "cgfyxynalurstxgpijnqfqnquacdqpohgxcl", "kbmygsevkevjcyzxtujplvwmuukvoatjbvmj", "mekqhzygpebbvpkxucndahfvlulyvlyfjxtw"]
    rows = [(i, shared + end) for i, end in enumerate([*ends, ends[0]])]
    for parts in (1, 5):
        got = sorted((tuple(r) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()), key=str)
        assert got == brute(rows)


def test_radix_groups_are_those_of_the_bytes():
    r = random.Random(7)
    data = bytes(r.choice(b"ab") for _ in range(3000)) * 2 + bytes(64)
    starts = np.array([r.randrange(5900) for _ in range(700)])
    ends = np.minimum(starts + np.array([r.choice([1, 7, 8, 9, 30, 100]) for _ in range(700)]), 6000)
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    order, group, size = msd_groups([ends - starts, *byte_digits(words, starts, ends)], starts)
    spans = [(z - a, data[a:z], a) for a, z in zip(starts.tolist(), ends.tolist())]
    assert [spans[i] for i in order] == sorted(spans)  # the order is that of the bytes
    numbers = {s: k for k, s in enumerate(sorted({s[:2] for s in spans}))}
    assert group.tolist() == [numbers[spans[i][:2]] for i in order] and size.tolist() == [sum(s[:2] == spans[i][:2] for s in spans) for i in order]


def test_very_long_texts_and_hashes_that_are_all_equal(spark, monkeypatch):
    r = random.Random(2)
    prose = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, long = prose(5000), prose(1_300_000)
    rows = [(1, long[:700_000] + passage + long[700_000:]), (2, prose(300) + passage), (3, long[650_000:680_000])]
    got = sorted((tuple(x) for x in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == brute(rows)
    # within one block equal hashes alone make nothing equal
    block = blocks._pack(pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [prose(400), prose(400)]}))
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x * 0)
    spans = suffix_dedup.Spans(block)
    assert len(spans.copies) == 0 and len(spans.wide(spans.classes)[3]) == 0
