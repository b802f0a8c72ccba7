"""Every registered query over the whole of the smallest tables, against plain code or the libraries."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from docmill.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def rows():
    t = pq.read_table(f"{SF}/documents.parquet")
    return sorted(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))


def run(spark, name):
    found = [q for n, q in queries.queries().items() if n.startswith(name)]
    return sorted(found[0](spark, SF).collect(), key=lambda r: r["doc_id"])


def held_out(doc_id, folds, out):
    return zlib.crc32(str(doc_id).encode()) % folds == out


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_op2(spark, rows):
    from test_token_output import expected

    got = run(spark, "op2_")
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == expected([(i, t or "") for i, t in rows])


@pytest.mark.parametrize("name,label,folds,out", [("op3_", "toxic", 5, 0), ("op4_", "quality", 3, 1)])
def test_op3_and_op4(spark, rows, name, label, folds, out):
    got = run(spark, name)
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for r in got:
        assert r["held_out"] == held_out(r["doc_id"], folds, out) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    predicted = {r["doc_id"]: r["predicted"] for r in got}
    own = [predicted[x["doc_id"]] == x[label] for x in labels if x["doc_id"] in predicted and held_out(x["doc_id"], folds, out)]
    assert np.mean(own) > 0.8


def test_op5(spark, rows):
    from test_fingerprints import plain_near, plain_print

    got = {r["doc_id"]: r for r in run(spark, "op5_")}
    order = [(i, t or "") for i, t in reversed(rows)]
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        if max(len(t), len(u)) < 400:
            assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (plain_print(t)[0], plain_print(e)[0])
            for other, near, prefix in ((e, "near_edited", "prefix_edited"), (u, "near_next", "prefix_next")):
                want = plain_near(t, other)
                assert abs(got[i][near] - want[0]) < 1e-9 and got[i][prefix] == want[1]


def test_op6(spark, rows):
    from test_quality_rules import brute

    good = {x["doc_id"] for x in pq.read_table(f"{SF}/labels.parquet").to_pylist() if x["quality"] == 1}
    got = [(*(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), round(r["llr"], 9)) for r in run(spark, "op6_")]
    assert sorted(got, key=str) == brute(rows, good)


def test_op7(spark, rows):
    from test_lm_scoring import base

    got = run(spark, "op7_")
    for r, (i, n, known, total, score) in zip(got, base(rows), strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held_out(i, 10, 0), n, known, total)
        assert abs(r["base_score"] - score) < 1e-6 * max(1, abs(score)) and r["score"] <= 1e-9
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op9(spark, rows):
    from test_mixing import plain_topics

    got = run(spark, "op9_")
    assert [r["topic"] for r in got] == plain_topics(rows) and all(0 < r["probability"] <= 1 for r in got)


def test_op10(spark, rows):
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    for r, (i, t) in zip(run(spark, "op10_"), rows, strict=True):
        assert (r["doc_id"], r["pieces"]) == (i, own.encode(t or "")) and r["round_trip"]
