"""Words and pieces are told apart by their bytes: no operator may take one word for another because a weak hash does."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import lm_scoring, minhash_dedup, sentencepiece_codec, suffix_dedup, token_output, wordcache
from docmill.llm.textkernel import span_hashes

public_tokenizers = pytest.importorskip("public_tokenizers")


def twins(n=1024):
    """Two words of a and b on which polynomial hashes modulo 2^64 agree, whatever their base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module", params=[1, 8])
def twin_rows(spark, request):
    return spark.createDataFrame(list(enumerate(twins(), 1)), "doc_id long, text string").repartition(request.param)


def test_components_of_twins(twin_rows):
    got = sorted(tuple(r)[:4] for r in minhash_dedup.near_duplicates(twin_rows).collect())
    assert got == [(1, 1, 1, True), (2, 1, 2, True)]


def test_token_ids_of_twins(twin_rows):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    want = [zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes()) for x in twins()]
    assert [r["ids_crc32"] for r in sorted(token_output.token_table(twin_rows, file).collect())] == want


def test_pieces_of_twins(twin_rows):
    rows = sorted(sentencepiece_codec.encoded(twin_rows, public_tokenizers.path("piece_bpe_32k.model")).collect())
    assert [r["round_trip"] for r in rows] == [True, True] and [r["decoded_sha256"] for r in rows] == [hashlib.sha256(x.encode()).hexdigest() for x in twins()]


def test_counts_of_twins(twin_rows):
    rows = sorted(lm_scoring.lm_scores(twin_rows, lambda i: i == 1).collect())
    assert [(r["n_tokens"], r["n_known"]) for r in rows] == [(2, 2), (2, 1)]


def test_a_common_head_does_not_remove_different_tails(spark):
    head = "".join(chr(97 + i * i % 23) for i in range(64))
    df = spark.range(40000).select(F.col("id").alias("doc_id"), F.concat(F.lit(head), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 36)).alias("text"))
    out = suffix_dedup.repeated_spans(df)
    assert out.where("n_bytes <> 100 or n_removed <> 0").count() == 0


def test_equal_hashes_do_not_make_equal_pieces(monkeypatch):
    monkeypatch.setattr(wordcache, "span_hashes", lambda data, starts, ends, lower: np.zeros(len(starts), np.uint64))
    cache = wordcache.WordCache(lambda pieces: [list(p) for p in pieces], 100)
    for text in (b"one two one three", b"three tw one four " + b"x" * 99 + b" " + b"x" * 98 + b"y"):
        spans = [m.span() for m in re.finditer(rb"\S+", text)]
        starts, ends = (np.array(x) for x in zip(*spans))
        ids, at = cache.ids(np.frombuffer(text, np.uint8), starts, ends, np.array([0, len(starts)]))
        assert ids.tolist() == [b for a, z in spans for b in text[a:z]] and at[-1] == len(ids)


def test_span_hashes_part_short_and_long_spans():
    texts = sorted({bytes(x) for n in range(1, 200, 7) for x in ([97] * n, [98] * n, [97] * (n - 1) + [98], [98] + [97] * (n - 1), [0] * n)})
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    for seed in (0, 1):
        assert len(np.unique(span_hashes(data, starts, ends, seed=seed))) == len(texts)
    same = np.frombuffer(b"ABC abc" + b"Z" * 80 + b"z" * 80, np.uint8)
    h = span_hashes(same, np.array([0, 4, 7, 87]), np.array([3, 7, 87, 167]))
    assert h[0] == h[1] and h[2] == h[3]
