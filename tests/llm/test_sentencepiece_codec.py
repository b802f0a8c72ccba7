import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm.sentencepiece_codec import Codec, codec, decoded, encoded

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def encode(texts):
    data = [t.encode() for t in texts]
    ids, at = codec(open(MODEL, "rb").read()).encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


WORDS = ["Hello", "the", "naïve", "Straße", "ionnd", "thntingation", "123", "漢字", "<s>", "</s>", "😀", "▁", " ", "  ", "\n", "\t", "a\nb", "...", "!!!", "|", "\x00"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=12), st.integers(1, 40).map(lambda n: " " * n)), max_size=30))
def test_same_ids_as_the_library(parts):
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=MODEL)
    texts = ["".join(parts), " ".join(parts)]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode(texts) == [own.encode(t) for t in texts]


def test_same_ids_on_documents(library):
    import pyarrow.parquet as pq

    try:
        texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    except FileNotFoundError:
        pytest.skip("no test data")
    assert encode(texts) == [library.encode(t) for t in texts]


def test_viterbi_of_unigram_scores():
    own = Codec.__new__(Codec)
    import ahocorasick

    own.merging, own.unknown_score = False, -20.0
    own.score = {"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -9.0, "c": -1.0, "bc": -1.1}
    own.id = {p: i for i, p in enumerate(own.score)}
    own.automaton = ahocorasick.Automaton()
    for p in own.id:
        own.automaton.add_word(p, p)
    own.automaton.make_automaton()
    assert own.segment("abcab") == ["a", "bc", "ab"] and own.segment("xab") == ["x", "ab"]


def test_operator_round_trips(spark, library):
    r = random.Random(1)
    rows = [(i, "".join(r.choice(WORDS) + r.choice(["", " "]) for _ in range(r.randint(0, 50))).replace("▁", "")) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " "), (503, "a" * 20000), (504, "x y " * 30000), (504, "x"), (None, "z"), (505, "a▁b")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pieces string, n_pieces int").repartition(5)
    out = encoded(df, MODEL)
    got = sorted([(r["doc_id"] or -1, r["pieces"], r["n_pieces"], r["decoded_sha256"], r["round_trip"]) for r in out.collect()], key=str)
    back = lambda t: t.replace("▁", " ")
    want = [(i or (0 if i == 0 else -1), library.encode(t or ""), len(library.encode(t or "")), hashlib.sha256(back(t or "").encode()).hexdigest(), "▁" not in (t or "")) for i, t in rows]
    want = [((-1 if w[0] == 0 else w[0]), *w[1:]) for w in want]
    assert got == sorted(want, key=str)
    texts = sorted(((r["doc_id"] or -1), r["text"]) for r in decoded(out, MODEL).collect())
    assert texts == sorted(((i or -1), back(t or "")) for i, t in rows)


def test_empty_table(spark):
    assert encoded(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


@pytest.fixture(scope="module")
def unigram():
    """The public model's pieces with scores of a unigram model."""
    from sentencepiece import sentencepiece_model_pb2

    model, r = sentencepiece_model_pb2.ModelProto(), np.random.default_rng(1)
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if piece.type == 1:
            piece.score = float(-8 - np.log(i + 1) + 1.3 * len(piece.piece) + r.normal(0, 0.5))
    return model.SerializeToString()


def test_unigram_models_against_the_library_and_a_plain_viterbi(unigram):
    """The best sum of scores over all 32,000 pieces.  Among equal sums the library's choice is its rounding's."""
    import pyarrow.parquet as pq
    from sentencepiece import SentencePieceProcessor

    own, library = Codec(unigram), SentencePieceProcessor(model_proto=unigram)
    assert not own.merging
    try:
        texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    except FileNotFoundError:
        pytest.skip("no test data")
    texts = [t or "" for t in texts] + ["😀 漢字 xyz", "a  b", "  ", "\n\t", "<s>", "zzzz😀😀zz"]
    score = np.array([library.get_score(i) for i in range(library.get_piece_size())])
    score[list(own.byte_id.values())] = 0
    same = 0
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = own.encode(data, np.array([0, len(data)]))
        want = library.encode(text)
        same += ids.tolist() == want
        assert abs(score[ids].sum() - score[want].sum()) < 1e-3 * max(1, len(want) / 100)
    assert same > 0.9 * len(texts)

    def plain(text):
        best = [(0.0, [])] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 20), end):
                piece = text[start:end]
                s = own.score.get(piece, own.unknown_score if len(piece) == 1 else None)
                if s is not None and best[start] is not None and (best[end] is None or best[start][0] + s > best[end][0]):
                    best[end] = (best[start][0] + s, [*best[start][1], piece])
        return best[-1][0]

    for text in texts[:60]:
        text = "▁" + text[:300].replace(" ", "▁")
        assert abs(sum(own.score.get(p, own.unknown_score) for p in own.segment(text)) - plain(text)) < 1e-6


def test_a_model_that_changes_texts_is_refused(unigram):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(unigram)
    model.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="normalizer_spec"):
        Codec(model.SerializeToString())


def test_a_model_without_byte_pieces_has_the_unknown_one(unigram):
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(unigram)
    model.trainer_spec.byte_fallback = False
    kept = [p for p in model.pieces if p.type != 6]
    del model.pieces[:]
    model.pieces.extend(kept)
    raw = model.SerializeToString()
    data = "one 𒀀 two".encode()
    ids, _ = Codec(raw).encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert ids.tolist() == SentencePieceProcessor(model_proto=raw).encode(data.decode())
