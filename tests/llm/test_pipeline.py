import hashlib
import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from docmill.llm import mixing  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(900)]
    passage = " ".join(f"pass{i}age" for i in range(60))
    docs, labels = [], []
    for i in range(400):
        text = " ".join(r.choice(words) for _ in range(r.randint(20, 150)))
        good = r.random() < 0.7
        if not good:
            text = " | ".join(w.upper() + "!!" for w in text.split())
        elif i % 10 == 3:
            text += " " + passage
        elif i % 10 == 7 and docs:
            text = docs[r.randrange(len(docs))][1] + " x"
        docs.append((i, text, r.choice(["en", "de"]), r.choice(["a", "a", "b"]), len(text)))
        labels.append((i, int("|" not in text), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, "w " * 50000, "en", "a", 100000), (3, docs[3][1], "en", "a", 1), (None, "one text without an id at all", "en", "a", 30)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def near(a, b):
    s, t = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := re.findall(r"[^\x20\x09-\x0D]+", (x or "").lower())) else set() for x in (a, b))
    return s and t and 100 * len(s & t) >= 80 * len(s | t)


def test_stages_against_brute_force(spark, tables):
    docs = corpus_pipeline.documents(spark, tables)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    # quality: nearly all good documents stay and nearly all bad ones go
    out = stages["quality classifier"](spark, docs, tables)
    assert out.columns == columns
    rows = [tuple(r) for r in out.collect()]
    bad, good = ([r for r in rows if r[1] and r[0] is not None and r[0] < 400 and ("|" in r[1]) == b] for b in (True, False))
    total = [tuple(r) for r in docs.collect() if r[0] is not None and r[0] < 400]
    assert len(bad) <= 6 and len(good) >= sum("|" not in r[1] for r in total) - 6
    # near copies: the least id of each component stays, once
    out = stages["near-duplicate removal"](spark, docs, tables)
    assert out.columns == columns
    every = sorted({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}.items())
    root = {i: i for i, _ in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, t) in enumerate(every):
        for j, u in every[k + 1 :]:
            if near(t, u):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = out.collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(i for i in root if find(i) == i) and sum(r["doc_id"] is None for r in kept) == 1
    # repeated passages: as the windows say
    docs = docs.where("doc_id is null or doc_id < 902").dropDuplicates(["doc_id"])
    out = stages["repeated passage removal"](spark, docs, tables)
    assert out.columns == columns and out.dtypes == docs.dtypes
    seen = set()
    want = []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"])):
        data = (r["text"] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        text = bytes(b for b, g in zip(data, gone) if not g).decode()
        want.append((r["doc_id"], text, r["lang"], r["source"], len(text)))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    # mixing: the sampled ones of the operator
    out = stages["source mixing"](spark, docs, tables)
    assert out.columns == columns
    own = mixing.mixed(docs, budget=corpus_pipeline.TOKEN_BUDGET).where("sampled").select("row.doc_id", "text", "row.lang", "row.source", "row.n_chars")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, own.collect()), key=str) and 0.8 < out.count() / docs.count() <= 1
    out = stages["SentencePiece encoding"](spark, docs, tables).collect()
    assert all(r["round_trip"] for r in out) and {r["decoded_sha256"] for r in out} == {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()}


def test_run_and_empty_tables(spark, tables, tmp_path):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert 150 < len(rows) < 400 and len({r["doc_id"] for r in rows}) == len(rows)
    spark.read.parquet(f"{tables}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, score double, `row` int, kept string, id string, `hash` int, topic long, bands array<int>, m map<string,int>"


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_any_columns(spark, tables, k):
    """Nulls in any column, clashing and dotted names, repeated rows; and no rows."""
    text = " ".join(f"plain{i} words" for i in range(40))
    rows = [(i, f"{text} number {i * i} " + " ".join(f"own{i}x{j}" for j in range(60)), "en", "a", 1, "x", 0.1, 7, "k", "i", 3, 4, [1], {"a": i}) for i in range(20)]
    rows += [(50, None, *[None] * 12), (None, "no id here at all, only text", *[None] * 12), (51, "", *[None] * 12), (3, *rows[3][1:]), (3, *rows[3][1:6], 9.5, *rows[3][7:])]
    docs = spark.createDataFrame(rows, CLASHING)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, tables)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    if name == "near-duplicate removal":
        assert sorted((r["doc_id"] for r in got), key=str) == sorted([*range(20), 50, 51, None], key=str)
        assert [r["score"] for r in got if r["doc_id"] == 3] == [0.1]
    carried = lambda r: str((r["doc_id"], r["a.b"], r["row"], r["kept"], r["id"], r["hash"], r["topic"], r["bands"], r["m"]))
    assert got and {carried(r) for r in got} <= {carried(r) for r in docs.collect()}
    assert stage(spark, docs.where("false"), tables).collect() == []


def test_rows_with_one_id_and_different_texts(spark, tables):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup_stage(spark, docs, tables).collect())) == [(3, a), (5, b)]
