import threading
import time

import pytest
from pyspark.sql import functions as F

from docmill.functions import instruments
from docmill.functions.folding import fold
from docmill.functions.numbering import numbered
from docmill.functions.storage import clean, shared_root, stored
from docmill.operators import index, search
from docmill.operators.documents import documents, field_terms, set_field
from docmill.sources.generator import generated
from docmill.sources.store import DocumentStore, StoreLocked
from docmill.streaming.ingest import ingest


@pytest.mark.parametrize(
    "a,b,equal",
    [("é", "É", True), ("ǆ", "ǅ", True), ("𐐨", "𐐀", True), ("ß", "SS", False), ("ŉ", "ʼN", False), ("ﬁ", "FI", False), ("ß", "ẞ", False), ("ς", "Σ", True), ("ı", "I", False), ("K", "k", False), ("Abc", "aBC", True), ("", "", True)],
)
def test_case_folding(spark, a, b, equal):
    assert spark.range(1).select(fold(F.lit(a)) == fold(F.lit(b))).first()[0] is equal


def docs(spark, n):
    return documents(spark.range(n).selectExpr("id", "concat('Name', id % 7) as name", "if(id % 3 = 0, null, concat('v', id)) as value"), "id", "name", "value")


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 300])
def test_chunks_and_tail(spark, n):
    rows = index.chunked(docs(spark, n), "doc_id").collect()
    assert sorted((r["doc_id"], r["chunk_id"], r["full"]) for r in rows) == [(i, i // 128, i // 128 < n // 128) for i in range(n)]


def test_index_and_scan_find_the_same(spark):
    rows = index.chunked(docs(spark, 300), "doc_id")
    full, tail = rows.where("full"), rows.where("not full")
    posts = index.postings(full)
    for field, term in [("name", "nAME3"), ("value", "V290"), ("value", "v1"), ("name", "none"), ("other", "x"), ("value", "v3")]:
        scan = sorted(r["doc_id"] for r in search.scan(docs(spark, 300), field, term).collect())
        assert sorted(r["doc_id"] for r in search.indexed(full, posts, tail, field, term).collect()) == scan


def test_numbers_are_dense_and_in_order(spark):
    rows = numbered(spark.range(1000).selectExpr("(id * 7919) % 1000 as x").repartition(7), "n", "x", start=5).collect()
    assert sorted((r["x"], r["n"]) for r in rows) == [(i, i + 5) for i in range(1000)]


def test_nulls_are_no_fields_and_set_field_replaces(spark):
    rows = documents(spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, x string, y string"), "id", "x", "y")
    assert field_terms(rows).collect() == [(1, "x", "a")]
    changed = set_field(set_field(rows, "x", F.lit("b")), "z", F.lit(1))
    assert sorted(map(tuple, field_terms(changed).collect())) == [(1, "x", "b"), (1, "z", "1"), (2, "x", "b"), (2, "z", "1")]


def maps(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "fields map<string,string>")


def found(store, field, term):
    return sorted(r["fields"]["id"] for r in store.search(field, term).collect())


def test_store_life(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/db")
    assert found(store, "id", "1") == [] and store.commit() == 0 and store.last_id() == 0
    store.add(maps(spark, {"id": "a", "kind": "Red"}, {"id": "b", "kind": "blue", "extra": None}))
    store.add(maps(spark))
    assert found(store, "kind", "RED") == ["a"] and found(store, "extra", "x") == [] and store.last_id() == 2
    store.add(generated(spark, 250).select("fields"), batch="bulk")
    store.add(generated(spark, 250).select("fields"), batch="bulk")  # accepted once
    assert store.last_id() == 252 and store.commit() == 1 and store.tail().count() == 252 - 128
    assert found(store, "kind", "red") == ["a"] and found(store, "id", "7") == ["7"] and found(store, "id", "249") == ["249"]
    again = DocumentStore(spark, f"file://{tmp_path}/db")  # opened anew: the same, and ids go on
    assert found(again, "kind", "BLUE") == ["b"]
    again.add(generated(spark, 10).select("fields"))
    assert again.last_id() == 262 and found(again, "id", "7") == ["7", "7"]
    assert again.commit() == 1 and again.next_segment() == 3 and again.tail().count() == 262 - 256
    assert found(again, "id", "7") == ["7", "7"] and {"id", "kind", "field1"} <= set(again.fields())
    assert sorted(r["doc_id"] for r in again.replay_after(260).collect()) == [261, 262]
    assert len(again.truncate()) == 2 and found(again, "kind", "red") == ["a"] and again.last_id() == 262
    assert again.chunk(1).count() == 128 and again.search_tail(F.col("doc_id") > 260).count() == 2


def test_a_commit_that_failed_between_postings_and_data(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/db")
    store.add(generated(spark, 200).select("fields"))
    rows = index.chunked(store.tail()).where("full")
    index.postings(rows).write.partitionBy("field").parquet(f"{store.root}/postings/segment=00000001")
    assert found(store, "id", "5") == ["5"]
    assert store.commit() == 1 and found(store, "id", "5") == ["5"]


def test_stream_adds_each_batch_once(spark, tmp_path):
    source = f"{tmp_path}/in"
    generated(spark, 150).select("fields").coalesce(1).write.parquet(source)
    store = DocumentStore(spark, f"file://{tmp_path}/db")
    for _ in range(2):
        stream = spark.readStream.schema("fields map<string,string>").parquet(source)
        ingest(stream, store, f"file://{tmp_path}/state").awaitTermination()
    assert store.last_id() == 150 and store.data().count() == 128 and found(store, "id", "150") == ["150"]
    maps(spark, {"id": "new"}).coalesce(1).write.mode("append").parquet(source)
    ingest(spark.readStream.schema("fields map<string,string>").parquet(source), store, f"file://{tmp_path}/state").awaitTermination()
    assert found(store, "id", "NEW") == ["new"] and store.last_id() == 151


def test_batch_search_counts_hits(spark):
    rows = docs(spark, 20)
    asked = spark.createDataFrame([("a", "name", "NAME1"), ("b", "name", "zzz"), ("c", "value", "V4")], "query_id string, field string, term string")
    assert sorted(map(tuple, search.hit_counts(search.batch(rows, asked), asked).collect())) == [("a", 3), ("b", 0), ("c", 1)]


def test_a_second_writer_is_refused_and_a_dead_one_is_not_waited_for(spark, tmp_path, monkeypatch):
    store, other = (DocumentStore(spark, f"file://{tmp_path}/db") for _ in range(2))
    with store._writing():
        for work in (lambda: other.add(maps(spark, {"id": "x"})), other.commit, other.truncate):
            with pytest.raises(StoreLocked):
                work()
        assert found(other, "id", "x") == []
    other.add(maps(spark, {"id": "x"}))
    fs, path = store._path("writer")
    assert fs.createNewFile(path)
    monkeypatch.setattr("docmill.sources.store.LOCK_SECONDS", -1)
    store.add(maps(spark, {"id": "y"}))
    assert store.last_id() == 2 and not fs.exists(path)


def test_writers_and_readers_at_the_same_time(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/db")
    refused, hits = [], []

    def write(k):
        for i in range(3):
            while True:
                try:
                    DocumentStore(spark, store.root).add(maps(spark, {"id": f"{k}-{i}", "kind": "same"}))
                    break
                except StoreLocked:
                    refused.append(k)
                    time.sleep(0.2)

    def read():
        for _ in range(4):
            hits.append(store.search("kind", "SAME").count())

    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)] + [threading.Thread(target=read)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["doc_id"] for r in store.search("kind", "same").collect()) == [1, 2, 3, 4, 5, 6]
    assert hits == sorted(hits) and all(0 <= h <= 6 for h in hits)


def test_a_dropped_batch_that_runs_again_is_not_added(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/db")
    for name, n in (("a", 128), ("b", 5)):
        store.add(generated(spark, n).select("fields"), name)
    assert store.commit() == 1 and store.checkpoint() == [] and store.checkpoint(least=1) == ["a"]
    store.add(generated(spark, 128).select("fields"), "a")
    assert store.last_id() == 133 and found(store, "id", "100") == ["100"]


def test_a_lookup_prunes_fields_and_pushes_the_term_down(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/db")
    store.add(generated(spark, 300).select("fields"))
    store.commit()
    plan = store.candidates("field1", "Value 3")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(field" in plan and "= field1)]" in plan and "PushedFilters: [IsNotNull(term_key), EqualTo(term_key," in plan


def test_instruments_add_up_by_name_and_may_be_absent():
    writer = instruments.Aggregating()
    with instruments.timed("nobody listens"):
        pass
    instruments.use(writer)
    try:
        for name in ("Wal_Commit", "wal_commit", "grep_filter"):
            with instruments.timed(name):
                time.sleep(0.001)
        with pytest.raises(KeyError), instruments.timed("grep_filter"):
            raise KeyError
    finally:
        instruments.use(None)
    sums = writer.sums()
    assert {k: n for k, (n, _) in sums.items()} == {"grep_filter": 2, "wal_commit": 2} and all(t > 0 for _, t in sums.values())
    assert sums["wal_commit"][1] >= 2_000_000 and writer.text().startswith("grep_filter: ")


def test_clean_leaves_nothing(spark):
    path = shared_root(spark, "test")
    stored(spark.range(3), path)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    clean(spark)
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_fields_are_the_folders_with_any_names(spark, tmp_path):
    store = DocumentStore(spark, f"file://{tmp_path}/db")
    store.add(maps(spark, *({"id": str(i), "a=b/c:d %": "x", "": "y"} for i in range(128))))
    assert store.fields() == [] and store.commit() == 1 and store.search("a=b/c:d %", "X").count() == 128
    assert store.fields() == ["", "a=b/c:d %", "id"] and store.search("", "Y").count() == 128
