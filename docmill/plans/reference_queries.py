"""Queries of the document index, each with the SQL that gives the same rows.

Documents here are rows of a test table with some of its columns as fields.  Chunks are of 128 documents by ascending id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.storage import shared_root
from docmill.operators import index, search
from docmill.operators.documents import documents, field_terms, set_field, to_json

FIELDS = ("lang", "source")
AFTER = 500
TERMS = [("q1", "lang", "EN"), ("q2", "lang", "de"), ("q3", "source", "Src3"), ("q4", "source", "nowhere"), ("q5", "other", "en")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return documents(table(spark, sf_dir, "documents"), "doc_id", *(fields or FIELDS))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.chunked(docs(spark, sf_dir), "doc_id")


def full_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(chunks(spark, sf_dir).where("full"))


def search_lang_ci(spark, sf_dir):
    """One field's whole value, ignoring case, over a physical column."""
    return search.scan_column(table(spark, sf_dir, "documents"), "lang", "EN").select("doc_id", "lang", "source", "n_chars")


def search_missing_term(spark, sf_dir):
    return search.scan(docs(spark, sf_dir), "lang", "no such language").select("doc_id")


def search_unknown_field(spark, sf_dir):
    return search.scan(docs(spark, sf_dir), "no such field", "en").select("doc_id")


def search_customer_segment(spark, sf_dir):
    return search.scan_column(table(spark, sf_dir, "customer"), "c_mktsegment", "Building").select("c_custkey", "c_name", "c_mktsegment")


def search_order_priority(spark, sf_dir):
    return search.scan_column(table(spark, sf_dir, "orders"), "o_orderpriority", "1-urgent").select("o_orderkey", "o_custkey", "o_orderpriority")


def search_event_type(spark, sf_dir):
    return search.scan_column(table(spark, sf_dir, "events"), "event_type", "PURCHASE").select("event_id", "user_id", "event_type")


def search_text_exact(spark, sf_dir):
    """A long value as the term: the text of the document with id 7."""
    rows = table(spark, sf_dir, "documents")
    term = rows.where("doc_id = 7").select("text").first()
    return search.scan_column(rows, "text", term["text"] if term else "").select("doc_id", "n_chars")


def chunk_assignment(spark, sf_dir):
    return index.chunk_summary(chunks(spark, sf_dir))


def tail_docs(spark, sf_dir):
    return chunks(spark, sf_dir).where("not full").select("doc_id", F.col("fields")["lang"].alias("lang"), F.col("fields")["source"].alias("source"))


def tail_predicate(spark, sf_dir):
    """Any predicate over the tail."""
    return chunks(spark, sf_dir).where("not full").where(F.length(F.col("fields")["source"]) > 4).select("doc_id")


def chunk_read(spark, sf_dir):
    """One chunk by its number."""
    return chunks(spark, sf_dir).where("chunk_id = 3").select("doc_id", F.col("fields")["lang"].alias("lang"))


def doc_field_terms(spark, sf_dir):
    return field_terms(docs(spark, sf_dir))


def set_field_value(spark, sf_dir):
    """Upsert of a field there is and of a new one."""
    changed = set_field(set_field(docs(spark, sf_dir), "lang", F.lit("xx")), "doc", F.col("doc_id"))
    return field_terms(changed)


def inverted_index(spark, sf_dir):
    return full_index(spark, sf_dir).select("field", "term", "chunk_id")


def posting_list_ends(spark, sf_dir):
    return index.posting_ends(full_index(spark, sf_dir))


def posting_list_entries(spark, sf_dir):
    """The lists themselves, unfolded: every entry with its place."""
    lists = index.posting_lists(full_index(spark, sf_dir), span=2)
    return lists.select("field", "term", "part", F.posexplode("postings").alias("place", "chunk_id"))


def posting_lengths(spark, sf_dir):
    return index.posting_lengths(full_index(spark, sf_dir))


def term_counts_per_field(spark, sf_dir):
    return index.term_counts(full_index(spark, sf_dir))


def index_fields(spark, sf_dir):
    return full_index(spark, sf_dir).select("field").distinct()


def indexed_search(spark, sf_dir):
    """Through the index; the same documents as a scan."""
    rows = chunks(spark, sf_dir)
    return search.indexed(rows.where("full"), index.postings(rows.where("full")), rows.where("not full"), "source", "SRC3").select("doc_id")


def segment_union_dedupe(spark, sf_dir):
    """Two segments, by parity of the ids: the chunks of one term over both, each once."""
    rows = chunks(spark, sf_dir).where("full")
    one, two = (index.postings(rows.where(f"doc_id % 2 = {k}")) for k in (0, 1))
    return index.candidates(one, "lang", "EN").unionAll(index.candidates(two, "lang", "EN")).distinct()


def index_footer(spark, sf_dir):
    return index.footer(full_index(spark, sf_dir))


def memory_pressure_score(spark, sf_dir):
    return index.memory_score(full_index(spark, sf_dir))


def commit_info(spark, sf_dir):
    """What a commit wrote: chunk and document."""
    return chunks(spark, sf_dir).where("full").select("chunk_id", "doc_id")


def last_committed_doc(spark, sf_dir):
    return index.last_committed(chunks(spark, sf_dir))


def wal_replay_after(spark, sf_dir):
    return docs(spark, sf_dir).where(F.col("doc_id") > AFTER).select("doc_id", F.col("fields")["source"].alias("source"))


def wal_truncate(spark, sf_dir):
    """The log from the batch (of 256) on that holds a document."""
    rows = index.batches(docs(spark, sf_dir), "doc_id", 256)
    batch = rows.where(F.col("doc_id") == AFTER).select("batch_id").first()
    return rows.where(F.col("batch_id") >= (batch["batch_id"] if batch else 0)).select("doc_id", "batch_id")


def batch_ends(spark, sf_dir):
    """First and last document of each batch; the last batch may be short."""
    rows = index.batches(docs(spark, sf_dir), "doc_id", 256)
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.min_by(F.col("fields")["source"], "doc_id").alias("first_source"), F.max_by(F.col("fields")["source"], "doc_id").alias("last_source"))


def next_doc_ids(spark, sf_dir):
    """New documents (here: nations) get the ids after the last one."""
    return index.next_numbers(docs(spark, sf_dir), "doc_id", table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), "n_nationkey").select("doc_id", "n_name")


def batch_search(spark, sf_dir):
    return search.batch(docs(spark, sf_dir), spark.createDataFrame(TERMS, "query_id string, field string, term string"))


def load_test_hits(spark, sf_dir):
    """Point searches for ids, every third one and some that don't exist: hits of each."""
    ids = table(spark, sf_dir, "documents")
    found = documents(ids.withColumn("id", F.col("doc_id")), "doc_id", "id")
    asked = ids.where("doc_id % 3 = 0").select((F.col("doc_id") * 2).cast("string").alias("term")).select(F.col("term").alias("query_id"), F.lit("id").alias("field"), "term")
    return search.hit_counts(search.batch(found, asked), asked)


def gzip_round_trip(spark, sf_dir):
    """Documents written as gzip Parquet and read again."""
    rows = docs(spark, sf_dir)
    path = shared_root(spark, "gzip")
    rows.write.option("compression", "gzip").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select("doc_id", F.col("fields")["lang"].alias("lang"), F.col("fields")["source"].alias("source"))


def operation_times(spark, sf_dir):
    """Sums by operation name, ignoring case (the timed scopes of a load test; here: events)."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("operation"), "event_id")
    return rows.groupBy(F.lower("operation").alias("operation")).agg(F.sum("event_id").alias("total"), F.count("*").alias("n"))


def doc_to_json(spark, sf_dir):
    """Indented JSON; no SQL, as white space differs between engines."""
    return to_json(docs(spark, sf_dir))


_CHUNKS = "WITH c AS (SELECT doc_id, lang, source, n, (n // 128) AS chunk_id, n // 128 < count(*) OVER () // 128 AS is_full FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)), t AS (SELECT 'lang' AS field, lang AS term, chunk_id, doc_id FROM c WHERE is_full AND lang IS NOT NULL UNION ALL SELECT 'source', source, chunk_id, doc_id FROM c WHERE is_full AND source IS NOT NULL), i AS (SELECT DISTINCT field, term, chunk_id FROM t) "
_TERMS = ", ".join(f"('{q}', '{f}', '{t}')" for q, f, t in TERMS)

_SQL = {
    search_lang_ci: "SELECT doc_id, lang, source, n_chars FROM documents WHERE upper(lang) = upper('EN')",
    search_missing_term: "SELECT doc_id FROM documents WHERE upper(lang) = upper('no such language')",
    search_unknown_field: "SELECT doc_id FROM documents WHERE false",
    search_customer_segment: "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE upper(c_mktsegment) = upper('Building')",
    search_order_priority: "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE upper(o_orderpriority) = upper('1-urgent')",
    search_event_type: "SELECT event_id, user_id, event_type FROM events WHERE upper(event_type) = upper('PURCHASE')",
    search_text_exact: "SELECT doc_id, n_chars FROM documents WHERE lower(text) = (SELECT lower(text) FROM documents WHERE doc_id = 7)",
    chunk_assignment: _CHUNKS + "SELECT chunk_id, count(*) AS n_docs, min(doc_id) AS first_id, max(doc_id) AS last_id FROM c GROUP BY chunk_id",
    tail_docs: _CHUNKS + "SELECT doc_id, lang, source FROM c WHERE NOT is_full",
    tail_predicate: _CHUNKS + "SELECT doc_id FROM c WHERE NOT is_full AND length(source) > 4",
    chunk_read: _CHUNKS + "SELECT doc_id, lang FROM c WHERE chunk_id = 3",
    doc_field_terms: "SELECT doc_id, 'lang' AS field, lang AS term FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL",
    set_field_value: "SELECT doc_id, 'lang' AS field, 'xx' AS term FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, 'doc', CAST(doc_id AS VARCHAR) FROM documents",
    inverted_index: _CHUNKS + "SELECT field, term, chunk_id FROM i",
    posting_list_ends: _CHUNKS + "SELECT field, term, count(*) AS n_chunks, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM i GROUP BY field, term",
    posting_list_entries: _CHUNKS + "SELECT field, term, chunk_id // 2 AS part, CAST(row_number() OVER (PARTITION BY field, term, chunk_id // 2 ORDER BY chunk_id) - 1 AS INTEGER) AS place, chunk_id FROM i",
    posting_lengths: _CHUNKS + "SELECT field, term, count(*) AS n_chunks FROM i GROUP BY field, term",
    term_counts_per_field: _CHUNKS + "SELECT field, count(DISTINCT term) AS n_terms FROM i GROUP BY field",
    index_fields: _CHUNKS + "SELECT DISTINCT field FROM i",
    indexed_search: "SELECT doc_id FROM documents WHERE upper(source) = 'SRC3'",
    segment_union_dedupe: _CHUNKS + "SELECT DISTINCT chunk_id FROM t WHERE field = 'lang' AND upper(term) = 'EN'",
    index_footer: _CHUNKS + "SELECT field, n, term FROM (SELECT field, term, row_number() OVER (PARTITION BY field ORDER BY term) - 1 AS n, count(*) OVER (PARTITION BY field) AS k FROM (SELECT DISTINCT field, term FROM i)) WHERE n % CAST(floor(sqrt(k)) AS BIGINT) = 0 OR n = k - 1",
    memory_pressure_score: _CHUNKS + "SELECT field, CAST(sum(2 * length(term) + 64 + 64 * n) AS BIGINT) AS score FROM (SELECT field, term, count(*) AS n FROM i GROUP BY field, term) GROUP BY field",
    commit_info: _CHUNKS + "SELECT chunk_id, doc_id FROM c WHERE is_full",
    last_committed_doc: _CHUNKS + "SELECT max(doc_id) AS last_doc_id FROM c WHERE is_full AND chunk_id = (SELECT max(chunk_id) FROM c WHERE is_full)",
    wal_replay_after: f"SELECT doc_id, source FROM documents WHERE doc_id > {AFTER}",
    wal_truncate: f"WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS batch_id FROM documents) SELECT doc_id, batch_id FROM b WHERE batch_id >= (SELECT coalesce(max(batch_id), 0) FROM b WHERE doc_id = {AFTER})",
    batch_ends: "SELECT batch_id, count(*) AS n, arg_min(source, doc_id) AS first_source, arg_max(source, doc_id) AS last_source FROM (SELECT doc_id, source, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS batch_id FROM documents) GROUP BY batch_id",
    next_doc_ids: "SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY n_nationkey) AS doc_id, n_name FROM nation",
    batch_search: f"SELECT q.query_id, d.doc_id FROM (VALUES {_TERMS}) q(query_id, field, term) JOIN (SELECT doc_id, 'lang' AS field, lang AS term FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) d ON d.field = q.field AND upper(d.term) = upper(q.term)",
    load_test_hits: "SELECT q.query_id, count(d.doc_id) AS hits FROM (SELECT CAST(doc_id * 2 AS VARCHAR) AS query_id FROM documents WHERE doc_id % 3 = 0) q LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = q.query_id GROUP BY q.query_id",
    gzip_round_trip: "SELECT doc_id, lang, source FROM documents",
    operation_times: "SELECT lower(event_type) AS operation, CAST(sum(event_id) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1",
    doc_to_json: None,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _SQL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _SQL.items() if sql is not None}
