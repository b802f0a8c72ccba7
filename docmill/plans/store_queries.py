"""Queries over a store on disk, each with the SQL that gives the same rows.

The store holds the table of documents, by ascending id, in three batches (``CUTS``).  Ids of the store are numbers from 1 on in
that order; the table's own id is a field.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import instruments
from docmill.functions.storage import shared_root
from docmill.operators import index
from docmill.operators.documents import documents, to_json
from docmill.sources.store import DocumentStore

CUTS = (300, 700)
AFTER = 500


def batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bounds = [None, *CUTS, None]
    out = []
    for low, high in zip(bounds, bounds[1:]):
        own = rows.where(F.lit(True) if low is None else F.col("doc_id") >= low).where(F.lit(True) if high is None else F.col("doc_id") < high)
        own = own.orderBy("doc_id").withColumn("id", F.col("doc_id"))
        out.append(documents(own, "doc_id", "id", "lang", "source").select("fields"))
    return out


def filled(spark: SparkSession, sf_dir: str, commits: tuple[int, ...] = (0, 1)) -> DocumentStore:
    """A new store with the three batches; after those in ``commits``, full chunks move into a segment."""
    store = DocumentStore(spark, shared_root(spark, "store"))
    for k, rows in enumerate(batches(spark, sf_dir)):
        store.add(rows, f"part-{k}")
        if k in commits:
            store.commit()
    return store


def own_ids(found: DataFrame) -> DataFrame:
    return found.select(F.col("fields")["id"].cast("long").alias("id"))


def store_search(spark, sf_dir):
    """Through two segments' postings and the tail of what is not in chunks yet."""
    return own_ids(filled(spark, sf_dir).search("source", "SRC3"))


def store_reopen(spark, sf_dir):
    """All batches accepted, none in chunks; a store opened anew commits and searches."""
    root = filled(spark, sf_dir, ()).root
    DocumentStore(spark, root).commit()
    return own_ids(DocumentStore(spark, root).search("lang", "En"))


def store_recover(spark, sf_dir):
    """A commit that failed between postings and data, then a restart: ids go on, nothing is lost or found twice."""
    store = filled(spark, sf_dir, ())
    rows = index.chunked(store.tail()).where("full")
    index.postings(rows).write.partitionBy("field").parquet(f"{store.root}/postings/segment=00000001")
    again = DocumentStore(spark, store.root)
    before = again.last_id()
    again.commit()
    found = again.search("source", "src7").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))
    return found.select("hits", "docs", F.lit(before).cast("long").alias("last_id"), F.lit(again.next_segment()).cast("long").alias("next_segment"))


def store_segments(spark, sf_dir):
    """Segments with their chunks and the store's ids."""
    data = filled(spark, sf_dir).data().select("chunk_id", "doc_id", F.element_at(F.split(F.input_file_name(), "segment="), 2).substr(1, 8).cast("long").alias("segment"))
    return data.groupBy("segment").agg(F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def store_candidates(spark, sf_dir):
    """Chunks of one term over all segments, each once."""
    return filled(spark, sf_dir).candidates("lang", "DE")


def store_fields(spark, sf_dir):
    return spark.createDataFrame([(f,) for f in filled(spark, sf_dir).fields()], "field string")


def store_chunk(spark, sf_dir):
    """One chunk by its number, out of the second segment."""
    return own_ids(filled(spark, sf_dir).chunk(3))


def store_tail(spark, sf_dir):
    """Any predicate over what is not in chunks yet."""
    return own_ids(filled(spark, sf_dir).search_tail(F.length(F.col("fields")["source"]) > 4))


def store_replay(spark, sf_dir):
    """The log after an id of the store."""
    return filled(spark, sf_dir).replay_after(AFTER).select("doc_id", F.col("fields")["id"].cast("long").alias("id"))


def store_truncate(spark, sf_dir):
    """A log that is small stays at a checkpoint; truncated, it drops the batches that are wholly in chunks.  A batch that was dropped
    is not accepted again."""
    store = filled(spark, sf_dir, (1, 2))
    first, _, _ = batches(spark, sf_dir)
    dropped = [*store.checkpoint(), *store.truncate()]
    store.add(first, "part-0")
    left = store.log().groupBy("batch").agg(F.count("*").alias("n_docs"))
    return left.withColumn("n_dropped", F.lit(len(dropped)).cast("long"))


def store_operations(spark, sf_dir):
    """Calls of the timed operations while a store is filled, searched and truncated."""
    writer = instruments.Aggregating()
    instruments.use(writer)
    try:
        store = filled(spark, sf_dir)
        store.hits("lang", "en")
        store.truncate()
    finally:
        instruments.use(None)
    return writer.frame(spark).where("nanoseconds > 0").select("operation", "calls")


def store_timed_rows(spark, sf_dir):
    """Rows that passed the filter of a search, counted as it runs."""
    writer = instruments.Aggregating()
    instruments.use(writer)
    try:
        filled(spark, sf_dir).hits("source", "src1")
    finally:
        instruments.use(None)
    return spark.createDataFrame(list(writer.rows().items()), "operation string, n long")


def doc_json(spark, sf_dir):
    """JSON without white space."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return to_json(documents(rows, "doc_id", "lang", "source"), pretty=False)


_NUMBERED = f"WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS id FROM documents), b AS (SELECT *, CASE WHEN doc_id < {CUTS[0]} THEN 0 WHEN doc_id < {CUTS[1]} THEN 1 ELSE 2 END AS batch FROM d), c AS (SELECT *, (id - 1) // 128 AS chunk FROM b), e AS (SELECT count(*) FILTER (batch = 0) // 128 AS one, count(*) FILTER (batch <= 1) // 128 AS two, count(*) // 128 AS three FROM b) "

_SQL = {
    store_search: "SELECT doc_id AS id FROM documents WHERE upper(source) = 'SRC3'",
    store_reopen: "SELECT doc_id AS id FROM documents WHERE upper(lang) = 'EN'",
    store_recover: "SELECT count(*) FILTER (upper(source) = 'SRC7') AS hits, count(*) FILTER (upper(source) = 'SRC7') AS docs, count(*) AS last_id, CAST(CASE WHEN count(*) >= 128 THEN 2 ELSE 1 END AS BIGINT) AS next_segment FROM documents",
    store_segments: _NUMBERED + "SELECT CAST(CASE WHEN chunk < one THEN 1 WHEN one > 0 THEN 2 ELSE 1 END AS BIGINT) AS segment, min(chunk) AS first_chunk, max(chunk) AS last_chunk, count(*) AS n_docs, min(id) AS first_id, max(id) AS last_id FROM c, e WHERE chunk < two GROUP BY 1",
    store_candidates: _NUMBERED + "SELECT DISTINCT chunk AS chunk_id FROM c, e WHERE chunk < two AND upper(lang) = 'DE'",
    store_fields: "SELECT unnest(['id', 'lang', 'source']) AS field",
    store_chunk: _NUMBERED + "SELECT doc_id AS id FROM c, e WHERE chunk = 3 AND chunk < two",
    store_tail: _NUMBERED + "SELECT doc_id AS id FROM c, e WHERE chunk >= two AND length(source) > 4",
    store_replay: f"SELECT id AS doc_id, doc_id AS id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS id FROM documents) WHERE id > {AFTER}",
    store_truncate: _NUMBERED + ", k AS (SELECT batch, count(*) AS n_docs, max(id) <= any_value(three) * 128 AND max(id) < (SELECT max(id) FROM b) AS gone FROM b, e GROUP BY batch) SELECT 'part-' || batch AS batch, n_docs, (SELECT count(*) FROM k WHERE gone) AS n_dropped FROM k WHERE NOT gone",
    store_operations: _NUMBERED + ", k AS (SELECT CAST(one > 0 AS BIGINT) + CAST(two > one AS BIGINT) AS k FROM e) SELECT operation, CAST(calls AS BIGINT) AS calls FROM (SELECT unnest(['add_term_to_in_memory_ix', 'commit_index_file', 'datafile_commit', 'grep_filter', 'search_index_file', 'wal_commit', 'wal_truncate']) AS operation, unnest([2, k, k, 1, 1, 3, 1]) AS calls FROM k) WHERE calls > 0",
    store_timed_rows: "SELECT 'grep_filter' AS operation, count(*) AS n FROM documents WHERE upper(source) = 'SRC1'",
    doc_json: """SELECT doc_id, '{"Fields":{' || concat_ws(',', '"lang":' || to_json(lang), '"source":' || to_json(source)) || '}}' AS json FROM documents""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _SQL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _SQL.items()}
