"""Search: the whole value of a field equals a term, ignoring case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.folding import fold
from docmill.operators.documents import field_terms
from docmill.operators.index import candidates

#: So many candidate chunks go to all tasks at most; beyond, both sides of the semi-join are shuffled.
BROADCAST_CHUNKS = 100_000


def equals(value: Column, term: str) -> Column:
    """The match predicate on one value; null never matches.  Folding keeps lengths, so most long values need none."""
    return (F.length(value) == F.length(F.lit(term))) & (fold(value) == fold(F.lit(term)))


def matches(field: str, term: str) -> Column:
    """The match predicate on a document; a missing field never matches."""
    return F.coalesce(equals(F.col("fields")[field], term), F.lit(False))


def scan(docs: DataFrame, field: str, term: str) -> DataFrame:
    return docs.where(matches(field, term))


def scan_column(df: DataFrame, column: str, term: str) -> DataFrame:
    """The same over a physical column, which keeps the scan columnar."""
    return df.where(equals(F.col(column), term))


def indexed(data: DataFrame, index: DataFrame, tail: DataFrame, field: str, term: str) -> DataFrame:
    """Index, candidate chunks, recheck (a posting says only that some document of the chunk matches), and the matching tail."""
    found = candidates(index, field, term)
    side = F.broadcast(found) if found.limit(BROADCAST_CHUNKS + 1).count() <= BROADCAST_CHUNKS else found
    hits = data.join(side, "chunk_id", "left_semi")
    return scan(hits, field, term).select("doc_id", "fields").unionByName(scan(tail, field, term).select("doc_id", "fields"))


def batch(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Many searches at once: ``queries`` has (query_id, field, term).  An equality join on field and folded term."""
    asked = queries.select("query_id", "field", fold(F.col("term")).alias("term_key"))
    return field_terms(docs).select("doc_id", "field", fold(F.col("term")).alias("term_key")).join(asked, ["field", "term_key"]).select("query_id", "doc_id")


def hit_counts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of each query, 0 for a miss; more than one is a duplicate."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
