"""Chunks, posting lists and what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.folding import fold
from docmill.functions.numbering import numbered
from docmill.operators.documents import field_terms

#: Documents of a chunk, the unit that postings point to.
CHUNK = 128


def chunked(docs: DataFrame, *order: str, first: int = 0, size: int = CHUNK) -> DataFrame:
    """Documents with ``chunk_id`` (consecutive, ``size`` documents each) and ``full`` (false for the rest at the end)."""
    rows = numbered(docs, "n", *(order or ("doc_id",)), start=0)
    last = rows.agg(F.coalesce(F.max("n"), F.lit(-1))).first()[0]
    whole = (last + 1) // size
    chunk = F.floor(F.col("n") / size)
    return rows.select(*docs.columns, (chunk + first).cast("long").alias("chunk_id"), (chunk < whole).alias("full"))


def postings(chunks: DataFrame) -> DataFrame:
    """The inverted index: distinct (field, term_key, term, chunk_id).  One exchange; hot terms shrink before it."""
    return field_terms(chunks, "chunk_id").select("field", fold(F.col("term")).alias("term_key"), "term", "chunk_id").distinct()


#: Chunk numbers that one posting list spans, so that the list of a common term is many rows of bounded size.
SPAN = 1 << 16


def posting_lists(index: DataFrame, span: int = SPAN) -> DataFrame:
    """(field, term, part, postings): the ascending chunks of each term, a row for each ``span`` of chunk numbers."""
    part = F.floor(F.col("chunk_id") / span).cast("long").alias("part")
    return index.groupBy("field", "term", part).agg(F.sort_array(F.collect_set("chunk_id")).alias("postings"))


def posting_ends(index: DataFrame) -> DataFrame:
    """(field, term, n_chunks, first_chunk, last_chunk) without the lists."""
    return index.select("field", "term", "chunk_id").distinct().groupBy("field", "term").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


def posting_lengths(index: DataFrame) -> DataFrame:
    return index.groupBy("field", "term").agg(F.countDistinct("chunk_id").alias("n_chunks"))


def term_counts(index: DataFrame) -> DataFrame:
    return index.select("field", "term").distinct().groupBy("field").agg(F.count("*").alias("n_terms"))


def candidates(index: DataFrame, field: str, term: str) -> DataFrame:
    """Chunks that may hold a match: partition pruning by field, then equality on the folded key."""
    return index.where((F.col("field") == field) & (F.col("term_key") == fold(F.lit(term)))).select("chunk_id").distinct()


def footer(index: DataFrame) -> DataFrame:
    """(field, n, term): of each field's sorted terms every floor(sqrt(count))-th, and the last."""
    terms = index.select("field", "term").distinct()
    counts = terms.groupBy("field").agg(F.count("*").alias("terms"))
    rows = numbered(terms, "n", "field", "term", start=0)
    first = rows.groupBy("field").agg(F.min("n").alias("first"))
    rows = rows.join(first.join(counts, "field"), "field").select("field", (F.col("n") - F.col("first")).alias("n"), "term", "terms")
    return rows.where("n % cast(floor(sqrt(terms)) as bigint) = 0 or n = terms - 1").select("field", "n", "term")


def memory_score(index: DataFrame) -> DataFrame:
    """What an index in memory would weigh: 64 and twice its length for a term, 64 for a posting."""
    terms = index.groupBy("field", "term").agg(F.countDistinct("chunk_id").alias("n"))
    return terms.groupBy("field").agg(F.sum(2 * F.length("term") + 64 + 64 * F.col("n")).cast("long").alias("score"))


def chunk_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def last_committed(chunks: DataFrame) -> DataFrame:
    """The largest id in the chunk of the highest number."""
    return chunks.where("full").groupBy("chunk_id").agg(F.max("doc_id").alias("last_id")).agg(F.max_by("last_id", "chunk_id").alias("last_doc_id"))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Rows in batches of ``size`` by ``order``; the last may be short.  First and last of each batch by ``min_by``/``max_by``."""
    return numbered(df, "n", order, start=0).withColumn("batch_id", F.floor(F.col("n") / size).cast("long")).drop("n")


def next_numbers(known: DataFrame, column: str, new: DataFrame, *order: str) -> DataFrame:
    """``new`` with ids that go on from the largest one of ``known`` (from 1 if it has none)."""
    return numbered(new, column, *order, start=last_number(known, column) + 1)


def last_number(known: DataFrame, column: str) -> int:
    return known.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
