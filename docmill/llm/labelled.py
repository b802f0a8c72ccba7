"""Folds and bounded training samples of labelled documents."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def others(docs: DataFrame, text_col: str) -> Column:
    """All columns but the text, as one struct that goes through Python beside it; ``whole`` puts them together again."""
    return F.struct(F.lit(0).cast("byte").alias("_"), *(named(c) for c in docs.columns if c != text_col))


def named(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole(out: DataFrame, docs: DataFrame, text: str = "text", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` from ``out``'s columns ``text`` and ``row``."""
    return out.select(*(F.col(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def crc_remainder(doc_id: int, folds: int) -> int:
    """``remainder`` of one id; the smallest integer stands for null."""
    return zlib.crc32(b"" if doc_id == -(2**63) else str(doc_id).encode()) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, y, weight, text) of at most ``bound`` labelled ids of either class, those of least hash, where ``learn`` holds.

    ``weight`` makes up for the classes' different sampling rates.  Labels other than 0 and 1 are left out; an id that is
    labelled more than once has its largest label.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(learn)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    parts = [
        rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("weight", F.lit(max(1.0, counts.get(y, 0) / bound)))
        for y in (0, 1)
    ]
    # at most 2 * bound rows of three numbers, so the broadcast is bounded
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(ids, "doc_id").select("doc_id", "y", "weight", "text")


def trained(rows: DataFrame, train: Callable) -> bytes | None:
    """The model that ``train`` makes in one task out of a bounded sample, in the order of a hash; None without rows."""
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    found = rows.mapInArrow(train, "model binary").collect()
    return bytes(found[0]["model"]) if found else None
