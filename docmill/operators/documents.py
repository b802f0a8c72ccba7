"""The document model: a row of (doc_id, fields), where fields maps names to strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def documents(df: DataFrame, id_col: str, *fields: str) -> DataFrame:
    """Documents out of a table's columns.  A null value is no field; all values become strings."""
    pairs = [x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]
    return df.select(F.col(id_col).cast("long").alias("doc_id"), present(F.create_map(*pairs)).alias("fields"))


def present(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: v.isNotNull())


def set_field(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """Puts one field into each document, in place of one of that name."""
    others = F.map_filter("fields", lambda k, v: k != name)
    return docs.withColumn("fields", present(F.map_concat(others, F.create_map(F.lit(name), value.cast("string")))))


def to_json(docs: DataFrame, pretty: bool = True) -> DataFrame:
    """(doc_id, json) with the fields under ``Fields``, indented or without white space."""
    return docs.select("doc_id", F.to_json(F.struct(F.col("fields").alias("Fields")), {"pretty": str(pretty).lower()}).alias("json"))


def field_terms(docs: DataFrame, *more: str) -> DataFrame:
    """A row for each field of each document; the whole value is the one term."""
    return docs.select("doc_id", *more, F.explode("fields").alias("field", "term"))
