"""Made-up documents for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.documents import documents


def generated(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``n`` documents: an id from 1 on, two fields of few values, and a third that every other document lacks."""
    rows = spark.range(1, n + 1).select(
        F.col("id").alias("doc_id"), F.col("id"), F.concat(F.lit("value "), F.floor(F.rand(seed) * 100).cast("string")).alias("field1"), F.floor(F.rand(seed + 1) * 10).alias("field2"), F.when(F.rand(seed + 2) < 0.5, F.lit("sometimes")).alias("field3")
    )
    return documents(rows, "doc_id", "id", "field1", "field2", "field3")
