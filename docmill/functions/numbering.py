"""Dense numbers for the rows of a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.storage import partitions, shared_root, stored


def numbered(df: DataFrame, column: str, *order: str, start: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in ``column``, by ``order`` or else as its rows stand.

    Rows are ranged over partitions and numbered inside each; the rows before a partition are the sum of the partitions' counts
    before it, one number for each partition.  No task sees more than its own range.
    """
    spark = df.sparkSession
    if order:
        df = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = stored(df.withColumn(column, F.monotonically_increasing_id()), shared_root(spark, "numbered"))
    part, place = F.shiftright(column, 33), F.col(column).bitwiseAND(F.lit((1 << 33) - 1))
    before, total = {}, 0
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        before[r["part"]] = total
        total += r["count"]
    base = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.lit(None)
    return rows.withColumn(column, (base[part] if before else F.lit(0)) + place + start)
