"""Where intermediate tables go: the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, set[str]] = {}
_tables: dict[str, set[str]] = {}


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local master (tests); a cluster's executors would each write to their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/docmill-checkpoints"
    path = f"{root.rstrip('/')}/docmill/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def new_table(spark: SparkSession, name: str) -> str:
    """A name for an intermediate table."""
    table = f"docmill_{name}_{uuid.uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, set()).add(table)
    return table


def clean(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables and folders.  Results are lazy and read them: call it when they are written."""
    for table in _tables.pop(spark.sparkContext.applicationId, ()):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for root in _made.pop(spark.sparkContext.applicationId, ()):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again: a cut lineage that outlives executors."""
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
