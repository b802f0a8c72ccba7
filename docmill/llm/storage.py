"""What the operators' tasks and intermediate tables need besides ``docmill.functions.storage``."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from docmill.functions.storage import new_table, partitions, shared_root, stored

__all__ = ["new_table", "partitions", "shared_root", "spread", "stored", "tidy"]

#: A table of fewer bytes may lie in one file that Spark cannot split, and costs little to deal out.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table over all cores; a large one as it lies."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def tidy(run: Callable) -> Callable:
    """``run(batches)`` for a task, after which the worker, which Spark keeps for other tasks, gives its free memory back."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return task
