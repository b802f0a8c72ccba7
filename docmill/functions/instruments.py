"""Timed scopes with a writer that can be put in.

``timed("wal_commit")`` around a piece of work tells the session's writer how long it took.  Without a writer nothing is kept.
What Spark runs lazily is counted instead, by ``counted``: its rows, as they pass in whatever query runs them.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# The operations of a store that are timed.
GREP_FILTER = "grep_filter"
ADD_TERM = "add_term_to_in_memory_ix"
COMMIT_INDEX = "commit_index_file"
SEARCH_INDEX = "search_index_file"
LOG_COMMIT = "wal_commit"
LOG_TRUNCATE = "wal_truncate"
DATA_COMMIT = "datafile_commit"


class Writer(Protocol):
    def write(self, operation: str, nanoseconds: int) -> None: ...


class Aggregating:
    """Adds up calls and times by operation, whose names may differ in case; threads may share it."""

    def __init__(self):
        self._sums: dict[str, list[int]] = {}
        self._rows: list[tuple[str, Observation]] = []
        self._lock = threading.Lock()

    def write(self, operation: str, nanoseconds: int) -> None:
        with self._lock:
            own = self._sums.setdefault(operation.lower(), [0, 0])
            own[0] += 1
            own[1] += nanoseconds

    def watch(self, operation: str, observation: Observation) -> None:
        with self._lock:
            self._rows.append((operation.lower(), observation))

    def sums(self) -> dict[str, tuple[int, int]]:
        """(calls, nanoseconds) of each operation."""
        with self._lock:
            return {k: (n, t) for k, (n, t) in sorted(self._sums.items())}

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, n, t) for k, (n, t) in self.sums().items()]
        return spark.createDataFrame(rows, "operation string, calls long, nanoseconds long")

    def rows(self) -> dict[str, int]:
        """Rows that passed the counted steps; waits for the queries that run them."""
        out: dict[str, int] = {}
        for operation, observation in self._rows:
            out[operation] = out.get(operation, 0) + observation.get["rows"]
        return out

    def text(self) -> str:
        return "\n".join(f"{k}: {t / 1e6:.1f} ms in {n} calls" for k, (n, t) in self.sums().items())


_writer: Writer | None = None


def use(writer: Writer | None) -> None:
    """Puts in the writer of this process; None takes it out."""
    global _writer
    _writer = writer


@contextmanager
def timed(operation: str) -> Iterator[None]:
    began = time.perf_counter_ns()
    try:
        yield
    finally:
        if _writer is not None:
            _writer.write(operation, time.perf_counter_ns() - began)


def counted(df: DataFrame, operation: str) -> DataFrame:
    """``df``, whose rows are counted for the writer if it watches."""
    watch = getattr(_writer, "watch", None)
    if watch is None:
        return df
    observation = Observation()
    watch(operation, observation)
    return df.observe(observation, F.count(F.lit(1)).alias("rows"))
