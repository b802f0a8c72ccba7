"""A document store on Parquet folders: a log of batches, chunked data, and a postings index.

Layout below ``root``:

    log/batch=NAME/                     documents of one accepted batch (doc_id, fields)
    accepted/batch=NAME                 names of batches that the log no longer holds
    data/segment=N/                     documents of full chunks (chunk_id, doc_id, fields)
    postings/segment=N/field=NAME/      the segment's index (term_key, term, chunk_id), sorted by term_key
    writer                              is there while a writer is at work

A batch is accepted when its folder is committed, and searches see it from then on: what is not in ``data`` yet is the tail, and
is scanned.  ``commit`` moves the tail's full chunks into a new segment, postings first: a failure between the two leaves
postings without data, which searches don't mind and the next commit overwrites.  A second writer at the same time is refused
(``StoreLocked``); readers need no lock, as folders appear whole.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import instruments
from docmill.functions.instruments import counted, timed
from docmill.functions.numbering import numbered
from docmill.functions.storage import partitions
from docmill.operators import index, search
from docmill.operators.documents import present

#: Bytes from which on a checkpoint truncates the log.
LOG_BYTES = 10 << 20
#: The folder of the empty field name, by Spark's rule.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
#: A writer that is older has died.
LOCK_SECONDS = 3600


class StoreLocked(RuntimeError):
    """Another writer is at work."""


DOCUMENT = "doc_id long, fields map<string,string>"


class DocumentStore:
    def __init__(self, spark: SparkSession, root: str):
        """Opens a store; one that doesn't exist is empty.  Reading has no side effects."""
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _folders(self, name: str, key: str) -> list[str]:
        fs, path = self._path(name)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n.partition("=")[2] for n in names if n.startswith(f"{key}=") and fs.exists(self._path(f"{name}/{n}/_SUCCESS")[1]))

    def _read(self, name: str, key: str, schema: str, folders: list[str] | None = None) -> DataFrame:
        folders = self._folders(name, key) if folders is None else folders
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*(f"{self.root}/{name}/{key}={f}" for f in folders))

    def log(self) -> DataFrame:
        return self._read("log", "batch", DOCUMENT + ", batch string")

    def data(self) -> DataFrame:
        return self._read("data", "segment", "chunk_id long, " + DOCUMENT)

    def postings(self) -> DataFrame:
        """Postings of the segments whose data is there."""
        return self._read("postings", "segment", "term_key string, term string, chunk_id long, field string", self._folders("data", "segment"))

    def fields(self) -> list[str]:
        """Names of indexed fields, by the folders of the segments; no file is read."""
        found, unescape = set(), self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        for segment in self._folders("data", "segment"):
            fs, path = self._path(f"postings/segment={segment}")
            names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
            found |= {unescape(n.partition("=")[2]) for n in names if n.startswith("field=")}
        return sorted("" if f == NO_NAME else f for f in found)

    def last_id(self) -> int:
        return max(index.last_number(self.log(), "doc_id"), index.last_number(self.data(), "doc_id"))

    def tail(self) -> DataFrame:
        """Accepted documents that are in no chunk."""
        return self.log().where(F.col("doc_id") > index.last_number(self.data(), "doc_id")).select("doc_id", "fields")

    def replay_after(self, doc_id: int) -> DataFrame:
        return self.log().where(F.col("doc_id") > doc_id).select("doc_id", "fields")

    @contextmanager
    def _writing(self) -> Iterator[None]:
        fs, path = self._path("writer")
        if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > LOCK_SECONDS:
            fs.delete(path, False)
        fs.mkdirs(path.getParent())
        if not _created(fs, path):
            raise StoreLocked(f"{self.root} has a writer")
        try:
            yield
        finally:
            fs.delete(path, False)

    def _accepted(self, name: str) -> bool:
        fs, path = self._path(f"accepted/batch={name}")
        return fs.exists(path) or name in self._folders("log", "batch")

    def add(self, fields: DataFrame, batch: str | None = None) -> str:
        """Accepts the maps in column ``fields`` as one batch, with the next ids.  A batch that was accepted isn't added again."""
        name = batch or uuid.uuid4().hex
        with self._writing(), timed(instruments.LOG_COMMIT):
            if not self._accepted(name):
                rows = numbered(fields.select(present(F.col("fields")).alias("fields")), "doc_id", start=self.last_id() + 1)
                rows.select("doc_id", "fields").write.mode("overwrite").option("compression", "gzip").parquet(f"{self.root}/log/batch={name}")
        return name

    def commit(self) -> int:
        """Moves the tail's full chunks into a new segment; the number of chunks moved."""
        with self._writing():
            with timed(instruments.ADD_TERM):
                first = self.data().agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0))).first()[0]
                rows = index.chunked(self.tail(), first=first).where("full").drop("full")
                chunks = rows.select("chunk_id").distinct().count()
            if chunks:
                segment = f"{self.next_segment():08d}"
                with timed(instruments.COMMIT_INDEX):
                    found = index.postings(rows).repartition(partitions(self.spark), "field", "term_key").sortWithinPartitions("field", "term_key")
                    found.write.mode("overwrite").partitionBy("field").parquet(f"{self.root}/postings/segment={segment}")
                with timed(instruments.DATA_COMMIT):
                    rows.select("chunk_id", "doc_id", "fields").sortWithinPartitions("chunk_id").write.mode("overwrite").option("compression", "gzip").parquet(f"{self.root}/data/segment={segment}")
        return chunks

    def next_segment(self) -> int:
        return max(map(int, self._folders("data", "segment")), default=0) + 1

    def truncate(self) -> list[str]:
        """Drops the log's batches that are wholly in chunks; their names, which stay known.  The last batch stays."""
        with self._writing(), timed(instruments.LOG_TRUNCATE):
            done, last = index.last_number(self.data(), "doc_id"), self.last_id()
            ends = self.log().groupBy("batch").agg(F.max("doc_id").alias("last")).where((F.col("last") <= done) & (F.col("last") < last)).collect()
            for r in ends:
                fs, mark = self._path(f"accepted/batch={r['batch']}")
                fs.mkdirs(mark.getParent())
                _created(fs, mark)
                fs.delete(self._path(f"log/batch={r['batch']}")[1], True)
        return sorted(r["batch"] for r in ends)

    def checkpoint(self, least: int = LOG_BYTES) -> list[str]:
        """Truncates a log of ``least`` bytes or more."""
        fs, path = self._path("log")
        return self.truncate() if fs.exists(path) and fs.getContentSummary(path).getLength() >= least else []

    def chunk(self, chunk_id: int) -> DataFrame:
        return self.data().where(F.col("chunk_id") == chunk_id).select("doc_id", "fields")

    def candidates(self, field: str, term: str) -> DataFrame:
        """Chunks that the index names, for an equality on folder and sorted key."""
        return index.candidates(self.postings(), field, term)

    def search(self, field: str, term: str) -> DataFrame:
        with timed(instruments.SEARCH_INDEX):
            # the empty name has no folder that could be looked up
            found = search.scan(self.data().select("doc_id", "fields").unionByName(self.tail()), field, term) if field == "" else search.indexed(self.data(), self.postings(), self.tail(), field, term)
        return counted(found, instruments.GREP_FILTER)

    def hits(self, field: str, term: str) -> int:
        """The number of matches, in a timed scope of its own."""
        found = self.search(field, term)
        with timed(instruments.GREP_FILTER):
            return found.count()

    def search_tail(self, predicate) -> DataFrame:
        return self.tail().where(predicate)


def _created(fs, path) -> bool:
    """Makes an empty file unless it is there: one of several that try succeeds."""
    try:
        return bool(fs.createNewFile(path))
    except Exception:  # some file systems raise where the file is there
        if fs.exists(path):
            return False
        raise
