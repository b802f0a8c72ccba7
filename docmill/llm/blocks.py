"""Text blocks and the block exchange, for statistics over all windows or words of a corpus.

Documents are packed into compressed *blocks* of about one megabyte, stored in a table that is bucketed by block, so that every
pass reads a block where it lies.  A pass sends, for each block and hash bucket, one row with the block's distinct keys of that
bucket (sorted and delta-coded, with their values).  A bucket's task merges those rows and answers each with one value for each
key; the answers return to their blocks.  A key counts once a block however often the block holds it, so no key is hot, and
what moves is a few bytes for each distinct key of a block.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.storage import new_table, partitions, shared_root, tidy
from docmill.llm.textkernel import row_chunks, utf8

BLOCK_BYTES = 1 << 20
#: Bytes of text for each hash bucket, so that what a bucket's task holds does not grow with the corpus.
BUCKET_BYTES = 64 << 20
#: Bytes of text for each file of an intermediate table, at least.
TASK_BYTES = 8 << 20
BLOCK_SCHEMA = "block long, size long, payload binary"
SUMMARY = -1
BLOB_SCHEMA = "kind int, bucket int, block long, payload binary"


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    """The rows of a block: ``doc_id`` (the smallest integer for null) ``text`` and what goes along, ordered by the first two."""
    return pa.ipc.open_stream(payload).read_next_batch()


class Blocks:
    """The bucketed table of a corpus' blocks."""

    def __init__(self, docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None):
        """``carry``: a column that goes along with each row, as ``row``."""
        spark = self.spark = docs.sparkSession
        self.root, self.table = shared_root(spark, name), new_table(spark, name)
        tables = partitions(spark)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([] if carry is None else [carry.alias("row")]))
        (
            rows.mapInArrow(tidy(_to_blocks), BLOCK_SCHEMA)
            .write.format("parquet")
            .option("compression", "uncompressed")
            .bucketBy(tables, "block")
            .option("path", f"{self.root}/blocks")
            .saveAsTable(self.table)
        )
        total = spark.table(self.table).agg(F.sum("size")).first()[0] or 0
        self.buckets = max(tables, -(-total // BUCKET_BYTES))
        self.tasks = max(4 * spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def read(self) -> DataFrame:
        return self.spark.table(self.table).select("block", "payload")

    def few(self, rows: DataFrame) -> DataFrame:
        """Rows to be written, in no more tasks than the corpus' bytes and the cores ask for: small corpora don't become many small files."""
        return rows.coalesce(self.tasks)

    def send(self, blobs) -> DataFrame:
        """One pass: ``blobs(block, payload)`` yields (kind, bucket, payload) rows."""

        def run(batches):
            for batch in batches:
                for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                    rows = [(k, b, block, p) for k, b, p in blobs(block, payload.as_buffer())]
                    for i in range(0, len(rows), 256):
                        part = rows[i : i + 256]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.binary())],
                            names=["kind", "bucket", "block", "payload"],
                        )

        return self.read().mapInArrow(tidy(run), BLOB_SCHEMA)

    def with_answers(self, *answers: DataFrame) -> DataFrame:
        """The blocks, each with the list of its answers (at most one for each kind and bucket)."""
        every = answers[0]
        for more in answers[1:]:
            every = every.unionByName(more)
        lists = every.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "payload")).alias("answers"))
        return self.read().join(lists, "block", "left")


def answered(blobs: DataFrame, answer, buckets: int) -> DataFrame:
    """``answer(kind, payloads)`` gives one payload for each payload of a (kind, bucket), in the order of their blocks.

    It may give a pair, of these and of a summary of the bucket, which comes as a row of the block ``SUMMARY``.  Buckets are dealt out in
    turn, so that a task has one of each kind, and holds one at a time.
    """

    def answers(key: tuple[int, int], blocks: list[int], payloads: list[bytes]) -> pa.RecordBatch:
        out = answer(key[0], payloads)
        if isinstance(out, tuple):
            out, blocks = [*out[0], out[1]], [*blocks, SUMMARY]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(out), pa.int32()), pa.array([key[1]] * len(out), pa.int32()), pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], names=["kind", "bucket", "block", "payload"])

    def run(batches):
        own, blocks, payloads = None, [], []
        for batch in batches:
            for kind, bucket, block, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if (kind, bucket) != own:
                    if payloads:
                        yield answers(own, blocks, payloads)
                    own, blocks, payloads = (kind, bucket), [], []
                blocks.append(block)
                payloads.append(payload)
        if payloads:
            yield answers(own, blocks, payloads)

    # kinds start at different tasks
    turn = F.pmod(F.col("bucket") + F.col("kind") * (buckets // 3 + 1), F.lit(buckets))
    return blobs.select("kind", "bucket", "block", "payload").repartitionById(buckets, turn).sortWithinPartitions("kind", "bucket", "block").mapInArrow(tidy(run), BLOB_SCHEMA)


def _to_blocks(batches):
    seq, base = 0, TaskContext.get().partitionId() << 32
    kept: list[pa.RecordBatch] = []
    size = 0

    def block():
        table = pa.Table.from_batches(kept).combine_chunks()
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([size], pa.int64()), pa.array([_pack(table.to_batches()[0])], pa.binary())], names=["block", "size", "payload"])

    for batch in batches:
        ids = batch.column("doc_id").fill_null(-(2**63))
        text = batch.column("text").fill_null("").cast(pa.large_string())
        batch = pa.RecordBatch.from_arrays([ids, text, *batch.columns[2:]], names=batch.schema.names)
        _, offsets = utf8(text)
        for a, b in row_chunks(offsets, BLOCK_BYTES // 2):
            n = int(offsets[b] - offsets[a])
            if kept and size + n > BLOCK_BYTES:
                yield block()
                kept, size, seq = [], 0, seq + 1
            kept.append(batch.slice(a, b - a))
            size += n
    if kept:
        yield block()


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key, which rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _planes(column: np.ndarray) -> bytes:
    """A column's bytes, first all lowest ones, then all second ones, ...: high bytes that are alike compress away."""
    return column.view(np.uint8).reshape(len(column), column.dtype.itemsize).T.tobytes()


def _unplanes(raw: bytes, dtype, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(dtype)


def encode(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted 64-bit keys and any columns beside them."""
    n = len(keys)
    delta = np.diff(keys, prepend=np.uint64(0))
    raw = b"".join([_planes(np.ascontiguousarray(delta)), *(_planes(np.ascontiguousarray(v)) for v in values)])
    return struct.pack("<I", n) + zstandard.ZstdCompressor(level=1).compress(raw)


def decode(blob, *dtypes) -> tuple[np.ndarray, ...]:
    n = struct.unpack_from("<I", blob)[0]
    raw = zstandard.ZstdDecompressor().decompress(bytes(blob)[4:])
    out, at = [], 0
    for dtype in ("<u8", *dtypes):
        width = np.dtype(dtype).itemsize * n
        out.append(_unplanes(raw[at : at + width], dtype, n))
        at += width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return tuple(out)


def encode_answer(values: np.ndarray) -> bytes:
    return struct.pack("<I", len(values)) + zstandard.ZstdCompressor(level=1).compress(_planes(np.ascontiguousarray(values)))


def decode_answer(blob, dtype) -> np.ndarray:
    n = struct.unpack_from("<I", blob)[0]
    return _unplanes(zstandard.ZstdDecompressor().decompress(bytes(blob)[4:]), dtype, n)


def split(kind: int, buckets: int, keys: np.ndarray, *values: np.ndarray):
    """(kind, bucket, payload) for each bucket that has some of the sorted keys."""
    bounds = np.searchsorted(buckets_of(keys, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[b], bounds[b + 1])
        yield kind, int(b), encode(keys[part], *(v[part] for v in values))


def answer_of(answers, kind: int, dtype) -> np.ndarray:
    """A block's answers of one kind in the order of its sorted keys."""
    parts = sorted((a["bucket"], a["payload"]) for a in answers or () if a["kind"] == kind)
    return np.concatenate([decode_answer(p, dtype) for _, p in parts]) if parts else np.empty(0, dtype)
