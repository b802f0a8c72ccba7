"""Token ids as word-aligned binary files (operator 2).

Texts are encoded with a vocabulary of the tokenizers library, one end id is put after each document, and the ids are written in
ascending order of doc_id, as Simple-8b words (``docmill.llm.simple8b``).  The file format is Parquet with one row for each group
of whole documents of about two megabytes of text:

    shard, seq          place of the group in the order of doc_id
    shard_start         ids of the shard before the group
    doc_ids, lengths    the documents of the group and their ids' numbers
    ranks               ids of the group by falling frequency; the coded integers are places in this list
    offsets, words      the Simple-8b blocks and their words

A vocabulary that never joins text across white space and some other places (``parts_words`` looks at its rules) lets a worker encode
each distinct piece once; any other vocabulary is given whole texts.  Shards are the ranges of one range partitioning; the ids before a shard are the sum of the shards before, of which there are as many as partitions.

Defined cases: null and empty texts have the end id alone; a text of any length is encoded whole, in a group of its own if it is
longer than one; rows with equal ids stand in the order of their texts, a null id before
all others; special tokens' strings in a text become special ids, as the library does by default; no documents give no rows; other
columns are not looked at.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import simple8b
from docmill.llm.storage import partitions, shared_root
from docmill.llm.textkernel import text_chunks, word_spans
from docmill.llm.wordcache import WordCache

SCHEMA = "shard int, seq int, shard_start long, n_ids long, doc_ids array<long>, lengths array<long>, ranks binary, offsets binary, words binary"
#: Pieces that a worker remembers, and bytes of texts that it encodes together.
PIECES, GROUP_BYTES = 1_000_000, 2 << 20
_encoders: dict[int, Encoder] = {}


#: How the vocabulary must treat texts for its pieces to be told by ``pieces_of``: fixed values of its file.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_words(vocabulary: str) -> bool:
    """Whether a vocabulary takes upper for lower case and never joins text where ``pieces_of`` cuts."""
    own = json.loads(vocabulary)
    first = ((own.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and t["content"][:2] == "<|" for t in own.get("added_tokens") or ())
    return plain and (own.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and first.get("pattern") == {"Regex": _PATTERN} and first.get("behavior") == "Removed"


class Encoder:
    """``ids(data, offsets, end)``: the ids of UTF-8 texts, with ``end`` after each, and the texts' offsets into them."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        self.encode = lambda pieces: [e.ids for e in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        self.cache = WordCache(self.encode, PIECES) if parts_words(vocabulary) else None

    def ids(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.cache is not None:
            data, starts, ends, at = pieces_of(data, offsets)
            return self.cache.ids(data, starts, ends, at, end)
        raw = data.tobytes()  # a vocabulary that is not known to part words sees whole texts
        rows = [[*ids, end] for ids in self.encode([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])]
        return np.fromiter(chain.from_iterable(rows), np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def encoder_of(vocabulary: str) -> Encoder:
    """This worker's encoder for a vocabulary (a file's content) of the tokenizers library."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


_LETTER = np.array([chr(i).isascii() and chr(i).isalpha() for i in range(256)])
_MARK = np.array([32 < i < 127 and not chr(i).isalnum() and i != 39 for i in range(256)])


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' bytes, the starts and ends of their pieces, and the rows' offsets into these.

    The vocabulary's pattern parts words at white space and between a letter and a mark other than the apostrophe, and it takes
    upper for lower case, so ASCII pieces are given in lower case.  Texts that may hold special tokens' strings, which its
    patterns don't part, are cut at white space only and left as they are.
    """
    starts, ends, at = word_spans(data, offsets)
    if ((data[:-1] == 60) & (data[1:] == 124)).any():
        return data, starts, ends, at
    cut = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    cut = cut[~np.isin(cut, starts, assume_unique=True)]  # the first of a row is parted already
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    exact = np.flatnonzero(high[ends] > high[starts])
    upper = (data >= 65) & (data <= 90)
    if len(exact):  # pieces with other characters keep their case
        edge = np.zeros(len(data) + 1, np.int32)
        edge[starts[exact]] += 1
        edge[ends[exact]] -= 1
        upper &= np.cumsum(edge[:-1]) == 0
    return np.where(upper, data + 32, data).astype(np.uint8), starts, ends, np.searchsorted(starts, offsets)


def _write(vocabulary, end: int):
    def run(batches):
        encoder, shard, done = encoder_of(vocabulary.value), TaskContext.get().partitionId(), 0
        for seq, (batch, data, offsets) in enumerate(text_chunks(batches, chunk_bytes=GROUP_BYTES)):
            ids, at = encoder.ids(data, offsets, end)
            counts = np.bincount(ids)
            ranks = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
            place = np.zeros(len(counts), np.uint64)
            place[ranks] = np.arange(len(ranks))
            words, blocks = simple8b.encode(place[ids])
            row = [shard, seq, done, len(ids), batch.column("doc_id").to_pylist(), np.diff(at).tolist(), ranks.astype("<u4").tobytes(), blocks.tobytes(), words.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)
            done += len(ids)

    return run


_NAMES = ["shard", "seq", "shard_start", "n_ids", "doc_ids", "lengths", "ranks", "offsets", "words"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents' ids to ``path``; ``vocabulary`` is a file on the driver, whose content goes to the tasks."""
    content = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows that repeat an id are parted by how their texts begin, which keeps the order
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write(content, end), SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def ids_of(row: dict) -> np.ndarray:
    """All ids of one row of the files."""
    words, offsets, ranks = (np.frombuffer(row[c], t) for c, t in (("words", "<u8"), ("offsets", "<u4"), ("ranks", "<u4")))
    return ranks[simple8b.decode(words, offsets, row["n_ids"]).astype(np.int64)]


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard; one number for each partition that was written."""
    shards = spark.read.schema(SCHEMA).parquet(path).groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_ids")).alias("n")).orderBy("shard").collect()
    ends = np.cumsum([r["n"] for r in shards], dtype=np.int64)
    return {r["shard"]: int(e - r["n"]) for r, e in zip(shards, ends)}


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """From the files, for each document: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    base = shard_starts(spark, path)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = ids_of(row).astype("<u4")
                at = np.concatenate([[0], np.cumsum(row["lengths"], dtype=np.int64)])
                own = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1] + base[row["shard"]] + row["shard_start"]), pa.array(np.diff(at)), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_table(docs: DataFrame, vocabulary: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    path = shared_root(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end, id_col, text_col)
    return read_tokens(docs.sparkSession, path)
