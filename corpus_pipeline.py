"""A corpus pipeline over ``documents``: each stage's rows are written as Parquet, read again, and given to the next stage.

1. quality classifier      documents below ``REJECT_BELOW`` go
2. MinHash near-dedup      of each group of near copies one document stays, that of the least id
3. suffix-array dedup      bytes of repeated passages go (a character goes if all of its bytes do); n_chars follows the text
4. source mixing           documents are sampled by their raked weights
5. SentencePiece           the pieces of each text

All stages but the last return the columns of documents, whatever more of them there are and whatever their names (dots, and the
names of the operators' own results, included).  Each states in its docstring what it does with nulls, empty and very long texts, ties
and repeated rows; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.shipping import ship
from docmill.llm import minhash_dedup, mixing, quality, sentencepiece_codec, suffix_dedup
from docmill.llm.labelled import named, remainder, whole
from docmill.llm.queries import documents, labels, vocabulary
from docmill.llm.storage import shared_root, stored

REJECT_BELOW = 0.5
SIMILARITY = 80
TOKEN_BUDGET = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts score by the rate of good labels and stay or go together; a text of any length is scored whole; a score of
    exactly ``REJECT_BELOW`` stays; repeated rows stay or go together, each as a row of its own; a null id changes nothing."""
    scored = quality.quality(docs, labels(spark, sf_dir), learn=remainder("doc_id", 3) != 1, with_row=True)
    return whole(scored.where(F.col("score") >= REJECT_BELOW), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words, null ones among them, are copies of nothing and stay, as do rows without an id; a text of any length is
    compared whole; of rows equal in id and text the one whose columns come first as JSON stays; rows with one id and different
    texts count as one document for links, and each goes or stays by its own text."""
    near = minhash_dedup.near_duplicates(docs, SIMILARITY)
    kept = near.where("kept and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    stays = rows.where("id is not null").join(kept, ["id", "hash"], "left_semi")
    # few rows are repeated, if any; only those are brought together, with partial minima first
    counts = rows.where("id is not null").groupBy("id", "hash").count().where("count > 1").select("id", "hash")
    repeated = stored(counts, f"{shared_root(spark, 'repeated')}/rows")
    if not repeated.isEmpty():
        once = stays.join(repeated, ["id", "hash"], "left_semi").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
        stays = stays.join(repeated, ["id", "hash"], "left_anti").select("row").unionByName(once.select("row"))
    return stays.select("row").unionByName(rows.where("id is null").select("row")).select("row.*")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text becomes an empty one; texts under 100 bytes stay as they are; a text of any length is judged whole; the first of
    equal passages, by id and then text, stays, so of repeated rows one keeps its text and the others may end empty; null ids
    come first."""
    out = whole(suffix_dedup.without_repeats(docs), docs, text="kept_text")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null sources and languages are categories; texts without words have topic 0 and no tokens, and go or stay by their cell's
    probability; a text of any length counts whole; rows with one id are kept or left together; a null id draws one number."""
    return whole(mixing.mixed(docs, budget=TOKEN_BUDGET).where("sampled"), docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no pieces; a text of any length is encoded whole; every row, repeated or without an id, gives one."""
    return sentencepiece_codec.encoded(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("repeated passage removal", suffix_dedup_stage),
    ("source mixing", mixing_stage),
    ("SentencePiece encoding", sentencepiece_stage),
]

#: SQL can express neither the trained classifier nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs, root = documents(spark, sf_dir), shared_root(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{root}/{i}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
