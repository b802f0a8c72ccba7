"""The queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmill.llm import fingerprints, lm_scoring, minhash_dedup, mixing, quality, quality_rules, sentencepiece_codec, sql, suffix_dedup, token_output, toxicity
from docmill.llm.labelled import crc_remainder, remainder
from docmill.llm.storage import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(documents(spark, sf_dir))


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_table(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end=1)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir), learn=remainder("doc_id", 5) != 0)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(documents(spark, sf_dir), labels(spark, sf_dir), learn=remainder("doc_id", 3) != 1)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(documents(spark, sf_dir), labels(spark, sf_dir).where("quality = 1"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.lm_scores(documents(spark, sf_dir), learns=lambda doc_id: crc_remainder(doc_id, 10) != 0)
    return out.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir), percent=85).drop("text_hash")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("row.doc_id", "row.source", "row.lang", "topic", "n_tokens", "weight", "probability", "sampled", "margin_gap")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_suffix_dedup, op2_token_output, op3_toxicity, op4_quality, op5_fingerprints,
        op6_quality_rules, op7_lm_scoring, op8_minhash_dedup, op9_mixing, op10_sentencepiece,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
