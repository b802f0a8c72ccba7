"""Quality rules in DataFrame functions: base rules, and a hashed n-gram log-likelihood ratio (operator 6, native).

Base rules count, in each whole text, words, their code points, symbols, repeated lines and words in repeated five-word windows.
The verdict compares two multinomials over ``2 * BUCKETS`` hashed words and word pairs: the trusted target's (documents labelled
good) and the raw corpus' (all documents).  A document's score is the mean over its n-grams of the logarithm of their ratio, and
it is kept from ``THRESHOLD`` on, a fixed number, so a verdict depends on the counts alone.  The counts are one partial
aggregation over all documents with 2 * BUCKETS groups; their table of that fixed size goes to all tasks as a literal.

Defined cases: null is an empty text, which has no words and fails the base rules; a text of any length is one row, whose words,
hashes and windows one task holds; without trusted documents all scores are 0 and
the base rules decide; rows with equal ids are judged each by itself; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
THRESHOLD = -0.08
BROADCAST_ROWS = 200_000
# Fixed values of the rules: what parts words, what counts as a symbol, the window's words.
SEPARATOR = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SEPARATOR}]+"), "")


def _hashes(words: Column) -> Column:
    """One hash for each word; all that is hashed after it are these numbers."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    """A hash for each pair of neighbours."""
    size = F.size(hashes)
    pairs = F.zip_with(F.slice(hashes, F.lit(1), size - 1), F.slice(hashes, F.lit(2), size - 1), lambda a, b: F.xxhash64(a, b))
    return F.when(size >= 2, pairs).otherwise(F.array().cast("array<bigint>"))


def _slot(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _windows(hashes: Column, pairs: Column) -> Column:
    """A hash for each window of five words, out of two pairs and a word."""
    size = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(pairs[i], pairs[i + 2], hashes[i + 4]))
    return F.when(size >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash another window shares; only texts with such windows pay for the sorting."""

    def covered(pairs: Column) -> Column:
        size = F.size(pairs)
        neighbours = F.zip_with(F.slice(pairs, F.lit(1), size - 1), F.slice(pairs, F.lit(2), size - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(neighbours, lambda x: x.isNotNull()))))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(x, a["end"])).alias("n"), (x + WINDOW).alias("end")), lambda a: a["n"])

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # an array of one, so that the sorted pairs are made once
    once = F.transform(F.array(pairs), covered)[0]
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), once).otherwise(F.lit(0))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """For each bucket the log-likelihood ratio of the trusted target to the raw corpus, with add-one smoothing."""
    ids = trusted.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct().withColumn("good", F.lit(1))
    # two numbers a row, so some 30 MB at most; beyond, ids and texts are shuffled, before they are split into words
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(ids, "id", "left")
    rows = rows.select("good", words_of(F.col("t")).alias("w"))
    # each word with the next one (null after the last); words first count by themselves, in one row of partial sums each
    both = rows.select("good", F.explode(F.arrays_zip(F.col("w").alias("w"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("next"))).alias("x"))
    hashes = both.select("good", F.xxhash64("x.w").alias("h"), F.when(F.col("x.next").isNotNull(), F.xxhash64("x.next")).alias("k"))
    slots = hashes.select("good", _slot(F.col("h")).alias("word"), F.when(F.col("k").isNotNull(), _slot(F.xxhash64("h", "k")) + BUCKETS).alias("pair"))
    raw, target = [1.0] * (2 * BUCKETS), [1.0] * (2 * BUCKETS)
    slots = slots.select("good", F.explode(F.array("word", "pair")).alias("slot"))
    counts = slots.groupBy("slot").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    for r in counts.where("slot is not null").collect():  # 2 * BUCKETS rows at most
        raw[r["slot"]] += r["raw"]
        target[r["slot"]] += r["target"]
    all_raw, all_target = sum(raw), sum(target)
    if all_target == 2 * BUCKETS:
        return [0.0] * (2 * BUCKETS)
    return [math.log(t / all_target) - math.log(r / all_raw) for t, r in zip(target, raw)]


def rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For each row: doc_id, the base counts, base_failed, kept, and llr (the score)."""
    # a constant string that the optimizer turns into one array literal
    ratios = F.split(F.lit(",".join(map(repr, log_ratios(docs, trusted, id_col, text_col)))), ",").cast("array<double>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("doc_id", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SEPARATOR}]")).alias("lines"))
    rows = rows.select("doc_id", "t", _hashes(F.col("w")).alias("h"), F.length(F.array_join("w", "")).alias("chars"), "lines")
    rows = rows.select("doc_id", "t", "h", _pairs(F.col("h")).alias("p"), "chars", "lines")
    total = lambda hashes, first: F.aggregate(hashes, F.lit(0.0), lambda a, h: a + ratios[_slot(h) + first])
    rows = rows.select(
        "doc_id",
        F.size("h").cast("long").alias("n_words"),
        F.col("chars").cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("h"), F.col("p")).alias("windows"),
        (total(F.col("h"), 0) + total(F.col("p"), BUCKETS)).alias("total"),
    )
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"), "total")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    llr = F.when(F.col("n_words") > 0, F.col("total") / (2 * F.col("n_words") - 1)).otherwise(F.lit(0.0))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), llr.alias("llr"))
    return rows.select(*rows.columns[:-1], (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")
