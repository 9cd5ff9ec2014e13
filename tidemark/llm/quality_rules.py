"""Quality rules: repetition and length rules, then a hashed n-gram likelihood ratio.

Every document is scored by the mean over its tokens of
log p_target(n-gram) - log p_raw(n-gram), where both are smoothed multinomials
over hashed unigrams and bigrams: the raw one counts all documents, the target
one the trusted rows. A document is kept if it passes the base rules and its
score is not below a fixed threshold. All of it is DataFrame expressions; the
ratios reach the scoring plan as one array literal of ``2 * BUCKETS`` doubles,
whatever the corpus, and a document never leaves its row, so scoring has no
shuffle.

Edge cases: a null or empty text has no words, fails the base rules and is not
kept; a text without tokens scores 0; repeated rows give repeated results; an
empty table gives an empty result. Other columns are ignored by ``measure`` and
kept by ``filter_documents``. Trusted rows are all rows labelled good; without
any the score is 0 for all, and the base rules alone decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of unigrams, and as many of bigrams.
BUCKETS = 1 << 15
SMOOTHING = 1.0
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once: a lambda must not hold an expression that it would evaluate for each element."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def base_measures(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the tokens."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = docs.select(
        *keep,
        F.array_remove(F.split(text, SPACE), "").alias("_words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        tokens(text).alias("_tokens"),
    )
    out = out.select(
        *keep,
        "_tokens",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    measured = ["_tokens", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.select(*keep, *measured, F.when(twice, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_sorted"))
    found = F.filter("_sorted", lambda x, k: (F.get("_sorted", k - 1)["h"] == x["h"]) | (F.get("_sorted", k + 1)["h"] == x["h"]))
    out = out.select(*keep, *measured, F.sort_array(F.transform(found, lambda x: x["i"])).alias("_at"))
    step = F.transform("_at", lambda d, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1), d + WINDOW) - d))
    out = out.select(*keep, *measured, F.aggregate(step, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def unigram(t: Column) -> Column:
    return F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")


def bigram(t: Column, following: Column) -> Column:
    return (F.pmod(F.xxhash64(t, following), F.lit(BUCKETS)) + BUCKETS).cast("int")


def trusted_rows(labels: DataFrame) -> DataFrame:
    """The ids of documents labelled good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row with ``w``: the log ratio of each bucket, unigrams first."""
    spark = docs.sparkSession
    # by shuffle at any size, so that no broadcast grows with the labels; texts are made into tokens after the join
    mark = trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_trusted"))
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(mark.hint("shuffle_merge"), "_id", "left")
    toks = marked.select("_trusted", tokens(F.coalesce("_text", F.lit(""))).alias("t"))
    pairs = toks.select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"), F.explode(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))).alias("b"))).alias("p"))
    grams = pairs.select("_trusted", F.explode(F.array(unigram(F.col("p.a")), F.when(F.col("p.b").isNotNull(), bigram(F.col("p.a"), F.col("p.b"))))).alias("bucket")).where(F.col("bucket").isNotNull())
    counts = grams.groupBy("bucket", "_trusted").count().groupBy("bucket").agg(F.sum("count").alias("raw"), F.sum(F.when(F.col("_trusted") == 1, F.col("count")).otherwise(0)).alias("target"))
    full = spark.range(2 * BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    totals = full.groupBy((F.col("bucket") >= BUCKETS).alias("two")).agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    both = full.join(F.broadcast(totals), (F.col("bucket") >= BUCKETS) == F.col("two"))
    weight = F.log((F.col("target") + SMOOTHING) / (F.col("all_target") + SMOOTHING * BUCKETS)) - F.log((F.col("raw") + SMOOTHING) / (F.col("all_raw") + SMOOTHING * BUCKETS))
    ranked = both.select("bucket", F.when(F.col("all_target") > 0, weight).otherwise(0.0).alias("w"))
    return ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "w"))), lambda x: x["w"]).alias("w"))


def with_scores(measured: DataFrame, ratios: DataFrame) -> DataFrame:
    """``measured`` with score: the mean log ratio over its tokens (unigram and bigram at each)."""
    w = F.lit(np.array(ratios.first()["w"]))

    def total(weights: Column) -> Column:
        def weight(t: Column, i: Column) -> Column:
            following = F.get(F.col("_tokens"), i + 1)
            return F.get(weights, unigram(t)) + F.when(following.isNotNull(), F.get(weights, bigram(t, following))).otherwise(0.0)

        each = F.transform("_tokens", weight)
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.greatest(2 * F.size("_tokens") - 1, F.lit(1))

    # an explode of one element ends the projections here: a later filter is not written into them, where lambdas would compute it again and again
    kept = [c for c in measured.columns if c != "_tokens"]
    return measured.select(F.explode(F.array(F.struct(*kept, let(w, total).alias("score")))).alias("_measured")).select("_measured.*")


def measure(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The measures, score and verdict of every document, beside its ``keep`` columns (the id if None)."""
    columns = [F.col(id_col).alias("doc_id")] if keep is None else [docs[c] for c in keep]
    base = base_measures(docs, text_col, columns) if keep is not None else base_measures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(text_col)), text_col, ["doc_id"])
    scored = with_scores(base, log_ratios(docs, trusted_rows(labels), text_col, id_col))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def filter_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"), F.col(id_col).alias("_doc"))
    base = base_measures(packed, "_text", ["_row"])
    scored = with_scores(base, log_ratios(docs, trusted_rows(labels), text_col, id_col))
    return scored.where(~F.col("base_failed") & (F.col("score") >= threshold)).select("_row.*")
