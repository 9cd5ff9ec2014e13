"""Declarative thresholds over metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the default policy: rule, kind, metric, threshold, verdict on violation.
DEFAULT_POLICY = (
    ("max_score", "absolute", "score", 80.0, "fail"),
    ("max_delta", "delta", "score_delta", 5.0, "fail"),
    ("warn_delta", "delta", "score_delta", 2.0, "warn"),
    ("max_new", "delta", "n_new", 20.0, "fail"),
    ("max_new_high", "delta", "n_new_high", 2.0, "fail"),
    ("max_new_critical", "delta", "n_new_critical", 0.0, "fail"),
)


def policy_rules(spark: SparkSession, rules=DEFAULT_POLICY) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_name string, kind string, metric string, threshold double, verdict string")


def evaluate(metrics: DataFrame, rules: DataFrame, key: str, kind: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Verdict of each rule (of one ``kind``, if named) for each key: above the threshold violates, equal passes.

    ``metrics`` has (key, metric, actual, has_baseline). Without a baseline a
    delta rule doesn't apply; a null delta counts as 0. ``by`` names columns that
    metrics and rules have in common beside the metric, such as the category.
    """
    wanted = rules.where(F.col("kind") == kind) if kind else rules
    actual = F.coalesce("actual", F.lit(0.0))
    status = F.when((F.col("kind") == "delta") & ~F.col("has_baseline"), "not_applicable").when(actual > F.col("threshold"), F.col("verdict")).otherwise("pass")
    return metrics.join(wanted, ["metric", *by]).select(key, *by, "rule_name", "threshold", F.round(actual, 6).alias("actual"), status.alias("status"))


def verdict(results: DataFrame, key: str) -> DataFrame:
    """Fail if any rule fails, else warn if any warns, else pass."""
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    out = results.groupBy(key).agg(worst.alias("w"), F.count_if(F.col("status").isin("fail", "warn")).alias("n_violations"))
    return out.select(key, F.when(F.col("w") == 2, "fail").when(F.col("w") == 1, "warn").otherwise("pass").alias("verdict"), (F.col("w") < 2).alias("passed"), "n_violations")


EXIT_CODE = {"pass": 0, "warn": 0, "fail": 1, "error": 2}
CHECK_CONCLUSION = {"pass": "success", "warn": "neutral", "fail": "failure", "error": "failure"}
