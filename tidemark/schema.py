"""Canonical enumerations as ordered data: severities, confidences, categories, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Penalty of a severity, and multiplier of a confidence.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_WEIGHT = {"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 1.0, "info": 0.0}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.8, "low": 0.5}
# Category weights in their order.
CATEGORY_WEIGHT = {
    "authentication_consistency": 0.20,
    "authorization_consistency": 0.20,
    "error_handling": 0.15,
    "input_validation": 0.15,
    "logging_and_secrets": 0.15,
    "architectural_consistency": 0.10,
    "code_duplication": 0.05,
}
# Upper bound of each band.
BANDS = ((20, "very_low"), (40, "low"), (60, "moderate"), (80, "high"), (100, "very_high"))


def pick(col: Column, values: dict, default=None) -> Column:
    """A CASE over literal values; stays in generated code, unlike a map lookup."""
    out = reduce(lambda acc, kv: acc.when(col == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(col == next(iter(values)), F.lit(next(iter(values.values())))))
    return out.otherwise(F.lit(default))


def severity_rank(col: Column) -> Column:
    """0 for critical to 4 for info; alphabetical order would be wrong."""
    return pick(col, {s: i for i, s in enumerate(SEVERITIES)}, len(SEVERITIES))


def confidence_rank(col: Column) -> Column:
    return pick(col, {"high": 0, "medium": 1, "low": 2}, 3)


def finding_weight(severity: Column, confidence: Column) -> Column:
    return pick(severity, SEVERITY_WEIGHT, 0.0) * pick(confidence, CONFIDENCE_WEIGHT, 0.0)


def band(score: Column) -> Column:
    out = F.when(score <= BANDS[0][0], BANDS[0][1])
    for top, name in BANDS[1:-1]:
        out = out.when(score <= top, name)
    return out.otherwise(BANDS[-1][1])


def dimension(spark: SparkSession, name: str, values) -> DataFrame:
    """A small literal table of one column and its ordinal."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, ord int")
