"""From findings to penalties, category scores, overall score and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEVERITIES, band, dimension, finding_weight, severity_rank
from .files import scope_excluded

# Fixed values of the penalty and density formulas.
FULL_WEIGHT = 20
LOG_SCALE = 5.0
MIN_LOC = 200
SATURATION = 40.0
FLOOR_TWO_CRITICAL, FLOOR_CRITICAL, FLOOR_HIGH = 81, 61, 41


def severity_histogram(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings by severity in each group, zero where there are none."""
    counts = findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.unpivot(keys, list(SEVERITIES), "severity", "n")


def category_counts(findings: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    counts = findings.groupBy(*keys).agg(*[F.count_if(F.col("category") == c).alias(c) for c in categories])
    return counts.unpivot(keys, categories, "category", "n")


def rule_penalty(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the 20 largest weights, and a logarithmic share of the rest.

    Only the count and the 20 largest matter. Weights take few values, so rows
    are counted by value before the shuffle and the window is over those counts:
    a rule with a third of all findings is a handful of rows.
    """
    w = findings.select(*keys, finding_weight(F.col("severity"), F.col("confidence")).alias("w"))
    by_value = w.groupBy(*keys, "w").agg(F.count("*").alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("w"))
    before = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = F.greatest(F.lit(0), F.least(F.col("n"), FULL_WEIGHT - before))
    top = by_value.withColumn("used", used).groupBy(*keys).agg(F.sum("n").alias("n_findings"), F.sum(F.col("w") * F.col("used")).alias("base"))
    excess = F.when(F.col("n_findings") > FULL_WEIGHT, F.col("base") / FULL_WEIGHT * LOG_SCALE * F.log(1.0 + F.col("n_findings") - FULL_WEIGHT)).otherwise(0.0)
    return top.select(*keys, "n_findings", (F.col("base") + excess).alias("penalty"))


def density_score(penalty: Column, loc: Column) -> Column:
    """0 to 100, by penalty per thousand lines with a floor on the lines."""
    per_kloc = penalty / (F.greatest(loc, F.lit(MIN_LOC)) / 1000.0)
    return F.when(penalty <= 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * (1.0 - F.exp(-per_kloc / SATURATION)))))


def category_scores(findings: DataFrame, loc: DataFrame, repo: str, weights: dict[str, float]) -> DataFrame:
    """Score of every active category of every repository; ``loc`` has (repo, loc), ``weights`` the active categories."""
    penalties = rule_penalty(findings, [repo, "category", "rule_id"]).groupBy(repo, "category").agg(F.sum("penalty").alias("penalty"), F.sum("n_findings").alias("n_findings"))
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(w).alias("weight")) for c, w in weights.items()])
    cells = loc.select(repo, "loc", F.inline(each))
    joined = cells.join(penalties, [repo, "category"], "left")
    return joined.select(repo, "category", "weight", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"), F.round(density_score(F.coalesce("penalty", F.lit(0.0)), F.col("loc")), 1).alias("score"))


def overall(scores: DataFrame, repo: str, floors: DataFrame | None = None) -> DataFrame:
    """Weighted mean of the category scores, rounded half to even, and its band; never below the floor, where ``floors`` (repo, floor) has one."""
    total = F.sum(F.coalesce("score", F.lit(0.0)) * F.col("weight")) / F.sum("weight")
    out = scores.groupBy(repo).agg(F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.round(total, 9), 0).cast("int"))).alias("score"), F.sum("n_findings").alias("n_findings"))
    if floors is not None:
        out = out.join(floors.select(repo, "floor"), repo, "left").withColumn("score", F.greatest("score", F.coalesce("floor", F.lit(0))))
    return out.select(repo, "score", band(F.col("score")).alias("band"), "n_findings")


def severity_floor(findings: DataFrame, keys: list[str], trigger: Column, active: list[str] | None = None) -> DataFrame:
    """The score that severe findings of high confidence guarantee; of ``active`` categories, if given, and files in scope."""
    hit = (F.col("confidence") == "high") & trigger
    if active is not None:
        hit = hit & F.col("category").isin(active) & ~scope_excluded(F.col("file"))
    counted = findings.groupBy(*keys).agg(F.count_if(hit & (F.col("severity") == "critical")).alias("n_critical"), F.count_if(hit & (F.col("severity") == "high")).alias("n_high"))
    return counted.withColumn("floor", F.when(F.col("n_critical") >= 2, FLOOR_TWO_CRITICAL).when(F.col("n_critical") == 1, FLOOR_CRITICAL).when(F.col("n_high") >= 1, FLOOR_HIGH).otherwise(0))


def floor_trigger() -> Column:
    """The named triggers: credentials, unguarded mutating admin endpoints, confirmed injection sinks."""
    said = F.lower(F.concat_ws(" ", "description", "title"))
    admin = F.lower("description").rlike("admin|manage|internal")
    mutating = F.lower(F.concat_ws(" ", "title", "description", "symbol")).rlike("mutat|delete|remove|update|create|post|put|patch")
    return (
        (F.col("rule_id") == "ENT-LOG-002") & F.col("confidence").isin("high", "medium")
        | (F.col("rule_id") == "ENT-AUTH-001") & admin & mutating
        | F.col("rule_id").isin("ENT-INPUT-003", "ENT-INPUT-JS-001") & said.rlike("sql|subprocess|command execution|eval|exec|system")
    )


def worst_category(scores: DataFrame, repo: str, order: DataFrame) -> DataFrame:
    """Category of the highest score; of equals the first in category order."""
    return scores.join(F.broadcast(order), "category").groupBy(repo).agg(F.max_by("category", F.struct("score", -F.col("ord"))).alias("worst_category"), F.max("score").alias("worst_score"))


def top_rules(findings: DataFrame, n: int = 10) -> DataFrame:
    """Rules by points, then count, then name."""
    by_rule = rule_penalty(findings, ["rule_id"])
    return by_rule.orderBy(F.round("penalty", 6).desc(), F.desc("n_findings"), "rule_id").limit(n)


def top_findings(findings: DataFrame, n: int) -> DataFrame:
    """Most severe first, then the canonical order."""
    return findings.orderBy(severity_rank(F.col("severity")), "file", "line_start", "rule_id", "id").limit(n)


def categories(spark, names) -> DataFrame:
    return dimension(spark, "category", names)
