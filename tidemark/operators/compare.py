"""Two scans against each other: life cycle, deltas, baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["line_start", "line_end", "id"]


#: Rows of one fingerprint beyond which its numbers are made up of parts.
HOT_ROWS = 100_000


def hot_fingerprints(hot_rows: int, *sides: DataFrame) -> DataFrame | None:
    """The fingerprints with more rows than that on all sides together, None if there are none; one job of narrow counts."""
    every = reduce(DataFrame.unionAll, [df.select("fingerprint") for df in sides])
    hot = every.groupBy("fingerprint").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select(F.col("fingerprint").alias("_hot"))
    return None if hot.isEmpty() else hot


def occurrences(findings: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """fingerprint, id, severity and occurrence: each row's number within its fingerprint, from 1, in canonical order.

    One window over fingerprints does where each is a few rows. Rows of those
    in ``hot`` (``hot_fingerprints``) are numbered within cells (place and first
    two characters of the id, which keep the canonical order) and a cell's
    numbers start after those of the cells before it, so no task gets the whole
    fingerprint. Missing lines and ids come first.
    """
    rows = findings.select("fingerprint", *ORDER, "severity")
    number = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER))
    if hot is None:
        return rows.select("fingerprint", "id", "severity", number("fingerprint").alias("occurrence"))
    cell = ["line_start", "line_end", "_head"]
    rows = rows.withColumn("_head", F.substring("id", 1, 2))
    counts = rows.groupBy("fingerprint", *cell).agg(F.count("*").alias("n")).join(hot, F.col("fingerprint").eqNullSafe(F.col("_hot")), "left_semi")
    earlier = Window.partitionBy("fingerprint").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("fingerprint").alias("_f"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cell)], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    same = [rows["fingerprint"].eqNullSafe(starts["_f"]), *[rows[c].eqNullSafe(starts[f"_c{i}"]) for i, c in enumerate(cell)]]
    placed = rows.join(starts, same, "left").withColumn("_cell", F.when(F.col("_start").isNotNull(), F.struct(*cell)))
    return placed.select("fingerprint", "id", "severity", (number("fingerprint", "_cell") + F.coalesce("_start", F.lit(0))).cast("int").alias("occurrence"))


def lifecycle(current: DataFrame, previous: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Multiset match by fingerprint: the i-th occurrence meets the i-th; what is left is new or resolved. A null fingerprint meets none."""
    hot = hot_fingerprints(hot_rows, current, previous)

    def side(df: DataFrame, tag: str) -> DataFrame:
        return occurrences(df, hot).select("fingerprint", "occurrence", F.col("id").alias(f"{tag}_id"), F.col("severity").alias(f"{tag}_severity"), F.lit(True).alias(f"in_{tag}"))

    both = side(current, "current").join(side(previous, "previous"), ["fingerprint", "occurrence"], "full_outer")
    state = F.when(F.col("in_previous").isNull(), "new").when(F.col("in_current").isNull(), "resolved").otherwise("persistent")
    return both.select("fingerprint", "occurrence", state.alias("state"), F.coalesce("current_id", "previous_id").alias("id"), F.coalesce("current_severity", "previous_severity").alias("severity"))


def multiset_diff(current: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """How many more of each key one side has, and how many both have."""
    tagged = current.select(*columns, F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(previous.select(*columns, F.lit(0).alias("c"), F.lit(1).alias("p")))
    n = tagged.groupBy(*columns).agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
    return n.select(*columns, F.greatest(F.col("c") - F.col("p"), F.lit(0)).alias("n_new"), F.greatest(F.col("p") - F.col("c"), F.lit(0)).alias("n_resolved"), F.least("c", "p").alias("n_persistent"))


def rule_deltas(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Counts of each rule on both sides and their difference; the category is the current side's where it has one."""
    side = lambda df, c: df.select("rule_id", "category", F.lit(c).alias("cur"))
    both = side(current, True).unionByName(side(previous, False))
    out = both.groupBy("rule_id").agg(
        F.count_if("cur").alias("n_current"), F.count_if(~F.col("cur")).alias("n_previous"), F.coalesce(F.min(F.when(F.col("cur"), F.col("category"))), F.min("category")).alias("category")
    )
    return out.withColumn("delta", F.col("n_current") - F.col("n_previous"))


def baseline_new(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def baseline_unchanged(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi")


def baseline_resolved(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row of each baseline fingerprint that no finding has; the last in canonical order stands for it."""
    last = baseline.groupBy("fingerprint").agg(F.max_by(F.struct("id", "rule_id", "file"), F.struct("line_start", "id")).alias("b"))
    return last.join(findings.select("fingerprint").distinct(), "fingerprint", "left_anti").select("fingerprint", "b.*")


def first_seen(history: DataFrame) -> DataFrame:
    """First scan, occurrences and distinct scans of each fingerprint over the history."""
    return history.groupBy("fingerprint").agg(F.min_by("scan_id", F.struct("started_at", "scan_id")).alias("first_scan"), F.count("*").alias("occurrences"), F.count_distinct("scan_id").alias("scans"))


def forbidden_rules(findings: DataFrame, rules: list[str]) -> DataFrame:
    return findings.where(F.col("rule_id").isin(rules)).groupBy("rule_id").agg(F.count("*").alias("n"))
