"""Measures of how well scores separate labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def roc_auc(rows: DataFrame, score: str, positive: str, keys: list[str]) -> DataFrame:
    """Mann-Whitney with half credit for ties; 0.5 where a class is empty.

    Rows are counted by score before anything is ordered, so the window is over distinct scores.
    """
    by = rows.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = by.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0))).groupBy(*keys).agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2.0)).alias("u"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))
    auc = F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), F.col("u") / (F.col("n_positive") * F.col("n_negative"))).otherwise(0.5)
    return won.select(*keys, F.round(auc, 6).alias("auc"), "n_positive", "n_negative")


def distribution(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, extremes and lower order statistics (index floor(q (n - 1)), no interpolation)."""
    by = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumn("seen", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    at = lambda q: F.min(F.when(F.col("seen") >= F.floor(q * (F.col("n") - 1)) + 1, F.col(value)))
    return run.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("min"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), F.max(value).alias("max"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("n"), 6).alias("mean"))


def precision(labels: DataFrame, rule: str, label: str) -> DataFrame:
    """True over true and false positives of each rule; unsure labels count for neither."""
    out = labels.groupBy(rule).agg(F.count_if(F.col(label) == "true_positive").alias("tp"), F.count_if(F.col(label) == "false_positive").alias("fp"), F.count_if(F.col(label) == "unsure").alias("unsure"))
    return out.withColumn("precision", F.round(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), 6))


def separation(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Gap of the class means and whether the classes' ranges don't overlap."""
    p, n = F.when(F.col(positive), F.col(score)), F.when(~F.col(positive), F.col(score))
    return rows.agg(F.round(F.avg(p) - F.avg(n), 6).alias("gap"), F.min(p).alias("min_positive"), F.max(n).alias("max_negative")).withColumn("separated", F.col("min_positive") > F.col("max_negative"))


def bootstrap_indices(n: int, resamples: int = 1000, seed: int = 42) -> list[list[int]]:
    """Resample indices of Python's generator, which a distributed generator can't reproduce."""
    from random import Random

    rng = Random(seed)
    return [[rng.randrange(n) for _ in range(n)] for _ in range(resamples)]


def bootstrap_interval(rows: DataFrame, score: str, positive: str, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the AUC over resamples of a labelled corpus, which is a few dozen rows; those without both classes are left out."""
    got = [(r[0], bool(r[1])) for r in rows.select(score, positive).orderBy(score, positive).collect()]
    values = []
    for at in bootstrap_indices(len(got), resamples, seed):
        p, n = [got[i][0] for i in at if got[i][1]], [got[i][0] for i in at if not got[i][1]]
        if p and n:
            values.append(sum((x > y) + 0.5 * (x == y) for x in p for y in n) / (len(p) * len(n)))
    if not values:
        return 0.5, 0.5
    values.sort()
    tail = (1 - level) / 2
    return values[int(tail * len(values))], values[min(len(values) - 1, int((1 - tail) * len(values)))]
