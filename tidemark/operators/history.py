"""Scan history: pages, trends, latest rows, upserts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def where_all(df: DataFrame, **equal) -> DataFrame:
    """Rows that meet all conditions given (None: not asked for)."""
    tests = [F.col(k) == v for k, v in equal.items() if v is not None]
    return df.where(reduce(and_, tests)) if tests else df


def page(scans: DataFrame, number: int, size: int, **equal) -> DataFrame:
    """A page of the newest scans; ties break on the scan id, so pages neither overlap nor miss rows."""
    return where_all(scans, **equal).orderBy(F.desc("started_at"), F.desc("scan_id")).offset((number - 1) * size).limit(size)


def recent(scans: DataFrame, n: int) -> DataFrame:
    return scans.orderBy(F.desc("started_at"), F.desc("scan_id")).limit(n)


def trend(scans: DataFrame) -> DataFrame:
    """Completed scans of each repository in time order with the change since the one before."""
    w = Window.partitionBy("repository_id").orderBy("started_at", "scan_id")
    return scans.where("status = 'completed'").select("repository_id", "scan_id", F.row_number().over(w).alias("point"), "score", (F.col("score") - F.lag("score").over(w)).alias("change"))


def category_trend(scans: DataFrame, scores: DataFrame) -> DataFrame:
    """Category scores of completed scans; null where a category wasn't analysed."""
    return scans.where("status = 'completed'").select("repository_id", "scan_id").join(scores, "scan_id", "left")


def latest_per_key(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by ``order``; one row a key and task goes through the shuffle, so a hot key stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def current_head(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Marks the newest row of each key, that of the greatest ``newest`` columns, and no other.

    The newest is found by an aggregate and joined back, so a key with a third
    of all rows isn't sorted in one task. ``newest`` must tell the rows of a key
    apart; rows equal in all of it share the mark. A null key is a key as well.
    """
    heads = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(F.struct(*newest)).alias("_newest"))
    same = [rows[k].eqNullSafe(heads[f"_k_{k}"]) for k in keys]
    return rows.join(heads, same).withColumn("is_current_head", F.struct(*newest).eqNullSafe(F.col("_newest"))).drop("_newest", *[f"_k_{k}" for k in keys])


def resolve(ids: DataFrame, scans: DataFrame) -> DataFrame:
    """Repository of each identifier: by repository id, else by name (latest scan), else by scan id."""
    by_id = scans.select(F.col("repository_id").cast("string").alias("identifier"), F.col("repository_id").alias("r1")).distinct()
    by_name = latest_per_key(scans, ["repo_name"], F.desc("started_at"), F.desc("scan_id")).select(F.col("repo_name").alias("identifier"), F.col("repository_id").alias("r2"))
    by_scan = scans.select(F.concat(F.lit("scan-"), F.col("scan_id")).alias("identifier"), F.col("repository_id").alias("r3"))
    found = ids.join(by_id, "identifier", "left").join(by_name, "identifier", "left").join(by_scan, "identifier", "left")
    return found.select("identifier", F.coalesce("r1", "r2", "r3").alias("repository_id"))


def page_count(scans: DataFrame, size: int, keys: list[str]) -> DataFrame:
    return scans.groupBy(*keys).agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).cast("long").alias("pages"))


def upsert_latest(old: DataFrame, new: DataFrame, key: str, fixed: list[str], changing: list[str]) -> DataFrame:
    """Insert or update by key: ``fixed`` columns keep the first version, ``changing`` ones take the last."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.groupBy(key).agg(F.min_by(F.struct(*fixed), "_v").alias("f"), F.max_by(F.struct(*changing), "_v").alias("c")).select(key, "f.*", "c.*")


def upsert_coalesce(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge in which a null of the new side keeps the old value."""
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    return old.select(key, *columns).join(n, key, "full_outer").select(key, *[F.coalesce(f"_n_{c}", c).alias(c) for c in columns])


def idempotent_insert(existing: DataFrame, incoming: DataFrame, keys: list[str], *order) -> DataFrame:
    """Incoming rows whose key isn't there yet, one of each key."""
    return latest_per_key(incoming.join(existing.select(*keys).distinct(), keys, "left_anti"), keys, *order)


def order_pairs(pairs: DataFrame, scans: DataFrame) -> DataFrame:
    """Selected pairs (first_id, second_id) as (current_id, previous_id): the later scan is current, of equal times the first."""
    a = scans.select(F.col("scan_id").alias("first_id"), F.col("started_at").alias("_a"))
    b = scans.select(F.col("scan_id").alias("second_id"), F.col("started_at").alias("_b"))
    later = F.col("_a") >= F.col("_b")
    both = pairs.select("first_id", "second_id").join(a, "first_id").join(b, "second_id")
    return both.select(F.when(later, F.col("first_id")).otherwise(F.col("second_id")).alias("current_id"), F.when(later, F.col("second_id")).otherwise(F.col("first_id")).alias("previous_id"))
