"""Range and prefix joins as equi-joins.

A range of integers is the union of at most two aligned blocks of each power of
two, and an integer lies in one block of each size, so "inside a range" is
equality of block keys. "Greater than" is equality of the bits above the highest
one in which two numbers differ, which is set in the larger one only. "Is a path
below" is equality with one of the path's own beginnings. Each pair meets under
one key only, and no join has a condition besides equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks_of(start: str, stop: str) -> Column:
    """The aligned blocks (level, block) whose union is the range from start to stop; none if it is empty.

    At level k the range that lower levels left runs from ceil(start / 2^k) to
    floor((stop + 1) / 2^k) - 1; an odd first or an even last block is not part
    of a larger one inside the range.
    """
    a, b = F.col(start).cast("bigint"), F.col(stop).cast("bigint")
    levels = F.when(b >= a, F.sequence(F.lit(0), F.log2(b - a + 1).cast("int") + 1)).otherwise(F.array().cast("array<int>"))

    def at(k: Column) -> Column:
        first, after = _shift(a + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k), _shift(b + 1, k)
        left = F.when((first < after) & (first.bitwiseAND(F.lit(1)) == 1), first)
        right = F.when((first < after) & (after.bitwiseAND(F.lit(1)) == 1), after - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda block: F.struct(k.alias("level"), block.alias("block")))

    return F.flatten(F.transform(levels, at))


def _shift(n: Column, k: Column) -> Column:
    return F.call_function("shiftright", n, k)


def blocks_above(place: str, top: Column) -> Column:
    """The block (level, block) of each level up to ``top`` that holds the place."""
    return F.transform(F.sequence(F.lit(0), top), lambda k: F.struct(k.alias("level"), _shift(F.col(place).cast("bigint"), k).alias("block")))


def narrowest_enclosing(places: DataFrame, spans: DataFrame, key: str, place: str = "line") -> DataFrame:
    """key, place and scope of each distinct place (key, place) inside some span; the narrowest span, of equals the first declared.

    ``spans`` has (key, span_id, start, stop, ord). Of all spans that have a block
    only the narrowest counts, as each of them holds the whole block; so a block
    is one row, and a place meets at most one row of each level.
    """
    better = F.min(F.struct((F.col("stop") - F.col("start")).alias("width"), "ord", "span_id"))
    keyed = spans.select(F.col(key).alias("_key"), "span_id", "start", "stop", "ord", F.inline(blocks_of("start", "stop")))
    blocks = keyed.groupBy("_key", "level", "block").agg(better.alias("best"))
    top = spans.agg(F.coalesce(F.max(F.expr("case when stop >= start then cast(log2(stop - start + 1) as int) + 1 end")), F.lit(0)).alias("top")).scalar()
    asked = places.select(F.col(key).alias("_key"), F.col(place).alias("_place")).where("_key is not null and _place is not null").distinct()
    asked = asked.withColumn("_top", top).select("_key", "_place", F.inline(blocks_above("_place", F.col("_top"))))
    found = asked.join(blocks, ["_key", "level", "block"]).groupBy("_key", "_place").agg(F.min("best")["span_id"].alias("scope"))
    return found.select(F.col("_key").alias(key), F.col("_place").alias(place), "scope")


def _bits(number: str, top: Column, wanted: int) -> Column:
    """Of each bit up to ``top`` that is ``wanted``: its place and the bits above it."""
    n = F.col(number).cast("bigint")
    chosen = F.filter(F.sequence(F.lit(0), top), lambda k: _shift(n, k).bitwiseAND(F.lit(1)) == wanted)
    return F.transform(chosen, lambda k: F.struct(k.alias("bit"), _shift(n, k + 1).alias("above")))


def later_pairs(later: DataFrame, earlier: DataFrame, keys: list[str], number: str, smaller: str) -> DataFrame:
    """All pairs of equal ``keys`` where ``number`` of the one is greater than ``smaller`` of the other; both at least zero."""
    top = later.agg(F.coalesce(F.max(F.expr(f"cast(log2({number} + 1) as int)")), F.lit(0)).alias("top")).scalar()
    a = later.where(F.col(number) >= 0).withColumn("_top", top).select("*", F.inline(_bits(number, F.col("_top"), 1))).drop("_top")
    # a smaller number has no bits above the larger one's top; one that has is not smaller
    b = earlier.where(F.col(smaller) >= 0).withColumn("_top", top).select("*", F.inline(_bits(smaller, F.col("_top"), 0))).drop("_top")
    return a.join(b, [*keys, "bit", "above"]).drop("bit", "above")


def beginnings(path: Column) -> Column:
    """The path itself and what stands before each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
