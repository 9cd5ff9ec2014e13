"""Filters, suppressions, dedupes and group rules over findings and endpoints."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case
from .intervals import beginnings, later_pairs, narrowest_enclosing


def select_findings(findings: DataFrame, file_part: str | None = None, **equal) -> DataFrame:
    """Equality filters and a case-insensitive substring of the file; the substring has no wildcards."""
    for k, v in equal.items():
        if v is not None:
            findings = findings.where(F.col(k) == v)
    return findings.where(contains_ignoring_case(F.col("file"), file_part)) if file_part else findings


def search(findings: DataFrame, text: str, columns=("title", "file", "rule_id", "symbol")) -> DataFrame:
    """Rows in which any of the columns holds the text."""
    return findings.where(reduce(or_, [contains_ignoring_case(F.col(c), text) for c in columns]))


def apply_suppressions(findings: DataFrame, rules: DataFrame, ids: DataFrame, inline: DataFrame) -> DataFrame:
    """Marks findings suppressed by rule, then by id or fingerprint, then by an inline directive.

    ``rules`` has rule_id, ``ids`` has key, ``inline`` has file, rule_id and line.
    A directive counts from the line before a finding to its end; the first
    matching line is reported. The few lines of each distinct place are spread
    out, so directives are met by an equi-join and not by a range.
    """
    by_rule = rules.select("rule_id").distinct().withColumn("_rule", F.lit(True))
    keys = ids.select(F.col("key")).distinct()
    place = ["file", "rule_id", "line_start", "line_end"]
    spread = findings.select(*place).distinct().where("line_end >= greatest(1, line_start - 1)").withColumn("line", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_start") - 1), F.col("line_end"))))
    first = spread.join(inline.select("file", "rule_id", "line").distinct(), ["file", "rule_id", "line"]).groupBy(*place).agg(F.min("line").alias("_line"))
    out = findings.join(by_rule, "rule_id", "left").join(first, place, "left")
    out = out.join(keys.select(F.col("key").alias("id"), F.lit(True).alias("_id")), "id", "left")
    out = out.join(keys.select(F.col("key").alias("fingerprint"), F.lit(True).alias("_fp")), "fingerprint", "left")
    source = F.when(F.col("_rule"), "config_rule").when(F.coalesce("_id", "_fp"), "config_finding").when(F.col("_line").isNotNull(), "inline")
    return out.withColumn("suppression_source", source).withColumn("suppression_line", F.when(F.col("suppression_source") == "inline", F.col("_line"))).drop("_rule", "_id", "_fp", "_line")


def dedupe_first(rows: DataFrame, keys: list[str], *emission) -> DataFrame:
    """The row emitted first of each key; dropDuplicates would take any.

    The plan keeps one row a key and task before the shuffle, so a hot key stays small.
    """
    w = Window.partitionBy(*keys).orderBy(*emission)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlap_suppression(findings: DataFrame, dominating: dict[str, str], keys: list[str]) -> DataFrame:
    """Drops findings of a dominated rule where the dominating one is at the same place.

    ``dominating`` maps the dominated rule to the one that hides it.
    """
    cases = F.create_map(*[F.lit(x) for pair in ((strong, weak) for weak, strong in dominating.items()) for x in pair])
    hidden = findings.where(F.col("rule_id").isin(list(dominating.values()))).select(*keys, cases[F.col("rule_id")].alias("rule_id")).distinct()
    return findings.join(hidden, [*keys, "rule_id"], "left_anti")


def union_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def enclosing_scope(lines: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The narrowest span around each line; of equals the first declared.

    ``lines`` has (key, line_id, line), ``spans`` (key, span_id, start, stop, ord).
    Distinct places meet the blocks that make up the spans by an equi-join, so
    neither a hot file nor many findings on one line multiply.
    """
    found = narrowest_enclosing(lines, spans, key)
    return lines.join(found, [key, "line"], "left").select(key, "line_id", "line", "scope")


def group_inconsistency(endpoints: DataFrame, keys: list[str], guarded: Column) -> DataFrame:
    """Unguarded members of groups of two or more in which another member is guarded.

    Counts are taken per group and joined back, so a huge group isn't held in one window.
    """
    g = endpoints.groupBy(*keys).agg(F.count("*").alias("members"), F.count_if(guarded).alias("n_guarded")).where("members >= 2 and n_guarded between 1 and members - 1")
    return endpoints.where(~guarded).join(g, keys)


def duplicated_pattern(endpoints: DataFrame, keys: list[str], endpoint: str) -> DataFrame:
    """Rows whose pattern two or more distinct endpoints share, with the number of those."""
    g = endpoints.groupBy(*keys).agg(F.count_distinct(endpoint).alias("endpoints")).where("endpoints >= 2")
    return endpoints.join(g, keys)


def middleware_scope(routes: DataFrame, middleware: DataFrame) -> DataFrame:
    """Middleware of the same file that stands before a route and whose mount covers it.

    ``routes`` has (file, route_id, path, line), ``middleware`` (file, mw_id, mount, mw_line).
    A mount is the route's path or one of its beginnings; one that covers all
    has a key of its own. Both that and the order of lines are equalities.
    """
    everything = F.col("mount").isNull() | (F.col("mount") == "*")
    keyed = middleware.withColumn("_mount", F.when(~everything, F.col("mount"))).withColumn("_all", everything)
    own = F.transform(F.coalesce(beginnings(F.col("path")), F.array().cast("array<string>")), lambda p: F.struct(F.lit(False).alias("_all"), p.alias("_mount")))
    for_all = F.array(F.struct(F.lit(True).alias("_all"), F.lit(None).cast("string").alias("_mount")))
    spread = routes.select("*", F.inline(F.concat(for_all, own)))
    text = F.coalesce("_mount", F.lit(""))
    pairs = later_pairs(spread.withColumn("_mount", text), keyed.withColumn("_mount", text), ["file", "_all", "_mount"], "line", "mw_line")
    return pairs.drop("_all", "_mount")


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key isn't cached."""
    return requests.join(cache.select("cache_key"), "cache_key", "left_anti")


SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
