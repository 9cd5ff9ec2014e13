"""Queries over the test tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import calibration, compare, files, findings, graph, history, policy, python_endpoints, scoring
from ..schema import band, pick, severity_rank
from ..streaming import events
from . import testbed as tb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- scoring


@query
def severity_histogram(spark, sf):
    return scoring.severity_histogram(tb.findings(spark, sf), ["repository_id"])


@query
def category_counts(spark, sf):
    return scoring.category_counts(tb.findings(spark, sf), ["repository_id"], list(tb.CATEGORIES))


@query
def rule_penalty(spark, sf):
    return scoring.rule_penalty(tb.findings(spark, sf), ["category", "rule_id"]).withColumn("penalty", F.round("penalty", 6))


def _scores(spark, sf):
    return scoring.category_scores(tb.findings(spark, sf), tb.repo_loc(spark, sf), "repository_id", tb.CATEGORIES)


@query
def category_score(spark, sf):
    return _scores(spark, sf).select("repository_id", "category", "n_findings", F.round("penalty", 6).alias("penalty"), "score")


@query
def overall_score(spark, sf):
    return scoring.overall(_scores(spark, sf), "repository_id")


@query
def overall_with_floor(spark, sf):
    f = tb.findings(spark, sf)
    floors = scoring.severity_floor(f, ["repository_id"], F.col("rule_id").isin("Brand#1", "Brand#2", "Brand#3"), list(tb.CATEGORIES))
    return scoring.overall(_scores(spark, sf), "repository_id", floors)


@query
def severity_floor(spark, sf):
    return scoring.severity_floor(tb.findings(spark, sf), ["repository_id"], F.col("rule_id").isin("Brand#1", "Brand#2", "Brand#3"))


@query
def score_bands(spark, sf):
    return tb.scans(spark, sf).groupBy(band(F.col("score")).alias("band")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query
def worst_category(spark, sf):
    return scoring.worst_category(_scores(spark, sf), "repository_id", scoring.categories(spark, tb.CATEGORIES))


@query
def top_rules(spark, sf):
    return scoring.top_rules(tb.findings(spark, sf)).withColumn("penalty", F.round("penalty", 6))


@query
def top_findings(spark, sf):
    return scoring.top_findings(tb.findings(spark, sf), 20).select("id", "severity", "file", "line_start", "rule_id")


# --- comparison


@query
def finding_lifecycle(spark, sf):
    return compare.lifecycle(*tb.sides(spark, sf))


@query
def multiset_diff(spark, sf):
    return compare.multiset_diff(*tb.sides(spark, sf), ["fingerprint"])


@query
def rule_deltas(spark, sf):
    return compare.rule_deltas(*tb.sides(spark, sf))


@query
def baseline_new(spark, sf):
    return compare.baseline_new(*tb.sides(spark, sf)).select("id", "fingerprint", "rule_id")


@query
def baseline_unchanged(spark, sf):
    return compare.baseline_unchanged(*tb.sides(spark, sf)).select("id", "fingerprint", "rule_id")


@query
def baseline_resolved(spark, sf):
    return compare.baseline_resolved(*tb.sides(spark, sf))


@query
def first_seen(spark, sf):
    return compare.first_seen(tb.findings(spark, sf))


@query
def forbidden_rules(spark, sf):
    return compare.forbidden_rules(tb.findings(spark, sf), ["Brand#3", "Brand#7", "Brand#99"])


# --- history


@query
def history_page(spark, sf):
    return history.page(tb.scans(spark, sf), 2, 25, status="completed").select("scan_id", "repository_id", day("started_at").alias("started_on"), "score")


@query
def recent_scans(spark, sf):
    return history.recent(tb.scans(spark, sf), 10).select("scan_id", day("started_at").alias("started_on"), "status")


@query
def score_trend(spark, sf):
    return history.trend(tb.scans(spark, sf))


@query
def category_trend(spark, sf):
    n = tb.findings(spark, sf).groupBy("scan_id", "category").agg(F.count("*").alias("n_findings"))
    return history.category_trend(tb.scans(spark, sf), n)


@query
def latest_per_key(spark, sf):
    return history.latest_per_key(tb.scans(spark, sf), ["repository_id", "branch"], F.desc("started_at"), F.desc("scan_id")).select("repository_id", "branch", "scan_id", "score")


@query
def current_head(spark, sf):
    return history.current_head(tb.scans(spark, sf), ["repository_id"], ["started_at", "scan_id"]).select("repository_id", "scan_id", "is_current_head")


@query
def resolve_identifier(spark, sf):
    ids = spark.createDataFrame([("7",), ("repo-3",), ("scan-11",), ("nothing",)], "identifier string")
    return history.resolve(ids, tb.scans(spark, sf).withColumn("scan_id", F.col("scan_id").cast("string")))


@query
def page_count(spark, sf):
    return history.page_count(tb.scans(spark, sf), 20, ["status"])


@query
def scan_point_lookup(spark, sf):
    return history.where_all(tb.scans(spark, sf), scan_id=42).select("scan_id", "repository_id", "status", "score")


@query
def upsert_scans(spark, sf):
    s = tb.scans(spark, sf)
    new = s.where("scan_id % 2 = 1 or scan_id % 3 = 0").withColumn("status", F.lit("completed")).withColumn("score", F.col("score") + 1).withColumn("repo_name", F.lit("other"))
    return history.upsert_latest(s.where("scan_id % 2 = 0"), new, "scan_id", ["repository_id", "repo_name"], ["status", "score"])


@query
def upsert_coalesce(spark, sf):
    c = tb.read(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    new = c.where("c_custkey % 2 = 1 or c_custkey % 3 = 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit("NEW")))
    return history.upsert_coalesce(c.where("c_custkey % 2 = 0"), new, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query
def idempotent_insert(spark, sf):
    e = tb.read(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return history.idempotent_insert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


# --- policy


def _metrics(spark, sf):
    """Long metrics of each repository: score, and what is new against the previous side where it has one."""
    scores = scoring.overall(_scores(spark, sf), "repository_id").select("repository_id", F.col("score").cast("double").alias("score"))
    f = tb.findings(spark, sf)
    n = f.groupBy("repository_id").agg(
        F.count_if(F.col("side") != "A").cast("double").alias("r"), F.count_if(F.col("side") == "A").cast("double").alias("a"),
        F.count_if((F.col("side") != "A") & (F.col("severity") == "high")).cast("double").alias("n_new_high"), F.count_if((F.col("side") != "A") & (F.col("severity") == "critical")).cast("double").alias("n_new_critical"),
    )
    wide = scores.join(n, "repository_id").select("repository_id", (F.col("a") > 0).alias("has_baseline"), "score", (F.col("r") - F.col("a")).alias("score_delta"), F.col("r").alias("n_new"), "n_new_high", "n_new_critical")
    return wide.unpivot(["repository_id", "has_baseline"], ["score", "score_delta", "n_new", "n_new_high", "n_new_critical"], "metric", "actual")


@query
def policy_absolute(spark, sf):
    return policy.evaluate(_metrics(spark, sf), policy.policy_rules(spark), "repository_id", "absolute")


@query
def policy_delta(spark, sf):
    return policy.evaluate(_metrics(spark, sf), policy.policy_rules(spark), "repository_id", "delta")


@query
def policy_verdict(spark, sf):
    return policy.verdict(policy.evaluate(_metrics(spark, sf), policy.policy_rules(spark), "repository_id"), "repository_id")


@query
def policy_categories(spark, sf):
    """Thresholds of single categories, on their scores."""
    rules = spark.createDataFrame([("categories.STANDARD.max_score", "absolute", "score", 60.0, "fail", "STANDARD"), ("categories.PROMO.max_score", "absolute", "score", 20.0, "warn", "PROMO")], "rule_name string, kind string, metric string, threshold double, verdict string, category string")
    m = _scores(spark, sf).select("repository_id", "category", F.lit(True).alias("has_baseline"), F.lit("score").alias("metric"), F.col("score").alias("actual"))
    return policy.evaluate(m, rules, "repository_id", by=("category",))


# --- findings


@query
def findings_filter(spark, sf):
    return findings.select_findings(tb.findings(spark, sf), file_part="M3/F1", category="PROMO", severity="high").select("id", "file", "rule_id", "line_start")


@query
def findings_search(spark, sf):
    return findings.search(tb.findings(spark, sf), "RING").select("id", "title", "file")


@query
def apply_suppressions(spark, sf):
    f = tb.findings(spark, sf)
    rules = spark.createDataFrame([("Brand#5",)], "rule_id string")
    ids = f.where("severity = 'critical' and side = 'A'").select(F.col("id").alias("key")).distinct()
    inline = f.where("severity = 'info' and confidence = 'low'").select("file", "rule_id", F.col("line_start").alias("line")).distinct()
    out = findings.apply_suppressions(f, rules, ids, inline)
    return out.groupBy("rule_id", F.coalesce("suppression_source", F.lit("active")).alias("source")).agg(F.count("*").alias("n"), F.min("suppression_line").alias("first_line"))


@query
def dedupe_first(spark, sf):
    return findings.dedupe_first(tb.findings(spark, sf), ["fingerprint"], "scan_id", "line_start", "id").select("fingerprint", "id")


@query
def overlap_suppression(spark, sf):
    f = tb.findings(spark, sf)
    return findings.overlap_suppression(f, {"Brand#1": "Brand#2", "Brand#4": "Brand#3"}, ["file", "line_start"]).groupBy("rule_id").agg(F.count("*").alias("n"))


@query
def union_findings(spark, sf):
    f = tb.findings(spark, sf).select("id", "category", "rule_id")
    return findings.union_findings(*[f.where(F.col("category") == c) for c in tb.CATEGORIES]).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("rule_id").alias("rules"))


@query
def enclosing_scope(spark, sf):
    f = tb.findings(spark, sf)
    spans = f.select("file", F.col("id").alias("span_id"), F.col("line_start").alias("start"), F.col("line_end").alias("stop"), F.col("id").alias("ord"))
    lines = f.select("file", F.col("id").alias("line_id"), F.col("line_start").alias("line")).distinct()
    return findings.enclosing_scope(lines, spans, "file")


@query
def group_inconsistency(spark, sf):
    return findings.group_inconsistency(tb.endpoints(spark, sf), ["file", "route_group"], F.col("guarded")).select("page_id", "file", "route_group", "members", "n_guarded")


@query
def duplicated_pattern(spark, sf):
    return findings.duplicated_pattern(tb.endpoints(spark, sf), ["pattern"], "path").select("page_id", "pattern", "endpoints")


@query
def middleware_scope(spark, sf):
    e = tb.endpoints(spark, sf)
    mw = e.select("file", F.col("page_id").alias("mw_id"), F.when(F.col("method") == "POST", F.col("path")).otherwise(F.col("route_group")).alias("mount"), F.col("line").alias("mw_line"))
    return findings.middleware_scope(e.select("file", F.col("page_id").alias("route_id"), "path", "line"), mw).select("file", "route_id", "mw_id")


# --- files and text


@query
def language_counts(spark, sf):
    return files.language_counts(tb.files(spark, sf))


def _disposed(spark, sf):
    return tb.files(spark, sf).withColumn("disposition", files.disposition(F.col("path"), F.col("size"), F.col("content")))


@query
def file_disposition(spark, sf):
    return _disposed(spark, sf).select("path", "disposition")


@query
def manifest_summary(spark, sf):
    return files.manifest(_disposed(spark, sf), ["repository_id"])


@query
def directory_rollup(spark, sf):
    return files.directory_rollup(tb.files(spark, sf))


@query
def scope_exclusion(spark, sf):
    return tb.files(spark, sf).select("path", files.scope_excluded(F.col("path")).alias("excluded"))


@query
def path_exclusions(spark, sf):
    p = F.col("path")
    return tb.files(spark, sf).select("path", files.duplication_excluded(p).alias("no_duplication"), files.architecture_excluded(p).alias("no_architecture"))


@query
def search_files(spark, sf):
    return files.search_files(tb.files(spark, sf), "SRC/", "Go").select("path", "language")


@query
def detect_language(spark, sf):
    return tb.files(spark, sf).select("path", t.language_of(F.col("path")).alias("detected"))


@query
def language_coverage(spark, sf):
    return files.language_coverage(tb.files(spark, sf), ["python", "javascript", "go"], ["repository_id"])


@query
def line_counts(spark, sf):
    ls = files.lines(tb.files(spark, sf), ["path"])
    return ls.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("line") == "").alias("blank"), F.max(F.length("line")).alias("longest"))


@query
def snippets(spark, sf):
    return tb.files(spark, sf).select("path", t.short_hash(files.snippet(F.col("content"), F.lit(2), F.lit(3), 1, 1)).alias("snippet_hash"))


@query
def fingerprints(spark, sf):
    f = tb.findings(spark, sf)
    return f.select("id", t.short_hash(F.col("rule_id"), F.col("file"), F.col("symbol"), F.col("category")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))


@query
def json_extract(spark, sf):
    e = tb.read(spark, sf, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return e.select("event_id", k.alias("k")).groupBy((F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query
def sarif_levels(spark, sf):
    f = tb.findings(spark, sf)
    return f.groupBy(pick(F.col("severity"), findings.SARIF_LEVEL, "none").alias("level"), "rule_id").agg(F.count("*").alias("n"), F.min(severity_rank(F.col("severity"))).alias("top_rank"))


@query
def route_groups(spark, sf):
    return tb.endpoints(spark, sf).groupBy("route_group").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))


@query
def public_endpoint(spark, sf):
    return tb.handlers(spark, sf).select("page_id", python_endpoints.is_public().alias("is_public"))


# --- secrets


def _assignments(spark, sf):
    d = tb.read(spark, sf, "documents")
    found = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r'token = "([0-9a-f]+)"'), F.lit(1))).alias("value"))
    return found.withColumn("bits", t.bits_per_char(F.col("value")))


@query
def bits_per_char(spark, sf):
    return _assignments(spark, sf).select("doc_id", "value", F.round("bits", 6).alias("bits"))


@query
def secret_candidates(spark, sf):
    return _assignments(spark, sf).where(t.is_secret(F.lit("token"), F.col("value"), F.col("bits"))).select("doc_id", "value")


@query
def mask_secret(spark, sf):
    return _assignments(spark, sf).select("doc_id", t.mask(F.col("value")).alias("masked"))


@query
def redact_secrets(spark, sf):
    d = tb.read(spark, sf, "documents")
    return d.select("doc_id", F.substring(F.sha2(t.redact(F.col("text")), 256), 1, 16).alias("redacted_hash"))


# --- duplicates and graphs


def _functions(spark, sf):
    d = tb.read(spark, sf, "documents")
    return d.select("doc_id", F.col("source").alias("file"), F.substring(F.sha2("text", 256), 1, 16).alias("exact_hash"), F.col("n_chars").alias("size"), "lang", F.size(t.lines_of(F.col("text"))).alias("statements"))


@query
def exact_duplicates(spark, sf):
    return graph.exact_duplicates(_functions(spark, sf), "exact_hash", "doc_id")


@query
def similar_candidates(spark, sf):
    return graph.similar_candidates(_functions(spark, sf), "size", "doc_id", ["lang", "statements"])


@query
def size_class_members(spark, sf):
    return graph.size_class_members(_functions(spark, sf), "size", "doc_id", ["lang", "statements"])


@query
def length_bound_pairs(spark, sf):
    return graph.length_bound_pairs(_functions(spark, sf), "size", "doc_id", ["lang", "statements"])


@query
def connected_components(spark, sf):
    return graph.connected_components(graph.exact_duplicates(_functions(spark, sf), "exact_hash", "doc_id"), "representative", "member")


@query
def cluster_summary(spark, sf):
    f = _functions(spark, sf)
    pairs = graph.exact_duplicates(f, "exact_hash", "doc_id").select(F.col("representative").alias("a"), F.col("member").alias("b"), F.lit(1.0).alias("similarity"))
    low = f.groupBy("exact_hash").agg(F.min("doc_id").alias("component"), F.count("*").alias("n")).where("n >= 2")
    members = f.join(low, "exact_hash").select("component", F.col("doc_id").alias("node"), "file", F.col("doc_id").alias("name"), F.lit(1).alias("line_start"))
    return graph.cluster_summary(members, pairs)


@query
def boilerplate(spark, sf):
    f = _functions(spark, sf).withColumn("shape", F.concat_ws("-", "lang", "statements"))
    dup = graph.exact_duplicates(f, "exact_hash", "doc_id")
    clustered = dup.select(F.col("member").alias("node")).union(dup.select("representative")).distinct()
    return graph.boilerplate(f, "shape", "doc_id", "file", clustered)


@query
def module_degrees(spark, sf):
    return graph.degrees(*tb.modules(spark, sf))


@query
def bounded_cycles(spark, sf):
    """The report of one repository's module graph; no SQL searches cycles of ten modules, so tests hold it against brute force."""
    return graph.bounded_cycles(tb.imports(spark, sf).withColumn("repository", F.lit("all")), "repository")


@query
def short_cycles(spark, sf):
    """Cycles of up to four modules inside a nation."""
    return graph.bounded_cycles(tb.nation_edges(spark, sf), "nation", depth=4)


@query
def strong_components(spark, sf):
    return graph.strong_components(tb.nation_edges(spark, sf), "nation")


@query
def layer_violations(spark, sf):
    m, e = tb.modules(spark, sf)
    return graph.layer_violations(e, m)


@query
def cross_layer_coupling(spark, sf):
    m, e = tb.modules(spark, sf)
    return graph.cross_layer_coupling(e, m)


@query
def dominant_pattern(spark, sf):
    m, e = tb.modules(spark, sf)
    return graph.dominant_pattern(m, e)


@query
def central_config(spark, sf):
    return graph.central_config(*tb.modules(spark, sf))


@query
def god_objects(spark, sf):
    return graph.god_objects(tb.findings(spark, sf), "file", "symbol", "category", 10, 3)


@query
def module_edges(spark, sf):
    line = tb.read(spark, sf, "lineitem")
    imports = line.select(F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("l_partkey") % 300).cast("string")).alias("name"))
    part = tb.read(spark, sf, "part")
    aliases = part.select(F.concat(F.lit("n"), (F.col("p_partkey") % 250).cast("string")).alias("name"), F.concat(F.lit("m"), (F.col("p_partkey") % 90).cast("string")).alias("module"), F.col("p_partkey").alias("ord"))
    return graph.module_edges(imports, aliases)


@query
def layer_inference(spark, sf):
    return tb.files(spark, sf).groupBy(graph.layer_of(F.col("path")).alias("layer"), "language").agg(F.count("*").alias("n"))


# --- calibration


@query
def roc_auc(spark, sf):
    return calibration.roc_auc(tb.labelled(spark, sf), "score", "positive", ["lang"])


@query
def score_distribution(spark, sf):
    return calibration.distribution(tb.labelled(spark, sf), "score", ["lang"])


@query
def rule_precision(spark, sf):
    lab = tb.labelled(spark, sf).withColumn("label", F.when(F.col("toxic") == 1, "unsure").when(F.col("quality") == 1, "true_positive").otherwise("false_positive"))
    return calibration.precision(lab, "source", "label")


@query
def class_separation(spark, sf):
    return calibration.separation(tb.labelled(spark, sf), "score", "positive")


# --- events and ignore rules


@query
def event_dedupe(spark, sf):
    return events.dedupe(tb.read(spark, sf, "events"), ["user_id", "event_type"])


@query
def event_daily_counts(spark, sf):
    return events.daily_counts(tb.read(spark, sf, "events"))


@query
def cache_misses(spark, sf):
    """All events ask by their user; what users bought from is cached."""
    e = tb.read(spark, sf, "events").select("event_id", "event_type", findings.cache_key(F.col("user_id").cast("string")).alias("cache_key"))
    return findings.cache_misses(e, e.where("event_type = 'purchase'")).select("event_id", "cache_key")


@query
def inline_directives(spark, sf):
    """Test texts have no directives, so each line that opens a licence stands for one."""
    ls = files.lines(tb.files(spark, sf).withColumnRenamed("path", "file"), ["file"])
    as_comment = F.when(F.startswith("line", F.lit("Licensed under")), F.concat(F.lit("# tidemark:ignore ENT-LOG-"), F.length("line").cast("string"), F.lit(", ENT-ERR-001"))).otherwise(F.col("line"))
    return files.inline_directives(ls.withColumn("line", as_comment))


@query
def gitignore_last_match(spark, sf):
    patterns = ["*.md", "/src1/", "node_modules/", "!f1*.md", "tests/**/f2*", "src[2-4]/api/"]
    return tb.files(spark, sf).select("path", files.ignored(F.col("path"), patterns).alias("is_ignored"))

