"""Hand-computed cases of the scoring formulas."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import calibration, compare, history, policy, scoring
from tidemark.schema import band


def unit_findings(spark, n):
    return spark.range(n).select(F.lit("r").alias("rule_id"), F.lit("low").alias("severity"), F.lit("high").alias("confidence"))


@pytest.mark.parametrize(("n", "want"), [(20, 20.0), (21, 23.465735903), (4000, 61.446441600)])
def test_rule_penalty(spark, n, want):
    assert scoring.rule_penalty(unit_findings(spark, n), ["rule_id"]).first().penalty == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("penalty", "loc", "want"), [(0.0, 10, 0.0), (1.0, 1000, 2.469009), (7.0, 1000, 16.054298), (5.6, 1000, 13.064176), (10.0, 199, 71.349520), (10.0, 200, 71.349520), (10.0, 201, 71.170791)])
def test_density(spark, penalty, loc, want):
    assert spark.range(1).select(scoring.density_score(F.lit(penalty), F.lit(loc)).alias("s")).first().s == pytest.approx(want, abs=1e-5)


def test_bands(spark):
    rows = spark.createDataFrame([(x,) for x in (20, 21, 40, 41, 60, 61, 80, 81)], "s int").select(band(F.col("s")).alias("b")).collect()
    assert [r.b for r in rows] == ["very_low", "low", "low", "moderate", "moderate", "high", "high", "very_high"]


def test_half_even(spark):
    scores = spark.createDataFrame([(1, 2.5, 1.0, 0), (2, 3.5, 1.0, 0)], "r int, score double, weight double, n_findings int")
    assert {r.r: r.score for r in scoring.overall(scores, "r").collect()} == {1: 2, 2: 4}


def finding_rows(spark, keys):
    return spark.createDataFrame([(k, i, i, f"{k}{i}", "low") for i, k in enumerate(keys)] or [("none", 0, 0, "", "low")], "fingerprint string, line_start int, line_end int, id string, severity string").where("fingerprint != 'none'")


def test_lifecycle(spark):
    rows = compare.lifecycle(finding_rows(spark, "xz"), finding_rows(spark, "xxy")).collect()
    assert sorted((r.fingerprint, r.state) for r in rows) == [("x", "persistent"), ("x", "resolved"), ("y", "resolved"), ("z", "new")]


@settings(max_examples=8, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_lifecycle_counts(spark, cur, prev):
    rows = compare.lifecycle(finding_rows(spark, cur), finding_rows(spark, prev)).collect()
    n = lambda s: sum(r.state == s for r in rows)
    assert n("new") - n("resolved") == len(cur) - len(prev)
    assert n("new") + n("persistent") == len(cur)


@pytest.mark.parametrize("hot_rows", [3, 100_000])
def test_occurrences_of_a_hot_fingerprint(spark, hot_rows):
    rows = [("hot", i % 3 or None, 3, f"{i * 7919 % 97:02x}{i}", "low") for i in range(60)] + [("hot", 1, 3, None, "low"), ("cold", 2, 2, "a", "low"), *((None, 1, 1, f"b{i}", "low") for i in range(5))]
    df = spark.createDataFrame(rows, "fingerprint string, line_start int, line_end int, id string, severity string")
    first = lambda v: (v is not None, v or 0 if not isinstance(v, str) else v)
    want = {}
    for f in ("hot", "cold", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == f), key=lambda r: (first(r[1]), first(r[2]), (r[3] is not None, r[3] or "")))):
            want[f, r[3]] = n + 1
    assert {(r.fingerprint, r.id): r.occurrence for r in compare.occurrences(df, compare.hot_fingerprints(hot_rows, df)).collect()} == want
    same = compare.lifecycle(df, df.where("fingerprint is not null"), hot_rows).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in same} == {"persistent": 62, "new": 5}


def test_current_head(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (None, 1, "d"), (None, None, "e")], "r int, t int, id string")
    out = history.current_head(rows, ["r"], ["t", "id"])
    assert out.columns == ["r", "t", "id", "is_current_head"]
    assert {r.id for r in out.collect() if r.is_current_head} == {"c", "d"} and out.count() == 5
    assert history.current_head(rows.limit(0), ["r"], ["t", "id"]).count() == 0


def test_auc(spark):
    rows = spark.createDataFrame([("g", 2, True), ("g", 1, True), ("g", 1, False), ("g", 0, False), ("h", 3, True)], "k string, s int, p boolean")
    assert {r.k: r.auc for r in calibration.roc_auc(rows, "s", "p", ["k"]).collect()} == {"g": 0.875, "h": 0.5}


def test_policy_edges(spark):
    metrics = spark.createDataFrame([(1, "score", 80.0, True), (2, "score", 80.5, True), (3, "score_delta", 9.0, False), (4, "score_delta", None, True)], "k int, metric string, actual double, has_baseline boolean")
    rules = policy.policy_rules(spark)
    out = {(r.k, r.rule_name): r.status for kind in ("absolute", "delta") for r in policy.evaluate(metrics, rules, "k", kind).collect()}
    assert out[1, "max_score"] == "pass" and out[2, "max_score"] == "fail"
    assert out[3, "max_delta"] == "not_applicable" and out[4, "max_delta"] == "pass"


def test_partitioning_does_not_matter(spark):
    f = unit_findings(spark, 500)
    a, b = (scoring.rule_penalty(f.repartition(n), ["rule_id"]).first().penalty for n in (1, 8))
    assert math.isclose(a, b)


def test_floor_trigger(spark):
    rows = [
        ("ENT-LOG-002", "high", "", "", ""), ("ENT-LOG-002", "low", "", "", ""), ("ENT-AUTH-001", "high", "x", "an admin route", "delete_it"), ("ENT-AUTH-001", "high", "x", "an admin route", "show"),
        ("ENT-INPUT-003", "high", "SQL built", "", ""), ("ENT-INPUT-003", "high", "redirect", "", ""), ("ENT-ERR-001", "high", "sql", "admin", "delete"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, rule_id string, confidence string, title string, description string, symbol string")
    assert [r.i for r in df.where(scoring.floor_trigger()).orderBy("i").collect()] == [0, 2, 4]


def test_floor_counts_active_categories_and_files_in_scope(spark):
    rows = [("r", "a", "src/a.py", "critical", "high"), ("r", "b", "src/a.py", "critical", "high"), ("r", "a", "tests/a.py", "critical", "high"), ("s", "a", "src/a.py", "high", "high"), ("t", "a", "src/a.py", "high", "medium")]
    df = spark.createDataFrame(rows, "repo string, category string, file string, severity string, confidence string")
    floors = scoring.severity_floor(df, ["repo"], F.lit(True), ["a"])
    assert {r.repo: r.floor for r in floors.collect()} == {"r": 61, "s": 41, "t": 0}
    scores = spark.createDataFrame([("r", 10.0, 1.0, 1), ("s", 90.0, 1.0, 1), ("u", 5.0, 1.0, 0)], "repo string, score double, weight double, n_findings int")
    assert {r.repo: (r.score, r.band) for r in scoring.overall(scores, "repo", floors).collect()} == {"r": (61, "high"), "s": (90, "very_high"), "u": (5, "very_low")}


def test_first_rows_are_limited_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import findings, history

    df = spark.range(100).withColumn("k", F.col("id") % 3)
    for out in (findings.dedupe_first(df, ["k"], "id"), history.latest_per_key(df, ["k"], F.desc("id"))):
        lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()
        assert sum("WindowGroupLimit" in x for x in lines) == 2 and out.count() == 3
