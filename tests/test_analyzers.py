"""The analyzer registry, structure counts, webhooks and states on hand-made rows."""

import hashlib
import hmac
import json

from tidemark.operators import analyzers, history, line_rules, python_facts
from tidemark.sources import sinks
from tidemark.streaming import events

PY = """import os, sys
from a import b

class C:
    def f(self):
        try:
            os.getcwd()
        except:
            raise ValueError(1)
"""


def test_registry_keeps_failures_apart(spark):
    files = spark.createDataFrame([("a.py", "python", PY), ("b.go", "go", 'db.Query("SELECT " + x)\n'), ("c.py", "python", "def (")], "path string, language string, content string")
    registry = analyzers.default_registry()
    found, failed = registry.run_all(files)
    assert failed == {} and {(r.file, r.rule_id) for r in found.collect()} == {("a.py", "ENT-ERR-001"), ("b.go", "ENT-GO-001")}
    assert all(r.id and r.fingerprint for r in found.collect())

    def broken(_):
        raise RuntimeError("no")

    registry.add(analyzers.Analyzer("lines", "Broken", ("go",), (("X-1", "x"),), broken))
    found, failed = registry.run_all(files, eager=True)
    assert {r.rule_id for r in found.collect()} == {"ENT-ERR-001"} and failed == {"lines": "RuntimeError: no"}
    rules = registry.catalogue(spark).collect()
    assert len(rules) == 35 and {r.analyzer_id for r in rules if r.rule_id == "X-1"} == {"lines"} and [a.analyzer_id for a in registry.of_category("input_validation")] == ["endpoints", "scripts"]


def test_structure(spark):
    files = spark.createDataFrame([("a.py", "python", PY), ("b.py", "python", "def ("), ("e.py", "python", "")], "path string, language string, content string")
    got = {r.file: tuple(r)[1:] for r in python_facts.python_structure(files).collect()}
    assert got == {"a.py": (3, 1, 1, 2, 1, 1), "e.py": (0, 0, 0, 0, 0, 0)}


def test_lines_of_code_and_file_stay_together(spark):
    text = "let a = x as any // y as any\n// @ts-ignore\n/* z as any\n*/ b as any"
    got = sorted((r.rule_id, r.line_start) for r in line_rules.find(spark.createDataFrame([("a.ts", "typescript", text)], "path string, language string, content string")).collect())
    assert got == [("ENT-TS-001", 1), ("ENT-TS-001", 4), ("ENT-TS-002", 2)]


def test_sarif_is_in_order(spark):
    rows = [(f"f{i % 3}.py", i, i, f"i{i}", "R1" if i % 2 else "R2", f"t{i}", "high", f"p{i}", 4, 9) for i in (5, 3, 1, 4, 2, 0)]
    df = spark.createDataFrame(rows, "file string, line_start int, line_end int, id string, rule_id string, title string, severity string, fingerprint string, column_start int, column_end int").repartition(4)
    run = json.loads(sinks.sarif(df, "t", "1").first().value)["runs"][0]
    places = [(x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], x["locations"][0]["physicalLocation"]["region"]["startLine"]) for x in run["results"]]
    assert places == [("f0.py", 0), ("f0.py", 3), ("f1.py", 1), ("f1.py", 4), ("f2.py", 2), ("f2.py", 5)]
    assert [(r["id"], r["shortDescription"]["text"]) for r in run["tool"]["driver"]["rules"]] == [("R1", "t3"), ("R2", "t0")]
    region = run["results"][0]["locations"][0]["physicalLocation"]["region"]
    assert (region["startColumn"], region["endColumn"]) == (5, 10) and run["results"][0]["partialFingerprints"] == {"primary": "p0"}


def test_webhooks(spark):
    def payload(action, **more):
        return json.dumps({"action": action, "repository": {"name": "r", "owner": {"login": "o"}}, "pull_request": {"number": 7, "base": {"sha": "b", "ref": "main"}, "head": {"sha": "h", "ref": "x"}} | more})

    sign = lambda body, key="k": "sha256=" + hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()
    good, closed, bad = payload("opened"), payload("closed"), payload("reopened", head={})
    rows = [(1, "pull_request", good, sign(good)), (2, "push", good, sign(good)), (3, "pull_request", closed, None), (4, "pull_request", bad, sign(bad, "other")), (5, "pull_request", None, "sha256="), (6, "ping", "{}", "sha1=x")]
    df = spark.createDataFrame(rows, "id int, event_name string, payload string, signature string")
    assert {r.id: r.is_signed for r in events.signed(df, "k").collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert not any(r.is_signed for r in events.signed(df, "").collect())
    got = {r.id: (r.owner, r.repo, r.pr_number, r.base_sha, r.head_sha, r.head_branch, r.is_malformed) for r in events.pull_requests(df).collect()}
    assert got == {1: ("o", "r", 7, "b", "h", "x", False), 4: ("o", "r", 7, "b", None, None, True)}


def test_states_and_pairs(spark):
    rows = [(1, "pending", 1), (1, "completed", 5), (1, "scanning", 9), (2, "queued", 3), (2, "pending", 3), (3, "failed", 2), (3, "completed", 4)]
    got = {r.scan_id: (r.status, r.is_final, r.started_at, r.updated_at) for r in events.scan_states(spark.createDataFrame(rows, "scan_id int, status string, ts int")).collect()}
    assert got == {1: ("completed", True, 1, 9), 2: ("queued", False, 3, 3), 3: ("failed", True, 2, 4)}
    scans = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "scan_id int, started_at int")
    pairs = history.order_pairs(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "first_id int, second_id int"), scans)
    assert {tuple(r) for r in pairs.collect()} == {(2, 1), (2, 3), (3, 1)}
