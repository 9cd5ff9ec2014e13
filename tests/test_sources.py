"""Real trees on disk: discovery, line rules, syntax-tree rules, sinks, streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import duplicates, files, findings, graph, line_rules, python_facts
from tidemark.sources import sinks, trees
from tidemark.streaming import events

CODE = {
    "app/main.py": "import os\nfrom typing import TYPE_CHECKING\ntry:\n    x = 1\nexcept:\n    pass\ntry:\n    y = 2\nexcept Exception:\n    z = 3\n\ndef f(a, b):\n    try:\n        return a\n    except ValueError:\n        return None\n",
    "app/bad.py": "def broken(:\n",
    "app/server.go": 'package x\n// db.Query("a" + b)\nfunc f() { db.Query("select " + id) }\n/* exec.Command("sh", "-c", x)\n*/\ncfg := tls.Config{InsecureSkipVerify: true}\n',
    "app/view.ts": "// @ts-ignore\nconst a = body as any\n",
    "app/x.c": 'scanf("%s", b);\nscanf("%10s", b);\nstrcpy(a, b);\n',
    "node_modules/p/i.js": "eval(x)\n",
    "tests/test_a.py": "x = 1\n",
    "logo.png": "\x89",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in CODE.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    (root / "app/nul.py").write_bytes(b"a\0b")
    return root


def test_discovery(spark, tree):
    got = {r.path: r.disposition for r in trees.source_files(trees.directory(spark, str(tree))).collect()}
    assert got["app/main.py"] == "analyzable" and got["node_modules/p/i.js"] == "ignored_directory" and got["logo.png"] == "binary_extension"
    assert got["tests/test_a.py"] == "scope_excluded" and got["app/nul.py"] == "binary_content"


def test_line_rules(spark, tree):
    src = trees.source_files(trees.directory(spark, str(tree))).where("disposition = 'analyzable'")
    got = sorted((r.file, r.line_start, r.rule_id) for r in line_rules.find(src).collect())
    assert got == [
        ("app/server.go", 3, "ENT-GO-001"), ("app/server.go", 6, "ENT-GO-002"), ("app/view.ts", 1, "ENT-TS-002"), ("app/view.ts", 2, "ENT-TS-001"), ("app/x.c", 1, "ENT-C-002"), ("app/x.c", 3, "ENT-C-001"),
    ]


def test_python_rules(spark, tree):
    src = trees.source_files(trees.directory(spark, str(tree)))
    got = sorted((r.line_start, r.rule_id) for r in python_facts.python_error_handling(src).collect())
    assert got == [(5, "ENT-ERR-001"), (5, "ENT-ERR-003"), (9, "ENT-ERR-002"), (9, "ENT-ERR-004"), (15, "ENT-ERR-005")]
    (f,) = python_facts.python_functions(src).collect()
    assert (f.name, f.parameter_count, f.line_start) == ("f", 2, 12)
    assert {r.name for r in python_facts.python_imports(src).collect()} == {"os", "typing"}


def test_archive(spark, tmp_path):
    for name, entry in (("good.zip", "a/b.py"), ("evil.zip", "../b.py")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(entry, "x = 1\n")
    assert [r.path for r in trees.archive(spark, str(tmp_path / "good.zip")).collect()] == ["a/b.py"]
    with pytest.raises(Exception, match="unsafe archive entry"):
        trees.archive(spark, str(tmp_path / "evil.zip")).collect()


def test_policy_document(spark):
    rows = trees.policy(spark, json.dumps({"name": "p", "score": {"max_score": 50}, "findings": {"max_new": 3}})).collect()
    assert sorted((r.rule_name, r.threshold) for r in rows) == [("max_new", 3.0), ("max_score", 50.0)]
    with pytest.raises(ValueError, match="unknown policy key"):
        trees.policy(spark, '{"score": {"max": 1}}')


def test_sarif(spark, tree):
    src = trees.source_files(trees.directory(spark, str(tree))).where("disposition = 'analyzable'")
    doc = json.loads(sinks.sarif(line_rules.find(src), "tidemark", "1").first().value)
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 6 and doc["runs"][0]["results"][0]["level"] == "error"


def test_redaction(spark):
    cases = {
        'api_key = "abc"': 'api_key = "[REDACTED_SECRET]"',
        "token: 'it'": "token: '[REDACTED_SECRET]'",
        'token = "[REDACTED_SECRET]"': 'token = "[REDACTED_SECRET]"',
        "ghp_" + "a" * 20: "[REDACTED_SECRET]",
        "Bearer " + "x" * 24: "Bearer [REDACTED_SECRET]",
        "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----": "[REDACTED_PRIVATE_KEY]",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", t.redact(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases


def test_bits_per_char(spark):
    rows = spark.createDataFrame([("aaaa",), ("ab",), ("abcd",), ("",)], "s string").select(t.bits_per_char(F.col("s")).alias("e")).collect()
    assert [r.e for r in rows] == [0.0, 1.0, 2.0, 0.0]


def test_ignore_rules(spark):
    paths = ["a.md", "docs/a.md", "docs/keep.md", "build/x", "x/build/y", "src/a/b.c"]
    pats = ["*.md", "!keep.md", "build/", "/src/**/b.?"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.ignored(F.col("p"), pats).alias("i")).collect()
    assert {r.p: r.i for r in rows} == {"a.md": True, "docs/a.md": True, "docs/keep.md": False, "build/x": True, "x/build/y": True, "src/a/b.c": True}


def test_discover(spark):
    code = b"x = 1\ny = 2\n"
    cases = {
        ".gitignore": (b"*.log.py\nout_*/\n# no rule\n\n!keep.log.py\n", "unrecognized_language"),
        "a/.gitignore": (b"/b.py\n!a.log.py\n", "unrecognized_language"),
        "a/b.py": (code, "gitignored"), "a/c/b.py": (code, "analyzable"), "b.py": (code, "analyzable"),
        "a/a.log.py": (code, "analyzable"), "a.log.py": (code, "gitignored"), "x/keep.log.py": (code, "analyzable"),
        "out_1/z.py": (code, "gitignored"), "out_1/keep.log.py": (code, "gitignored"), "out_2.py": (code, "analyzable"),
        "node_modules/i.js": (code, "ignored_directory"), "l.py": (code, "symlink_ignored"), "m.min.js": (code, "ignored_pattern"), "p.PNG": (code, "binary_file"), "v.svg": (code, "binary_file"), "yarn.lock": (code, "ignored_pattern"),
        "n.py": (None, "unreadable_file"), "nul.py": (b"a\0b", "binary_content_detected"), "latin.py": (b"\xe9", "unsupported_encoding_or_unreadable"),
        "tests/t.py": (code, "scope_exclusion"), "gen/g.py": (code, "custom_exclude"), "g.pb.py": (code, "custom_exclude"), "s.go": (code, trees.NO_ANALYZER),
    }
    rows = [(1, p, len(raw or b""), raw, p == "l.py") for p, (raw, _) in cases.items()] + [(2, "a.log.py", 3, b"x\n", None), (1, "big.py", 3 << 20, code, False), (None, None, None, None, None)]
    tree = spark.createDataFrame(rows, "repo int, path string, size long, raw binary, is_symlink boolean")
    out = trees.discover(tree, ("repo",), custom_exclusions=("gen", "*.pb.py")).collect()
    assert {r.path: r.disposition for r in out if r.repo == 1} == {p: d for p, (_, d) in cases.items()} | {"big.py": "file_size_exceeds_limit"}
    assert [r.disposition for r in out if r.repo == 2] == ["analyzable"] and len(out) == len(rows)
    assert next(r.line_count for r in out if r.path == "b.py") == 2
    loose = trees.discover(tree.where("repo = 1"), respect_gitignore=False, include_tests=True).collect()
    assert {r.path for r in loose if r.disposition == "analyzable"} >= {"a/b.py", "tests/t.py", "gen/g.py"}
    assert trees.discover(tree.limit(0)).count() == 0


def test_similarity_ratio(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"])], "a array<string>, b array<string>")
    assert duplicates.sequence_ratio(df, "a", "b").first().ratio == pytest.approx(0.8)


def test_inline_suppression(spark):
    f = spark.createDataFrame([("1", "p", "f.py", "R-1", 5, 6), ("2", "q", "f.py", "R-2", 5, 6), ("3", "r", "g.py", "R-1", 9, 9)], "id string, fingerprint string, file string, rule_id string, line_start int, line_end int")
    none = spark.createDataFrame([], "rule_id string")
    ids = spark.createDataFrame([("r",)], "key string")
    inline = spark.createDataFrame([("f.py", "R-1", 4), ("f.py", "R-1", 6), ("f.py", "R-2", 7)], "file string, rule_id string, line int")
    got = {r.id: (r.suppression_source, r.suppression_line) for r in findings.apply_suppressions(f, none, ids, inline).collect()}
    assert got == {"1": ("inline", 4), "2": (None, None), "3": ("config_finding", None)}


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = events.dedupe_stream(stream, ["event_id"]).writeStream.format("memory").queryName("deduped").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("deduped").count() == batch.select("event_id").distinct().count()


def test_many_ignore_rules_equal_brute_force(spark):
    import random
    import re

    rng = random.Random(9)
    names = ["a", "b.py", "c.o", "build", "x.tar.gz", ".env", "lib", "[odd", "d.PY"]
    lines = ["*.py", "!b.py", "build/", "/lib", "a/*.o", "**/build", "x.*", "*.tar.gz", "lib/**", "?.o", "[bc].*", "!build/", "a/**/c.o", ".env", "/*", "!/a", "[odd", "# x", "", "*.[po]*", "b.p?", "!x.tar.gz", "a/b.py/"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(250)})
    folders = sorted({p.rsplit("/", 1)[0] for p in paths if "/" in p})
    rules = {"": rng.sample(lines, 9), **{d: rng.sample(lines, 4) for d in rng.sample(folders, 12)}}
    rows = [(1, p, None) for p in paths] + [(1, f"{d}/.gitignore".lstrip("/"), "\n".join(r)) for d, r in rules.items()] + [(2, p, None) for p in paths]

    def out(place):
        found = None
        parts = place.rstrip("/").split("/")
        for k in range(len(parts)):
            base = "/".join(parts[:k])
            inner = place[len(base) + 1 :] if base else place
            for line in rules.get(base, ()):
                if line and not line.startswith("#"):
                    regex, negated = files.ignore_regex(line)
                    if re.search(regex, inner):
                        found = not negated
        return bool(found)

    everything = {p for r, p, _ in rows if r == 1}
    want = {p for p in everything if out(p) or any(out("/".join(p.split("/")[:k]) + "/") for k in range(1, p.count("/") + 1))}
    got = files.ignored_by_files(spark.createDataFrame(rows, "repo int, path string, content string"), ["repo"])
    assert {(r.repo, r.path) for r in got.collect()} == {(1, p) for p in want} and 20 < len(want) < len(everything)
