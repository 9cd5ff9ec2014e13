"""Syntax-tree rules on small texts, and a few column functions."""

from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import calibration, graph, python_facts


def rules(text):
    return sorted({(r[1], r[0]) for r in python_facts.logging_and_secrets(text)})


def test_logging_and_secrets():
    code = 'logger.info("x %s", password)\nlog.warning(f"{user.api_key}")\nlogger.info(request)\nlogger.info(password_hash)\napi_key = "aB3dE5gH7jK9mN1p"\napi_key = "changeme-please-now"\nx = os.getenv("DB_PASSWORD", "hunter22")\ny = os.getenv("HOME", "hunter22")\nz = "ghp_abcdefgh1234"\n'
    assert rules(code) == [(1, "ENT-LOG-001"), (2, "ENT-LOG-001"), (3, "ENT-LOG-003"), (5, "ENT-LOG-002"), (7, "ENT-LOG-004"), (9, "ENT-LOG-002")]
    assert python_facts.logging_and_secrets("def (") == []


def test_deferred_imports():
    rows = python_facts.imports("import a\ndef f():\n    import b\nif TYPE_CHECKING:\n    import c\nfrom ..d import e\n")
    assert rows == [("a", 1, False), ("b", 3, True), ("c", 5, True), ("..d", 6, False)]


def test_renamed_copies_have_one_shape():
    a, b = (python_facts.functions(f"def f({x}):\n    y = {x} + 1\n    return y\n")[0] for x in ("p", "q"))
    assert a[6] == b[6] and a[5] == 1


def test_strong_components_and_addresses(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (2, "x", "y")], "g int, src string, dst string")
    assert sorted((r.module, r.component) for r in graph.strong_components(e, "g").collect()) == [("a", "a"), ("b", "a"), ("c", "a")]
    urls = spark.createDataFrame([("git@host.org:a/b.git",), ("https://me:pw@host.org/a/b/",)], "u string").select(t.git_url(F.col("u")).alias("u"), t.sensitive_route(F.lit("/api/admin/x")).alias("s"))
    assert {(r.u, r.s) for r in urls.collect()} == {("https://host.org/a/b", True)}
    rows = spark.createDataFrame([(1, False), (2, False), (8, True), (9, True)], "s int, p boolean")
    assert calibration.bootstrap_interval(rows, "s", "p", 50) == (1.0, 1.0)
