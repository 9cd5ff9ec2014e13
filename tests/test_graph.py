"""Graphs, reports and configurations against brute force and hand-made cases."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import files, graph, reachability
from tidemark.plans import registry
from tidemark.sources import config, sinks, trees


def all_cycles(pairs, depth):
    nodes = sorted({x for p in pairs for x in p})
    return sorted((c for n in range(2, depth + 1) for c in permutations(nodes, n) if c[0] == min(c) and all((a, b) in pairs for a, b in zip(c, (*c[1:], c[0])))), key=lambda c: (len(c), c))


@pytest.mark.parametrize(("hub", "limit"), [(100_000, 2), (0, 10**6)])
def test_graphs_equal_brute_force(spark, hub, limit):
    """Many small graphs at once; with ``hub`` 0 every node is joined in parts."""
    rng = random.Random(3)
    graphs, rows = {}, []
    for g in range(40):
        nodes = "abcdefg"[: rng.randrange(2, 8)]
        graphs[g] = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(rng.randrange(1, 16))}
        rows += [(g, *p) for p in graphs[g]] * 2
    edges = spark.createDataFrame([*rows, (None, "a", "b"), (1, None, "a")], "g int, src string, dst string").repartition(4).cache()
    got = {}
    for r in reachability.bounded_cycles(edges.where("g is not null and src is not null"), "g", 4, limit, hub).collect():
        got.setdefault(r.g, []).append((r.length, tuple(r.cycle.split("->"))))
    for g, pairs in graphs.items():
        want = all_cycles({p for p in pairs if p[0] != p[1]}, 4)[:limit]
        assert sorted(got.get(g, [])) == [(len(c), c) for c in want]
    strong, weak = {}, {}
    for g, pairs in graphs.items():
        reach = {(a, b) for a, b in pairs}
        near = reach | {(b, a) for a, b in pairs}
        for k in "abcdefg":
            for links in (reach, near):
                links |= {(a, b) for a, x in links if x == k for y, b in links if y == k}
        for a in {x for p in pairs for x in p}:
            same = sorted(b for b in "abcdefg" if b == a or {(a, b), (b, a)} <= reach)
            if len(same) > 1:
                strong[g, a] = same[0]
            weak[f"{g}{a}"] = f"{g}" + min([a, *(b for b in "abcdefg" if (a, b) in near)])
    if hub:
        assert {(r.g, r.module): r.component for r in reachability.strong_components(edges, "g", hub).collect()} == strong
    named = edges.where("g is not null").select(F.concat("g", "src").alias("a"), F.concat("g", "dst").alias("b"))
    got = reachability.connected_components(named, "a", "b", hub).collect()
    assert len(got) == len(weak) and {r.node: r.component for r in got} == weak


def test_long_ring_and_star(spark):
    """A ring of 60 with a chain behind it, and a star, in few rounds."""
    n = 60
    ring = spark.range(n).select(F.lit("r").alias("g"), F.col("id").cast("string").alias("src"), ((F.col("id") + 1) % n).cast("string").alias("dst"))
    chain = spark.range(n, n + 20).select(F.lit("r").alias("g"), F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    got = reachability.strong_components(ring.union(chain), "g").groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in got] == [("0", n)]
    star = spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    line = spark.range(10_000, 10_100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    parts = {r.component: r["count"] for r in reachability.connected_components(star.union(line), "a", "b", hub=1000).groupBy("component").count().collect()}
    assert parts == {0: 5000, 10_000: 101}
    empty = star.limit(0)
    assert reachability.connected_components(empty, "a", "b").count() == 0 and reachability.strong_components(ring.limit(0), "g").count() == 0


def reached(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    far = {}
    for a in out:
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        far[a] = seen
    return far


def test_strong_components_of_sparse_graphs_in_few_rounds(spark, monkeypatch):
    """Three random graphs of little over one edge a node, whose ways are long: a hundred rounds and more if labels alone are spread."""
    rng = random.Random(5)
    rows, strong = set(), {}
    for g in range(3):
        pairs = {(rng.randrange(600), rng.randrange(600)) for _ in range(750)}
        far = reached(pairs)
        rows |= {(g, f"m{a}", f"m{b}") for a, b in pairs}
        for a in far:
            same = [f"m{b}" for b in far[a] if b == a or a in far.get(b, ())]
            if len({*same, f"m{a}"}) > 1:
                strong[g, f"m{a}"] = min(same)
    made, cut = [], reachability.cut
    monkeypatch.setattr(reachability, "cut", lambda df, *spent: made.append(1) or cut(df, *spent))
    got = reachability.strong_components(spark.createDataFrame(sorted(rows), "g int, src string, dst string"), "g").collect()
    assert len(got) == len(strong) > 100 and {(r.g, r.module): r.component for r in got} == strong
    assert len(made) <= 70


def test_lines_between_nations_leave_before_edges_are_compared(spark):
    """One distinct, above both joins with customers."""
    from tidemark.plans import testbed

    sf = "/root/testdata/sf0.001"
    e = testbed.nation_edges(spark, sf)
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Aggregate") < plan.index("Join")
    c = {f"m{r.c_custkey}": r.c_nationkey for r in testbed.read(spark, sf, "customer").collect()}
    want = {(c[r.src], r.src, r.dst) for r in testbed.modules(spark, sf)[1].collect() if r.src in c and c[r.src] == c.get(r.dst)}
    got = [tuple(r) for r in e.select("nation", "src", "dst").collect()]
    assert len(got) == len(want) > 0 and set(got) == want


def test_graphs_full_of_pairs_need_no_strong_components(spark, monkeypatch):
    """Graph 1 has its two cycles after pairs alone, so only graph 2 is searched on; with graph 1 alone nothing is."""
    rows = [(1, a, b) for a, b in ("ab", "ba", "bc", "cb", "cd", "dc", "da")] + [(2, a, b) for a, b in ("ab", "ba", "bc", "ca")]
    edges = spark.createDataFrame(rows * 2, "g int, src string, dst string")
    asked, strong = [], reachability.strong_components

    def counted(part, *more):
        asked.append({r.g for r in part.select("g").distinct().collect()})
        return strong(part, *more)

    monkeypatch.setattr(reachability, "strong_components", counted)
    got = sorted(tuple(r) for r in reachability.bounded_cycles(edges, "g", 4, 2).collect())
    assert got == [(1, "a->b", 2), (1, "b->c", 2), (2, "a->b", 2), (2, "a->b->c", 3)] and asked == [{2}]
    got = sorted(tuple(r) for r in reachability.bounded_cycles(edges.where("g = 1"), "g", 4, 2).collect())
    assert got == [(1, "a->b", 2), (1, "b->c", 2)] and asked == [{2}]


def test_cycles_query_compares_each_line_once(spark, monkeypatch):
    """A hundred pairs fill the report: no distinct of all lines before them, and no strong components."""
    from tidemark.plans import testbed

    sf, asked = "/root/testdata/sf0.001", []
    monkeypatch.setattr(reachability, "strong_components", lambda *a: asked.append(a))
    got = registry.QUERIES["bounded_cycles"](spark, sf).collect()
    assert len(got) == 100 and {r.length for r in got} == {2} and not asked
    e = testbed.imports(spark, sf)
    assert "Aggregate" not in e._jdf.queryExecution().optimizedPlan().toString()
    assert e.distinct().count() == testbed.modules(spark, sf)[1].count()


def test_a_hub_is_dealt_out(spark):
    """A third of all links at one node: no task of the join gets over twice the median."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("low"), (F.col("id") + 100_000).alias("high"))
    heavy = reachability.hubs(rows, "low", 60_000, 1000)
    assert heavy == [0]
    values = rows.select(F.col("low").alias("u")).distinct().withColumn("m", F.lit(1))
    with_conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {k: spark.conf.get(k) for k in with_conf}
    for k, v in with_conf.items():
        spark.conf.set(k, v)
    try:
        joined = reachability.join_values(rows, "low", "high", values, "u", heavy)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 60_000 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_cycles_query_is_the_shortest_of_the_whole_graph(spark):
    sf = "/root/testdata/sf0.001"
    from tidemark.plans import testbed

    pairs = {tuple(r) for r in testbed.modules(spark, sf)[1].collect()}
    got = [r.cycle for r in registry.QUERIES["bounded_cycles"](spark, sf).collect()]
    two = sorted((a, b) for a, b in pairs if a < b and (b, a) in pairs)
    three = sorted((a, b, c) for a, b in pairs if a < b for x, c in pairs if x == b and c > a and c != b and (c, a) in pairs) if len(two) < 100 else []
    assert sorted(got[:100]) == sorted("->".join(c) for c in (two + three)[:100]) or len(two + three) < 100


def test_script_targets(spark):
    paths = spark.createDataFrame([("src/a/x.ts",), ("src/b/index.js",), ("src/b.tsx",), ("lib/y.js",)], "path string")
    asked = [("src/a/x.ts", m) for m in ("../b", "./x", "../../lib/y", "./none", "react/jsx", "@org/kit/deep", "..")]
    got = {r.module: (r.target, r.external) for r in graph.script_targets(spark.createDataFrame(asked, "path string, module string"), paths).collect()}
    assert got == {"../b": ("src/b.tsx", None), "./x": ("src/a/x.ts", None), "../../lib/y": ("lib/y.js", None), "./none": (None, "./none"), "react/jsx": (None, "react"), "@org/kit/deep": (None, "@org/kit"), "..": (None, "..")}


def test_module_targets(spark):
    names = ["app.core.db", "app.core.user", "app.api.user", "app.api.views", "main"]
    modules = spark.createDataFrame([(m, i) for i, m in enumerate(names)], "module string, ord int")
    cases = [
        ("app.api.views", None, "user", 1, "app.api.user", None),  # from . import user
        ("app.api.views", "core.db", "connect", 2, "app.core.db", None),  # from ..core.db import connect
        ("app.api.views", "core", "user", 2, "app.core.user", None),
        ("app.api.views", "none", "x", 1, None, "none"),
        ("main", "app.core.db", "connect", 0, "app.core.db", None),
        ("main", "core", "db", 0, "app.core.db", None),  # a path and a name
        ("main", None, "user", 0, "app.api.user", None),  # of two modules the later
        ("main", "src.app.core.db", "x", 0, "app.core.db", None),  # by the ending
        ("main", "os.path", "join", 0, None, "os"),
        ("main", "", "json", 0, None, "json"),
        ("main", None, None, 0, None, None),
    ]
    schema = "src string, module string, name string, level int"
    imports = spark.createDataFrame([c[:4] for c in cases] * 2, schema)
    got = {tuple(r)[:4]: (r.target, r.external) for r in graph.module_targets(imports, modules).collect()}
    assert got == {c[:4]: c[4:] for c in cases}
    assert graph.module_targets(imports, modules.limit(0)).where("target is not null").count() == 0


def test_framework_coverage(spark):
    imports = spark.createDataFrame([("a", "fastapi"), ("b", "tornado.web"), ("b", "koa"), ("c", "os"), ("d", "flask"), ("e", "Koa"), ("e", "express")], "r string, name string")
    routes = spark.createDataFrame([("a", "fastapi"), ("a", "fastapi"), ("e", "express")], "r string, framework string")
    got = {r.r: (r.n_routes, r.is_analyzed, r.explanation) for r in files.framework_coverage(imports, routes, spark.createDataFrame([(x,) for x in "abcdef"], "r string"), "r").collect()}
    none = "No supported web framework detected (supported: django, express, fastapi, fastify, flask, hono, nestjs, nextjs)"
    assert got == {"a": (2, True, None), "b": (0, False, "koa, tornado detected, not supported"), "c": (0, False, none), "d": (0, False, "no HTTP routes detected"), "e": (1, True, None), "f": (0, False, none)}


def test_config_hash():
    a = config.check({"project": {"name": "x"}, "analysis": {"languages": ["Go", "python"], "include_tests": True}})
    b = config.parse('{"version": 1, "project": {"name": "x"}, "analysis": {"languages": ["python", "go"]}}')
    assert config.config_hash(a) == config.config_hash(b) != config.config_hash(config.check({"project": {"name": "y"}}))
    for bad in ({}, {"project": {"name": "x"}, "more": 1}, {"project": {"name": "x"}, "policy": {"file": "../p"}}, {"project": {"name": "x"}, "output": {"format": "xml"}}, {"version": 2, "project": {"name": "x"}}, {"project": {"name": "x", "z": 1}}):
        with pytest.raises(ValueError):
            config.check(bad)


def test_policy_document(spark):
    text = '{"score": {"max_score": 50}, "categories": {"max_score": {"error_handling": 30}, "warn_delta": {"input_validation": 2}}, "rules": {"forbidden_rules": ["ENT-LOG-002"]}}'
    got = {(r.rule_name, r.kind, r.threshold, r.verdict, r.category) for r in trees.policy(spark, text).collect()}
    assert got == {("max_score", "absolute", 50.0, "fail", None), ("categories.error_handling.max_score", "absolute", 30.0, "fail", "error_handling"), ("categories.input_validation.warn_delta", "delta", 2.0, "warn", "input_validation")}
    assert trees.forbidden_rules(text) == ["ENT-LOG-002"]
    for bad in ('{"categories": {"least": {}}}', '{"rules": {"x": 1}}', '{"more": 1}'):
        with pytest.raises(ValueError):
            trees.policy(spark, bad)


def test_reports(spark):
    rows = [("r", f"f{i}.py", i, "ENT-ERR-001" if i % 2 else "ENT-LOG-002", f"i{i}", "high" if i % 2 else "low", "T", "c1" if i < 3 else "c2") for i in range(20)]
    found = spark.createDataFrame(rows, "repo string, file string, line_start int, rule_id string, id string, severity string, title string, category string")
    report = sinks.validation_report(spark.createDataFrame([("r", 5), ("s", 0)], "repo string, score int"), found).collect()
    assert {(r.repo, r.findings_count, r.findings_by_category) for r in report} == {("r", 20, "c1:3; c2:17"), ("s", 0, "")}
    assert next(r for r in report if r.repo == "r").top_10_rules == "; ".join(["ENT-ERR-001(high)"] * 10)
    text = sinks.change_summary(found, found.limit(0), 3, 5, "fail")
    assert "5/100 (+2)" in text and "Policy: FAIL" in text and text.count("- **") == 15 and "...and 5 more" in text
    assert sinks.markdown_table(found.orderBy("line_start").limit(1), ["file", "severity"]).splitlines()[-1] == "| f0.py | low |"
    assert found.where(files.duplication_excluded(F.col("file"))).count() == 0
