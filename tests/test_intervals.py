"""Range, order and prefix joins against brute force."""

import random

from tidemark.operators import findings, intervals


def test_blocks_make_up_the_range(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a - 1, 45)] + [(5, 100_003), (1 << 20, (1 << 21) + 7), (0, 1 << 30)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", intervals.blocks_of("a", "b").alias("x")).collect()
    for r in rows:
        covered = sorted((x.block << x.level, (x.block + 1) << x.level) for x in r.x)
        assert len({x.level for x in r.x}) * 2 >= len(r.x)
        if r.b < r.a:
            assert covered == []
        else:
            assert covered[0][0] == r.a and covered[-1][1] == r.b + 1 and all(p[1] == q[0] for p, q in zip(covered, covered[1:]))


def test_narrowest_span_of_a_large_file(spark):
    rng = random.Random(2)
    spans = [("big", f"s{i}", (a := rng.randrange(100_000)), a + rng.choice([-1, 0, 3, 50, 4000, 60_000]), i) for i in range(400)] + [("x", "t", 1, 5, 1), ("x", "u", 1, 5, 0), ("y", "n", None, 5, 0)]
    places = [("big", i, rng.randrange(100_200)) for i in range(3000)] + [("x", 1, 5), ("x", 2, 6), ("y", 3, 2), ("z", 4, 1), (None, 5, 1), ("x", 6, None)]
    want = {}
    for f, i, n in places:
        inside = [(s[3] - s[2], s[4], s[1]) for s in spans if s[0] == f and n is not None and s[2] is not None and s[2] <= n <= s[3]]
        want[i, f] = min(inside)[2] if inside else None
    s = spark.createDataFrame(spans, "file string, span_id string, start int, stop int, ord int")
    p = spark.createDataFrame(places, "file string, line_id int, line int")
    got = findings.enclosing_scope(p, s, "file")
    assert {(r.line_id, r.file): r.scope for r in got.collect()} == want and got.count() == len(places)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ">" not in "".join(x for x in plan.splitlines() if "Join" in x)
    assert findings.enclosing_scope(p, s.limit(0), "file").where("scope is null").count() == len(places)


def test_middleware_before_a_route(spark):
    rng = random.Random(3)
    paths = ["/", "", "/a", "/a/b", "/a/b/", "/ab", "//x", "*", "a/b", None, "/a/b/c/d"]
    mounts = [None, "*", "/", "", "/a", "/a/b", "/a/b/c", "a", "//", "/ab"]
    routes = [(rng.choice("fg"), i, rng.choice(paths), rng.randrange(70)) for i in range(150)]
    mw = [(rng.choice("fg"), i, rng.choice(mounts), rng.randrange(70)) for i in range(80)]

    def covers(path, mount):
        return mount in (None, "*") or path is not None and (path == mount or path.startswith(mount + "/"))

    want = sorted((r[0], r[1], m[1]) for r in routes for m in mw if r[0] == m[0] and r[3] > m[3] and covers(r[2], m[2]))
    r = spark.createDataFrame(routes, "file string, route_id int, path string, line int")
    m = spark.createDataFrame(mw, "file string, mw_id int, mount string, mw_line int")
    got = findings.middleware_scope(r, m)
    assert sorted((x.file, x.route_id, x.mw_id) for x in got.collect()) == want and len(want) > 500
    assert "mount" in got.columns and findings.middleware_scope(r, m.limit(0)).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ">" not in "".join(x for x in plan.splitlines() if "Join" in x)
