"""Duplicated functions against difflib, all pairs, and hand-made files."""

import random
from difflib import SequenceMatcher

from tidemark.operators import analyzers, duplicates


def test_matching_blocks_equal_difflib():
    rng = random.Random(5)
    for k in range(400):
        n = rng.choice([0, 3, 20, 60, 260, 420])
        a = [rng.choice("abcdefghijklmnop"[: rng.randrange(2, 16)]) + (str(rng.randrange(40)) if rng.random() < 0.3 else "") for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(0, 12)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(3)] = [rng.choice("abcxyz")] * rng.randrange(3)
        want = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        assert duplicates.matched(a, b) == want, k


BODY = """def {name}(items, limit):
    total = {start}
    for item in items:
        if item.{field} > limit:
            total = total + item.{field}
        elif item.{other} == {number}:
            total = total - {number}
        print(item, {extra})
    return total


"""
GUARD = """def {name}({args}):
    {first}
    try:
        return {call}
    except ValueError:
        return None


"""


def source_files(rng):
    out = {}
    for f in range(9):
        text = "import os\n\n"
        for k in range(6):
            text += BODY.format(name=f"f{f}_{k}", start=rng.randrange(2), field=rng.choice(["size", "cost"]), other=rng.choice(["kind", "size"]), number=rng.randrange(4), extra=", ".join(rng.choice(["limit", "7", "len(items)", "'x y'"]) for _ in range(rng.randrange(1, 6))))
        out[f"src/m{f}.py"] = text
    return out


def test_similar_classes_equal_all_pairs(spark):
    rng = random.Random(11)
    files = spark.createDataFrame([(p, "python", t) for p, t in source_files(rng).items()], "path string, language string, content string")
    functions = duplicates.python_signatures(files).cache()
    classes = duplicates.function_classes(duplicates.compared(functions)).cache()
    rows = sorted(classes.collect(), key=lambda r: r.representative)
    for threshold in (0.85, 0.6):
        want = {}
        for i, a in enumerate(rows):
            for b in rows[i + 1 :]:
                if abs(a.node_count // 6 - b.node_count // 6) <= 1 and abs(a.statement_count - b.statement_count) <= 3 and abs(a.node_count - b.node_count) / max(a.node_count, b.node_count) <= 0.35:
                    ratio = SequenceMatcher(None, a.tokens, b.tokens).ratio()
                    if ratio >= threshold:
                        want[tuple(a.representative), tuple(b.representative)] = round(ratio, 9)
        got = {(tuple(r.a), tuple(r.b)): round(r.similarity, 9) for r in duplicates.similar_classes(classes, threshold).collect()}
        assert got == want and len(want) > 30
    clusters, membership = duplicates.function_clusters(functions)
    assert sum(r.members for r in clusters.collect()) == membership.count()


def test_findings_of_duplicates(spark):
    copy = BODY.format(name="count", start=0, field="size", other="kind", number=3, extra="limit")
    other = copy.replace("total", "amount").replace("def count", "def sum_up")
    changed = copy.replace("def count", "def third").replace("print(item, limit)", "print(item, limit, 5)")
    alone = "def lonely(a):\n    'text'\n    with open(a) as f:\n        data = f.read()\n    os.remove(a)\n    return [x.strip() for x in data.splitlines()]\n\n\n"
    guards = {
        "g1.py": GUARD.format(name="g1", args="a", first="x = a.b.c.d[0](1)(2)(3)", call="x"),
        "g2.py": GUARD.format(name="g2", args="a, b, c, d", first="log('one', key=[i for i in a if i not in b and c or d])", call="sorted(a, key=lambda v: v['k'])[1:2]"),
        "g3.py": GUARD.format(name="g3", args="q, w, e, r, t, y, u", first="assert {q: w, e: r, t: y, u: {1, 2, 3}, 'abc': 7.5, 'z': not q}", call="f'{q}{w}' % (e, r)"),
    }
    one = {"a.py": copy, "b.py": other, "c.py": alone, "tests/t.py": copy, "bad.py": "def ("} | guards

    def run(texts):
        df = spark.createDataFrame([(p, "python", t) for p, t in texts.items()] + [("n.py", "python", None), ("x.js", "javascript", copy)], "path string, language string, content string")
        return {r.rule_id: r for r in duplicates.duplicate_findings(duplicates.python_signatures(df)).collect()}

    got = run(one)
    assert set(got) == {"ENT-DUP-004", "ENT-DUP-003"}
    r = got["ENT-DUP-004"]
    assert (r.file, r.line_start, r.line_end, r.symbol, r.severity, r.confidence) == ("a.py", 1, 9, "count", "medium", "high") and "100% Match across 2 Files" in r.title
    r = got["ENT-DUP-003"]
    assert (r.file, r.symbol, r.title) == ("g1.py", "g1", "Repeated Boilerplate Pattern Across 3 Functions")
    got = run({"a.py": copy + other})
    assert set(got) == {"ENT-DUP-001"} and got["ENT-DUP-001"].confidence == "high"
    got = run({"a.py": copy + changed})
    assert set(got) == {"ENT-DUP-002"} and (got["ENT-DUP-002"].severity, got["ENT-DUP-002"].confidence) == ("low", "medium")
    got = run({"a.py": copy + changed, "b.py": other})
    assert set(got) == {"ENT-DUP-005"} and got["ENT-DUP-005"].title == "Duplication Cluster: 3 Similar Functions Across 2 File(s)" and got["ENT-DUP-005"].confidence == "medium"
    assert run({"a.py": copy, "c.py": alone}) == {}
    assert [a.analyzer_id for a in analyzers.default_registry().of_category("code_duplication")] == ["duplication"]
