"""Duplicated functions: signatures, a similarity join, clusters and their findings.

Functions of one structure are a class, and classes are compared, never their
members. Two token sequences match in blocks, and no blocks hold more tokens
than both have, so of two sequences that are similar enough each has a prefix,
its rarest tokens first, that shares one with the other's. The prefixes are
exploded and joined by token and size band; what remains is compared exactly.
No pair is lost to that.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import short_hash
from .findings import union_findings
from .python_facts import parse
from .reachability import connected_components, cut

# Thresholds of the comparison, names that keep their meaning, and paths that are not compared.
SIMILARITY = 0.85
EXACT = 0.999
BAND = 6
MOST_STATEMENTS_APART = 3
MOST_PARAMETERS_APART = 2
MOST_NODES_APART = 0.35
LEAST_STATEMENTS = 2
LEAST_NODES = 10
LONGEST_KEPT_STRING = 12
KEPT_NAMES = frozenset(
    (
        "len", "range", "enumerate", "zip", "map", "filter", "sorted", "reversed",
        "int", "float", "str", "bool", "list", "dict", "set", "tuple", "bytes",
        "print", "isinstance", "issubclass", "hasattr", "getattr", "setattr", "delattr",
        "min", "max", "sum", "abs", "round", "any", "all",
        "Exception", "ValueError", "TypeError", "KeyError", "IndexError", "AttributeError",
        "RuntimeError", "FileNotFoundError", "PermissionError", "HTTPException",
        "True", "False", "None", "self", "cls",
    )
)
NOT_COMPARED = ("tests/", "/test/", "test_", "_test.py", "fixtures/", "/fixtures/", "conftest.py", "migrations/", "site-packages", ".venv")
#: Sequences from which on frequent tokens start no block, and their share of the sequence.
LONG = 200
FREQUENT = 100

SIGNATURES = (
    "file string, name string, line_start int, line_end int, column_start int, column_end int, statement_count int, node_count int, parameter_count int,"
    " exact_hash string, tokens array<string>, control_flow array<string>, operators array<string>"
)

COLUMNS = [c.split()[0] for c in SIGNATURES.split(",")]


def _constant(v: object) -> str | None:
    if isinstance(v, (int, float)):
        return f"number {v!r}"
    if v is None:
        return "none"
    if isinstance(v, str):
        return f"word {v}" if len(v) <= LONGEST_KEPT_STRING and v.isidentifier() else "text"
    return None


def _facts(n: ast.AST) -> tuple[str | None, list[str], str | None]:
    """Token, operators and step of control flow that one node stands for."""
    kind = type(n).__name__
    match n:
        case ast.Name():
            return f"name {n.id}" if n.id in KEPT_NAMES else "name", [], None
        case ast.Constant():
            return _constant(n.value), [], None
        case ast.BinOp() | ast.UnaryOp():
            return f"{kind} {type(n.op).__name__}", [type(n.op).__name__], None
        case ast.Compare():
            ops = [type(o).__name__ for o in n.ops]
            return f"{kind} {' '.join(ops)}", ops, None
        case ast.Call():
            called = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else ""
            return f"call {called}", [], None
        case ast.ExceptHandler():
            step = f"except:{n.type.id if isinstance(n.type, ast.Name) else 'any'}"
            return step, [], step
        case ast.If() | ast.For() | ast.While() | ast.Try() | ast.Return() | ast.Raise():
            return kind, [], kind.lower()
    return None, [], None


def _structure(n: ast.AST, names: dict[str, int]) -> Iterator[str]:
    """The node as nested text, its own names numbered as they come."""
    if isinstance(n, ast.Name) and n.id not in KEPT_NAMES:
        yield f"name {names.setdefault(n.id, len(names))}"
        return
    if isinstance(n, ast.Constant):
        yield _constant(n.value) or f"constant {n.value!r}"
        return
    yield f"({type(n).__name__}"
    for field, value in ast.iter_fields(n):
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, ast.AST):
                yield from _structure(v, names)
            elif field not in ("id", "type_comment", "name") or isinstance(n, ast.alias):
                yield f"{field} {v!r}"
    yield ")"


def signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> tuple | None:
    """A row of SIGNATURES without the file; None where the body is a docstring only."""
    body = f.body
    if isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        body = body[1:]
    if not body:
        return None
    parameters = [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs, *filter(None, (f.args.vararg, f.args.kwarg))]
    own = {p.arg: -k for k, p in enumerate(parameters, 1) if p.arg not in ("self", "cls")}
    tokens, operators, control = [], [], []
    count, stack = 1, [f.args, *body]
    stack.reverse()
    while stack:
        n = stack.pop()
        count += 1
        token, ops, step = _facts(n)
        tokens += [token] if token else []
        operators += ops
        control += [step] if step else []
        stack.extend(reversed(list(ast.iter_child_nodes(n))))
    digest = hashlib.sha256()
    names = dict(own)
    for n in (f.args, *body):
        for part in _structure(n, names):
            digest.update(part.encode() + b"\n")
    return f.name, f.lineno, f.end_lineno, f.col_offset, f.end_col_offset, len(body), count, len(own), digest.hexdigest(), tokens, control, operators


def python_signatures(files: DataFrame) -> DataFrame:
    """SIGNATURES of every function of the Python files (path, language, content); files that don't parse give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for path, text in zip(df["path"], df["content"]):
                tree = parse(text) if text else None
                for n in ast.walk(tree) if tree else ():
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        try:
                            row = signature(n)
                        except RecursionError:  # nested too deeply; the other functions count
                            row = None
                        rows += [(path, *row)] if row else []
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.where("language = 'python'").select("path", "content").mapInPandas(run, SIGNATURES)


def compared(functions: DataFrame) -> DataFrame:
    """Functions that are large enough, and not of tests, fixtures, migrations or packages of others."""
    path = F.lower(F.replace("file", F.lit("\\"), F.lit("/")))
    small = (F.col("statement_count") < LEAST_STATEMENTS) | (F.col("node_count") < LEAST_NODES) | (F.col("name") == "__init__") & (F.col("statement_count") <= 2)
    out = functions.where(~small)
    for part in NOT_COMPARED:
        out = out.where(~F.contains(path, F.lit(part)))
    return out


def matched(a: list, b: list) -> int:
    """Tokens in the matching blocks of two sequences.

    The longest block goes first, of equals the earliest in ``a`` and then in
    ``b``, and both sides of it are searched likewise. In a long ``b`` a token
    that makes up over a hundredth starts no block, but extends one.
    """
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    if len(b) >= LONG:
        most = len(b) // FREQUENT + 1
        places = {x: js for x, js in places.items() if len(js) <= most}
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        size, end_a, end_b = 0, a0, b0
        before: dict[int, int] = {}
        for i in range(a0, a1):
            here = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    here[j] = n = before.get(j - 1, 0) + 1
                    if n > size:
                        size, end_a, end_b = n, i + 1, j + 1
            before = here
        start_a, start_b = end_a - size, end_b - size
        while start_a > a0 and start_b > b0 and a[start_a - 1] == b[start_b - 1]:
            start_a, start_b = start_a - 1, start_b - 1
        while end_a < a1 and end_b < b1 and a[end_a] == b[end_b]:
            end_a, end_b = end_a + 1, end_b + 1
        if end_a > start_a:
            total += end_a - start_a
            todo += [(a0, start_a, b0, start_b), (end_a, a1, end_b, b1)]
    return total


def sequence_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ratio: twice the matched tokens over all; two empty sequences are equal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            both = [(list(x), list(y)) for x, y in zip(df[a], df[b])]
            df["ratio"] = [2.0 * matched(x, y) / (len(x) + len(y)) if len(x) + len(y) else 1.0 for x, y in both]
            yield df

    return pairs.mapInPandas(run, T.StructType([*pairs.schema.fields, T.StructField("ratio", T.DoubleType())]))


def _prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """representative and the prefix of its tokens, rarest first; the n-th of equal tokens is a token of its own.

    A sequence of n tokens shares at least t / (2 - t) * n with any that is
    similar enough, so all but that many of its tokens, and one, are enough.
    """
    spread = classes.select("representative", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).groupBy("representative", "n", "token").agg(F.count("*").alias("times"))
    spread = spread.select("representative", "n", "token", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
    rare = spread.groupBy("token", "nth").agg(F.count("*").alias("holders"))
    length = (F.col("n") - F.ceil(F.col("n") * (threshold / (2 - threshold)) - 1e-9) + 1).cast("int")
    ordered = spread.join(rare, ["token", "nth"]).groupBy("representative", "n").agg(F.sort_array(F.collect_list(F.struct("holders", "token", "nth"))).alias("all"))
    return ordered.select("representative", F.inline(F.slice("all", F.lit(1), length))).drop("holders")


def function_classes(functions: DataFrame) -> DataFrame:
    """Functions of one structure as one row: its first member by file, line and name, with how many there are."""
    first = F.min(F.struct("file", "line_start", "name")).alias("representative")
    cols = ("statement_count", "node_count", "parameter_count", "tokens", "operators")
    return functions.groupBy("exact_hash").agg(first, F.count("*").alias("members"), *[F.first(c).alias(c) for c in cols])


def similar_classes(classes: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """a, b, n_a, n_b and similarity of all pairs of classes that are similar enough; a is the first by file, line and name."""
    filled = classes.where(F.size("tokens") > 0)
    keyed = _prefixes(filled, threshold).join(filled.select("representative", F.floor(F.col("node_count") / BAND).alias("band")), "representative")
    left = keyed.select(F.col("representative").alias("x"), "token", "nth", "band", F.lit(0).alias("over"))
    right = keyed.select(F.col("representative").alias("y"), "token", "nth", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("band").alias("own"))
    met = left.join(right, ["token", "nth", "band"]).where((F.col("own") != F.col("band")) | (F.col("x") < F.col("y")))
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda s: filled.select(F.col("representative").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("members", "statement_count", "node_count", "parameter_count", "tokens", "operators")])
    pair = met.join(side("a"), "a").join(side("b"), "b")
    apart = lambda c: F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))
    n_a, n_b = F.size("tokens_a"), F.size("tokens_b")
    near = (
        (apart("statement_count") <= MOST_STATEMENTS_APART)
        & (apart("parameter_count") <= MOST_PARAMETERS_APART)
        & (apart("node_count") / F.greatest("node_count_a", "node_count_b") <= MOST_NODES_APART)
        & ((F.size("operators_a") == 0) | (F.size("operators_b") == 0) | F.arrays_overlap("operators_a", "operators_b"))
        & (2.0 * F.least(n_a, n_b) / (n_a + n_b) >= threshold)
    )
    rated = sequence_ratio(pair.where(near).select("a", "b", F.col("members_a").alias("n_a"), F.col("members_b").alias("n_b"), "tokens_a", "tokens_b"), "tokens_a", "tokens_b")
    return rated.where(F.col("ratio") >= threshold).select("a", "b", "n_a", "n_b", F.col("ratio").alias("similarity"))


def _place(c: str) -> list[Column]:
    return [F.col(f"{c}.file").alias("file"), F.col(f"{c}.line_start").alias("line_start"), F.col(f"{c}.name").alias("name")]


def function_clusters(functions: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(clusters, membership) of functions (SIGNATURES) of equal or similar structure.

    Clusters have representative, members, files, similarity (the mean over all
    pairs of members, 1.0 for pairs that were not compared or not similar),
    is_exact and normalized_size; membership has representative, exact_hash and
    the member's place.
    """
    held = cut(compared(functions))
    classes = cut(function_classes(held))
    pairs = cut(similar_classes(classes, threshold))
    linked = connected_components(pairs.select(F.to_json("a").alias("u"), F.to_json("b").alias("v")), "u", "v").select(F.col("node").alias("key"), "component")
    keyed = classes.withColumn("key", F.to_json("representative")).join(linked, "key", "left").withColumn("component", F.coalesce("component", "key"))
    lost = F.sum((1 - F.col("similarity")) * F.col("n_a") * F.col("n_b"))
    known = pairs.withColumn("key", F.to_json("a")).join(keyed.select("key", "component"), "key").groupBy("component").agg(lost.alias("lost"), F.min("similarity").alias("least"))
    totals = keyed.groupBy("component").agg(F.sum("members").alias("members"), F.min(F.struct("representative", "node_count", "exact_hash")).alias("first")).where("members >= 2")
    members = held.join(keyed.select("exact_hash", "component"), "exact_hash").join(totals.select("component", F.col("first.representative").alias("representative")), "component")
    files = members.groupBy("component").agg(F.count_distinct("file").alias("files"), F.sum(F.xxhash64("file", "line_start", "name").cast("decimal(38,0)")).alias("sign"))
    all_pairs = F.col("members") * (F.col("members") - 1) / 2
    out = totals.join(files, "component").join(known, "component", "left")
    clusters = out.select(
        F.col("first.representative").alias("representative"), "members", "files", F.round(1 - F.coalesce("lost", F.lit(0.0)) / all_pairs, 2).alias("similarity"),
        (F.coalesce("least", F.lit(1.0)) >= EXACT).alias("is_exact"), F.col("first.node_count").alias("normalized_size"),
        short_hash(F.col("first.exact_hash"), F.col("members"), F.col("sign").cast("string")).alias("cluster_id"),
    )
    return clusters, members.select("representative", "exact_hash", "file", "line_start", "line_end", "name")


def boilerplate_patterns(functions: DataFrame, membership: DataFrame) -> DataFrame:
    """Shapes of error handling that three or more functions of two or more files have, counted again without those in clusters."""
    shaped = compared(functions).where((F.size("control_flow") >= 2) & F.exists("control_flow", lambda s: F.contains(s, F.lit("except")))).withColumn("shape", F.array_join("control_flow", ":"))
    common = shaped.groupBy("shape").agg(F.count("*").alias("n"), F.count_distinct("file").alias("f")).where("n >= 3 and f >= 2").select("shape")
    alone = shaped.join(common, "shape", "left_semi").join(membership.select("file", "line_start", "name"), ["file", "line_start", "name"], "left_anti")
    return alone.groupBy("shape").agg(F.min(F.struct("file", "line_start", "name")).alias("representative"), F.count("*").alias("members"), F.count_distinct("file").alias("files")).where("members >= 3")


def duplicate_findings(functions: DataFrame) -> DataFrame:
    """ENT-DUP-001 to 005 of functions (SIGNATURES)."""
    held = cut(functions)
    clusters, membership = function_clusters(held)
    ends = held.select("file", "line_start", "name", "line_end", "column_start", "column_end").dropDuplicates(["file", "line_start", "name"])
    many, across = F.col("members") >= 3, F.col("files") > 1
    percent = F.floor(F.col("similarity") * 100 + 1e-9).cast("string")
    rule = F.when(many, "ENT-DUP-005").when(across, "ENT-DUP-004").when(F.col("is_exact"), "ENT-DUP-001").otherwise("ENT-DUP-002")
    n, f = F.col("members").cast("string"), F.col("files").cast("string")
    title = (
        F.when(many, F.concat(F.lit("Duplication Cluster: "), n, F.lit(" Similar Functions Across "), f, F.lit(" File(s)")))
        .when(across, F.concat(F.lit("Cross-File Structural Duplication in '"), F.col("name"), F.lit("' ("), percent, F.lit("% Match across "), f, F.lit(" Files)")))
        .when(F.col("is_exact"), F.concat(F.lit("Exact Structural Duplication in '"), F.col("name"), F.lit("' (100% Normalized Match)")))
        .otherwise(F.concat(F.lit("Highly Similar Function Implementation in '"), F.col("name"), F.lit("' ("), percent, F.lit("% Structural Match)")))
    )
    grave, sure = many | across, F.col("is_exact")
    found = clusters.select("*", *_place("representative")).withColumn("rule_id", rule).withColumn("title", title)
    found = found.withColumn("severity", F.when(grave, "medium").otherwise("low")).withColumn("confidence", F.when(sure, "high").otherwise("medium")).withColumn("sign", F.col("cluster_id"))
    patterns = boilerplate_patterns(held, membership).select("*", *_place("representative"))
    patterns = patterns.select(
        "file", "line_start", "name", F.lit("ENT-DUP-003").alias("rule_id"), F.concat(F.lit("Repeated Boilerplate Pattern Across "), n, F.lit(" Functions")).alias("title"),
        F.lit("low").alias("severity"), F.lit("medium").alias("confidence"), short_hash(F.col("shape"), F.col("members")).alias("sign"),
    )
    rows = union_findings(found.select(patterns.columns), patterns).join(ends, ["file", "line_start", "name"])
    return rows.select(
        "file", "rule_id", "line_start", "line_end", "column_start", "column_end", "severity", "confidence", F.lit("code_duplication").alias("category"), "title", F.col("name").alias("symbol"),
        short_hash(F.col("rule_id"), F.col("sign"), F.col("file"), F.col("line_start")).alias("id"), short_hash(F.col("rule_id"), F.col("file"), F.col("name"), F.col("sign")).alias("fingerprint"),
    )

