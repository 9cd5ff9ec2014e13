"""How input reaches a handler and where it goes, as columns over facts of its syntax.

``syntax_facts`` lists what a handler has: parameters, attributes of the request
that it reads, calls, their arguments and assignments, in walk order. What those
mean is said by expressions over the lists: ``with_input_flow`` folds the
assignments into the names that input reaches, and filters the arguments by them.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What input may look like.
SCHEMA_PARTS = ("schema", "create", "update", "request", "payload", "dto", "model", "input", "form", "serializer")
FRAMEWORK_TYPES = ("request", "response", "session", "db", "dbsession", "backgroundtasks", "background_tasks", "security", "user", "current_user", "client")
DEPENDENCIES = ("depends(", "security(")
LOOSE_TYPES = ("", "dict", "dict[str, any]", "any", "list", "list[any]")
LOOSE_NAMES = ("data", "payload", "body", "input_data", "params")
SURELY_LOOSE = ("dict", "dict[str, any]")
SCALARS = ("int", "float", "bool", "uuid")
PAYLOAD_READS = ("json", "get_json", "form", "values", "data")
OTHER_READS = ("args", "GET", "query_params")
SCHEMA_CALLS = ("is_valid", "validate", "load")
CHECK_CALLS = ("isinstance", "len", "match", "search")
# Where it must not go. The first are whole words, the second stand anywhere.
SQL_KEYWORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "UNION")
SQL_PARTS = ("FROM", "WHERE", "SELECT", "DELETE", "INSERT", "UPDATE")
SQL_METHODS = ("execute", "raw", "select", "query", "run", "fetch", "all", "get")
SQL_OWNERS = ("cursor", "db", "session", "conn", "connection", "engine", "client", "sql")
SQL_WRAPPERS = ("text", "raw", "literal", "sql")
SHELL_CALLS = ("subprocess.run", "subprocess.popen", "os.system", "os.popen")
CODE_CALLS = ("eval", "exec", "pickle.loads", "yaml.load")

FACTS = {
    "params": "array<struct<line int, name string, type string, default string>>",
    "reads": "array<string>",
    "calls": "array<struct<name string, text string>>",
    "given": "array<struct<text string, nth int, line int, line_end int, names array<string>, ref string, source string, built boolean, at int, at_end int>>",
    "sets": "array<struct<targets array<string>, names array<string>, source string, built boolean, line int, line_end int>>",
}


def any_in(s: Column, parts: tuple[str, ...]) -> Column:
    """Whether any of the parts stands in the string."""
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(s, p))


def any_of(found: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, names)))


def _lower(n: ast.AST | None) -> str:
    return ast.unparse(n).lower().strip() if n is not None else ""


def _names(n: ast.AST) -> list[str]:
    return sorted({x.id for x in ast.walk(n) if isinstance(x, ast.Name)})


def _put_together(n: ast.AST) -> bool:
    """Whether a string is made of parts."""
    if isinstance(n, ast.Call):
        return isinstance(n.func, ast.Attribute) and n.func.attr == "format"
    return isinstance(n, ast.JoinedStr) or isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Mod))


def _is_wrapper(n: ast.AST) -> bool:
    return isinstance(n, ast.Call) and bool(n.args) and _lower(n.func) in SQL_WRAPPERS


def syntax_facts(f: ast.FunctionDef | ast.AsyncFunctionDef) -> dict[str, list]:
    """The lists of FACTS for one function."""
    positional = [*f.args.posonlyargs, *f.args.args]
    defaults = [None] * (len(positional) - len(f.args.defaults)) + f.args.defaults
    pairs = [*zip(positional, defaults), *zip(f.args.kwonlyargs, f.args.kw_defaults)]
    out: dict[str, list] = {k: [] for k in FACTS}
    out["params"] = [{"line": a.lineno, "name": a.arg, "type": _lower(a.annotation), "default": _lower(d)} for a, d in pairs]
    for n in ast.walk(f):
        match n:
            case ast.Attribute(value=ast.Name(id="request")):
                out["reads"].append(n.attr)
            case ast.Assign():
                out["sets"].append({
                    "targets": [t.id for t in n.targets if isinstance(t, ast.Name)], "names": _names(n.value), "source": ast.unparse(n.value),
                    "built": _put_together(n.value) or _is_wrapper(n.value), "line": n.value.lineno, "line_end": n.value.end_lineno,
                })
            case ast.Call():
                text = _lower(n.func)
                out["calls"].append({"name": getattr(n.func, "id", getattr(n.func, "attr", "")), "text": text})
                for nth, a in enumerate(n.args):
                    inner = a.args[0] if _is_wrapper(a) else a
                    out["given"].append({
                        "text": text, "nth": nth, "line": a.lineno, "line_end": a.end_lineno, "names": _names(a), "ref": inner.id if isinstance(inner, ast.Name) else "",
                        "source": ast.unparse(inner), "built": _put_together(inner), "at": inner.lineno, "at_end": inner.end_lineno,
                    })
    return out


def says_sql(s: Column) -> Column:
    return s.rlike(r"(?i)\b(" + "|".join(SQL_KEYWORDS) + r")\b") | any_in(F.upper(s), SQL_PARTS)


def _sink(line: Column, stop: Column, name: str, confidence: str) -> Column:
    return F.struct(line.alias("line"), stop.alias("line_end"), F.lit(name).alias("sink"), F.lit(confidence).alias("confidence"))


def with_input_flow(handlers: DataFrame) -> DataFrame:
    """``handlers`` with has_schema, takes_input, loose and sinks in place of the columns of FACTS."""
    is_own = lambda p: (
        ~p["name"].isin("self", "cls") & ~p["type"].isin(*FRAMEWORK_TYPES) & ~F.lower(p["name"]).isin(*FRAMEWORK_TYPES) & ~any_in(p["default"], DEPENDENCIES)
    )
    h = handlers.withColumn("_own", F.filter("params", is_own))
    by_type = F.exists("_own", lambda p: any_in(p["type"], SCHEMA_PARTS))
    by_call = F.exists("calls", lambda c: c["name"].isin(*SCHEMA_CALLS) | F.contains(c["text"], F.lit("serializer")))
    checked = F.exists("calls", lambda c: F.startswith(c["name"], F.lit("validate_")) | c["name"].isin(*CHECK_CALLS))
    h = h.withColumns({"has_schema": by_type | by_call, "_checked": checked})

    bare = F.filter("_own", lambda p: ~any_in(p["type"], SCHEMA_PARTS) & ~p["type"].isin(*SCALARS) & (p["type"].isin(*LOOSE_TYPES) | F.lower(p["name"]).isin(*LOOSE_NAMES)))
    of_params = F.transform(bare, lambda p: F.struct(p["line"].alias("line"), p["name"].alias("name"), F.when(p["type"].isin(*SURELY_LOOSE), "high").otherwise("medium").alias("confidence")))
    whole = F.struct(F.col("line_start").alias("line"), F.lit("request_payload").alias("name"), F.lit("high").alias("confidence"))
    unread = any_of(F.col("reads"), PAYLOAD_READS) & ~F.col("has_schema") & ~F.col("_checked")
    takes = (F.size(of_params) > 0) | any_of(F.col("reads"), PAYLOAD_READS + OTHER_READS) | F.col("has_schema")
    h = h.withColumns({"loose": F.concat(of_params, F.filter(F.array(whole), lambda _: unread)), "takes_input": takes})

    nothing = F.array().cast("array<struct<name string, line int, line_end int>>")
    start = F.struct(F.transform("_own", lambda p: p["name"]).alias("reached"), nothing.alias("queries"))

    def after(state: Column, s: Column) -> Column:
        """The names that input reaches, and those that hold a query made of it, after one more assignment."""
        read = F.contains(s["source"], F.lit("request."))
        made = ~read & F.arrays_overlap(s["names"], state["reached"]) & s["built"] & says_sql(s["source"])
        reached = F.concat(state["reached"], F.filter(s["targets"], lambda _: read | made))
        own = F.transform(F.filter(s["targets"], lambda _: made), lambda t: F.struct(t.alias("name"), s["line"].alias("line"), s["line_end"].alias("line_end")))
        return F.struct(reached.alias("reached"), F.concat(state["queries"], own).alias("queries"))

    h = h.withColumn("_flow", F.aggregate("sets", start, after))

    def sinks_of(g: Column) -> Column:
        held = F.filter("_flow.queries", lambda q: q["name"] == g["ref"])
        is_query = any_in(g["text"], SQL_METHODS + SQL_OWNERS)
        return F.array_compact(
            F.array(
                F.when(is_query & g["built"] & says_sql(g["source"]), _sink(g["at"], g["at_end"], "sql_query", "high")).when(
                    is_query & (F.size(held) > 0), _sink(F.element_at(held, -1)["line"], F.element_at(held, -1)["line_end"], "sql_query", "high")
                ),
                F.when(any_in(g["text"], SHELL_CALLS), _sink(g["line"], g["line_end"], "subprocess", "high")),
                F.when(g["text"].isin(*CODE_CALLS), _sink(g["line"], g["line_end"], "eval_exec", "high")),
                F.when(F.contains(g["text"], F.lit("redirect")) & (g["nth"] == 0) & ~F.col("_checked"), _sink(g["line"], g["line_end"], "redirect", "medium")),
            )
        )

    arriving = F.filter("given", lambda g: F.arrays_overlap(g["names"], F.col("_flow.reached")))
    h = h.withColumn("sinks", F.flatten(F.transform(arriving, sinks_of)))
    return h.drop("_own", "_checked", "_flow", *FACTS)
