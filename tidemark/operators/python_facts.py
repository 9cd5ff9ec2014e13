"""Facts and error-handling findings of Python files, from their syntax trees.

Files are parsed where they lie, one row each, and never executed. A file that
doesn't parse gives no rows, so one bad file doesn't stop the others.
"""

from __future__ import annotations

import ast
import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import EXACT_PLACEHOLDERS, PLACEHOLDER_PARTS, SAFE_NAME_PARTS, SECRET_PREFIXES, SENSITIVE_NAMES

LOG_METHODS = frozenset("debug info warning warn error exception critical fatal log".split())
BROAD = frozenset(("Exception", "BaseException"))

FUNCTION_SCHEMA = "file string, name string, line_start int, line_end int, statement_count int, node_count int, parameter_count int, exact_hash string, tokens array<string>"
FINDING_SCHEMA = "file string, rule_id string, line_start int, line_end int, severity string, confidence string, category string, title string"
IMPORT_SCHEMA = "file string, name string, line int, is_deferred boolean"
IMPORTED_NAME_SCHEMA = "file string, module string, name string, level int, line int, is_deferred boolean"


def parse(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def shape(node: ast.AST) -> list[str]:
    """Node kinds in walk order; names and values don't count, so renamed copies have one shape."""
    out = []
    for n in ast.walk(node):
        out.append(f"Num:{n.value}" if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) else type(n).__name__)
    return out


def functions(text: str) -> list[tuple]:
    tree = parse(text)
    rows = []
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            tokens = [t for s in n.body for t in shape(s)]
            statements = sum(isinstance(x, ast.stmt) for s in n.body for x in ast.walk(s))
            a = n.args
            params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)
            digest = hashlib.sha256("|".join(tokens).encode()).hexdigest()[:16]
            rows.append((n.name, n.lineno, n.end_lineno, statements, len(tokens), params, digest, tokens))
    return rows


def names_of(kind: ast.expr | None) -> set[str]:
    parts = kind.elts if isinstance(kind, ast.Tuple) else [kind] if kind else []
    return {p.attr if isinstance(p, ast.Attribute) else p.id for p in parts if isinstance(p, (ast.Attribute, ast.Name))}


def is_filler(s: ast.stmt) -> bool:
    return isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and (s.value.value is Ellipsis or isinstance(s.value.value, str))


def is_fallback(v: ast.expr | None) -> bool:
    if isinstance(v, ast.Constant):
        return v.value is None or isinstance(v.value, bool) or v.value == ""
    return isinstance(v, (ast.Dict, ast.List)) and not getattr(v, "keys", None) and not getattr(v, "elts", None)


def handles(body: list[ast.stmt]) -> bool:
    """Whether a handler raises, returns or logs."""
    for s in body:
        for n in ast.walk(s):
            if isinstance(n, (ast.Raise, ast.Return)):
                return True
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in LOG_METHODS:
                return True
    return False


def error_handling(text: str) -> list[tuple]:
    """ENT-ERR-001 to 005; a bare handler isn't reported as broad, nor an empty one as unhandled."""
    tree = parse(text)
    rows = []
    for n in ast.walk(tree) if tree else ():
        if not isinstance(n, ast.ExceptHandler):
            continue
        hit = []
        if n.type is None:
            hit.append(("ENT-ERR-001", "medium", "high", "Bare except"))
        elif names_of(n.type) & BROAD:
            hit.append(("ENT-ERR-002", "medium", "high", "Broad exception"))
        if all(map(is_filler, n.body)):
            hit.append(("ENT-ERR-003", "medium", "high", "Swallowed exception"))
        elif not handles(n.body):
            hit.append(("ENT-ERR-004", "medium", "high", "Exception neither raised, returned nor logged"))
        if any(isinstance(s, ast.Return) and (s.value is None or is_fallback(s.value)) for s in n.body):
            hit.append(("ENT-ERR-005", "low", "medium", "Fallback value hides the error"))
        rows += [(r, n.lineno, n.end_lineno, sev, conf, "error_handling", title) for r, sev, conf, title in hit]
    return rows


def import_nodes(text: str) -> Iterator[tuple[ast.Import | ast.ImportFrom, bool]]:
    """Import statements; those inside functions or under TYPE_CHECKING are deferred."""
    tree = parse(text)
    stack: list[tuple[ast.AST, bool]] = [(tree, False)] if tree else []
    while stack:
        node, late = stack.pop()
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            yield node, late
        late = late or isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) or isinstance(node, ast.If) and "TYPE_CHECKING" in ast.dump(node.test)
        stack.extend((c, late) for c in ast.iter_child_nodes(node))


def imports(text: str) -> list[tuple]:
    """Imported modules, with a dot for each level."""
    rows: list[tuple] = []
    for node, late in import_nodes(text):
        if isinstance(node, ast.Import):
            rows.extend((a.name, node.lineno, late) for a in node.names)
        else:
            rows.append(("." * node.level + (node.module or ""), node.lineno, late))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def imported_names(text: str) -> list[tuple]:
    """Each imported name with its module (null in a plain import) and level."""
    rows = [(getattr(n, "module", None), a.name, getattr(n, "level", 0), n.lineno, late) for n, late in import_nodes(text) for a in n.names]
    return sorted(rows, key=lambda r: (r[3], r[1]))


def sensitive(name: str) -> bool:
    low = name.lower()
    return not any(p in low for p in SAFE_NAME_PARTS) and any(p in low for p in SENSITIVE_NAMES)


def bits_per_char(s: str) -> float:
    return -sum((n := s.count(c) / len(s)) * math.log2(n) for c in set(s))


def secret_confidence(name: str, value: str) -> str | None:
    """Confidence that assigning ``value`` to ``name`` is a hardcoded credential; None if it isn't one."""
    v = value.strip()
    low = v.lower()
    if len(v) < 8 or low in EXACT_PLACEHOLDERS or any(p in low for p in PLACEHOLDER_PARTS):
        return None
    if v.startswith(SECRET_PREFIXES):
        return "high"
    if not sensitive(name) or len(v) < 12:
        return None
    bits = bits_per_char(v)
    mixed = any(map(str.isupper, v)) and any(map(str.islower, v)) and any(map(str.isdigit, v))
    if bits > 3.3 or mixed or len(v) >= 20:
        return "high" if bits > 3.8 or mixed else "medium"
    return None


# Objects whose logging as a whole is reported, and names of loggers.
WHOLE_OBJECTS = frozenset("request headers user session".split())
LOGGERS = ("log", "logger", "logging")


def is_log_call(n: ast.AST) -> bool:
    if not (isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in LOG_METHODS):
        return False
    return any(x in ast.unparse(n.func.value).lower() for x in LOGGERS)


def logged_names(call: ast.Call) -> Iterator[str]:
    """Names and attributes that reach a log call's arguments, inside formatted strings as well."""
    for a in [*call.args, *(k.value for k in call.keywords)]:
        for n in ast.walk(a):
            if isinstance(n, ast.Name):
                yield n.id
            elif isinstance(n, ast.Attribute):
                yield n.attr
            elif isinstance(n, ast.Dict):
                yield from (k.value for k in n.keys if isinstance(k, ast.Constant) and isinstance(k.value, str))


def logging_and_secrets(text: str) -> list[tuple]:
    """ENT-LOG-001 to 004: sensitive values logged, credentials in code, whole objects logged, secret defaults."""
    tree = parse(text)
    rows = []

    def add(n: ast.AST, rule: str, severity: str, confidence: str, title: str) -> None:
        rows.append((rule, n.lineno, n.end_lineno, severity, confidence, "logging_and_secrets", title))

    for n in ast.walk(tree) if tree else ():
        if is_log_call(n):
            names = set(logged_names(n))
            if any(map(sensitive, names)):
                add(n, "ENT-LOG-001", "high", "high", "Sensitive value logged")
            if any(isinstance(a, ast.Name) and a.id.lower() in WHOLE_OBJECTS or isinstance(a, ast.Attribute) and a.attr.lower() in WHOLE_OBJECTS for a in n.args):
                add(n, "ENT-LOG-003", "medium", "high", "Whole object logged")
        elif isinstance(n, (ast.Assign, ast.AnnAssign)) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
            for target in n.targets if isinstance(n, ast.Assign) else [n.target]:
                name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else ""
                if name and (confidence := secret_confidence(name, n.value.value)):
                    add(n, "ENT-LOG-002", "high", confidence, "Hardcoded credential")
        elif isinstance(n, ast.Call) and len(n.args) == 2 and all(isinstance(a, ast.Constant) and isinstance(a.value, str) for a in n.args):
            if ast.unparse(n.func) in ("os.getenv", "os.environ.get", "getenv", "environ.get") and sensitive(n.args[0].value) and len(n.args[1].value) >= 6:
                add(n, "ENT-LOG-004", "medium", "high", "Default for a secret")
    return rows


def facts(files: DataFrame, extract: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``extract`` for every Python file; ``files`` has (path, language, content)."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(p, *r) for p, t in zip(df["path"], df["content"]) for r in extract(t or "")]
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(columns)})

    return files.where("language = 'python'").select("path", "content").mapInPandas(run, schema)


def python_functions(files: DataFrame) -> DataFrame:
    return facts(files, functions, FUNCTION_SCHEMA)


def python_error_handling(files: DataFrame) -> DataFrame:
    return facts(files, error_handling, FINDING_SCHEMA)


def python_logging_and_secrets(files: DataFrame) -> DataFrame:
    return facts(files, logging_and_secrets, FINDING_SCHEMA)


def python_imports(files: DataFrame) -> DataFrame:
    return facts(files, imports, IMPORT_SCHEMA)


def python_imported_names(files: DataFrame) -> DataFrame:
    return facts(files, imported_names, IMPORTED_NAME_SCHEMA)


STRUCTURE_SCHEMA = "file string, imports_count int, classes_count int, functions_count int, calls_count int, handlers_count int, raises_count int"


def structure(text: str) -> list[tuple]:
    """One row: how many imports, classes, functions, calls, handlers and raises a file has."""
    tree = parse(text)
    if tree is None:
        return []
    kinds = ((ast.ClassDef,), (ast.FunctionDef, ast.AsyncFunctionDef), (ast.Call,), (ast.ExceptHandler,), (ast.Raise,))
    nodes = list(ast.walk(tree))
    names = sum(len(n.names) for n in nodes if isinstance(n, (ast.Import, ast.ImportFrom)))
    return [(names, *(sum(isinstance(n, k) for n in nodes) for k in kinds))]


def python_structure(files: DataFrame) -> DataFrame:
    return facts(files, structure, STRUCTURE_SCHEMA)
