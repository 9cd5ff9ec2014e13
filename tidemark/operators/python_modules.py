"""What each Python module is responsible for, and the architecture rules that need it.

One row of facts for each file; layers, conventions and rules are expressions
and joins over that table. A file that doesn't parse has no row.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash
from .files import architecture_excluded
from .findings import union_findings
from .graph import bounded_cycles, layer_of, module_targets
from .python_endpoints import holds, low
from .python_facts import parse, python_imported_names, python_structure
from .reachability import cut

# What shows each responsibility.
ROUTE_MARKS = ("router.", "app.", "route", "blueprint.", "api_view")
DATABASE_PACKAGES = ("sqlalchemy", "psycopg2", "psycopg", "pymongo", "tortoise", "peewee")
DATABASE_NAMES = ("save", "find_by", "fetch_by", "commit")
AUTH_PACKAGES = ("jwt", "jose", "bcrypt", "passlib", "cryptography", "authlib")
AUTH_MODULES = ("fastapi.security", "django.contrib.auth", "auth")
AUTH_IMPORTS = ("OAuth2PasswordBearer", "HTTPBearer", "CryptContext", "pwd_context")
AUTH_NAMES = ("hash_password", "verify_password", "create_access_token", "decode_token", "authenticate_user", "verify_token")
CONFIG_IMPORTS = ("BaseSettings", "SettingsConfigDict")
IO_PACKAGES = ("subprocess", "shutil")
MADE_BY_HAND = ("SessionLocal", "get_db", "get_session")
# Calls that make a module the one that wires an application together, and what shows direct work on a database.
APPLICATIONS = ("FastAPI", "Flask", "Starlette", "Sanic", "Tornado", "Bottle", "AiohttpApp", "WSGIApplication")
WIRING = (".include_router", ".register_blueprint")
RUNNERS = ("uvicorn.run", "app.run")
RAW_DATABASE = ("raw_sql", "cursor.execute")
# Layers that a module may depend on before it is too many, and the share of routes that makes services the convention.
MOST_LAYERS, LEAST_ROUTES, SHARE_ROUTES = 3, 3, 0.65
# Parts of method names that show a class's domains.
DOMAINS = {
    "routing_http": ("handle", "route", "get_", "post_", "request"),
    "persistence_db": ("save", "query", "find_", "delete_", "commit"),
    "auth_security": ("auth", "hash", "token", "verify_pass", "login"),
    "config_management": ("config", "load_env", "settings"),
    "business_logic": ("process", "calculate", "execute_step", "validate"),
}
# From where on a module or class has too much to do, and a convention is one.
GOD_MODULE, GOD_LINES, GOD_PARTS = 4, 100, 6
GOD_METHODS, GOD_DOMAINS = 10, 3
LEAST_DEPENDENTS, SHARE_DEPENDENTS = 3, 0.15

MODULE_SCHEMA = (
    "file string, module string, loc int, n_functions int, n_classes int, imports array<string>, duties array<string>, uses_di boolean, is_root boolean, raw_database boolean, "
    "made array<struct<line int, line_end int, name string>>, env array<struct<line int, line_end int>>, classes array<struct<line int, line_end int, name string, methods int, domains array<string>>>"
)
COLUMNS = ("file", "module", "loc", "n_functions", "n_classes", "imports", "duties", "uses_di", "is_root", "raw_database", "made", "env", "classes")
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def reads_environment(n: ast.AST) -> bool:
    said = ast.unparse(n.func) if isinstance(n, ast.Call) else ""
    return said == "os.getenv" or said.startswith("os.environ")


def module_of(path: str) -> str:
    name = path.removesuffix(".py").replace("/", ".")
    return name.removesuffix(".__init__")


def facts_of(path: str, text: str) -> list[tuple]:
    tree = parse(text)
    if tree is None:
        return []
    nodes = list(ast.walk(tree))
    functions = [n for n in nodes if isinstance(n, FUNCTIONS)]
    classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
    calls = [n for n in nodes if isinstance(n, ast.Call)]
    called = [ast.unparse(c.func) for c in calls]
    sources = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in nodes if isinstance(n, ast.ImportFrom)]
    names = [a.name for n in nodes if isinstance(n, ast.ImportFrom) for a in n.names]
    full = [f"{n.module}.{a.name}" for n in nodes if isinstance(n, ast.ImportFrom) and n.module for a in n.names]
    packages = {s.split(".")[0] for s in sources}
    marks = {f: [low(d.func if isinstance(d, ast.Call) else d) for d in f.decorator_list] for f in functions}
    own = [f.name.lower() for f in functions]
    duties = {
        "routing_http": any(m.startswith(ROUTE_MARKS) for ms in marks.values() for m in ms),
        "persistence_db": bool(packages & set(DATABASE_PACKAGES)) or any(holds(f, DATABASE_NAMES) for f in own),
        "auth_security": bool(packages & set(AUTH_PACKAGES)) or any(holds(s.lower(), AUTH_MODULES) for s in sources) or any(n in AUTH_IMPORTS for n in names) or any(holds(x.lower(), AUTH_NAMES) for x in (*own, *called)),
        "config_management": any(map(reads_environment, calls)) or "pydantic_settings" in packages or any(n in CONFIG_IMPORTS for n in names) or any("basesettings" in low(b) for c in classes for b in c.bases),
        "system_io": bool(packages & set(IO_PACKAGES)) or any(c in ("open", "os.system") or c.startswith(("subprocess.", "shutil.", "os.system")) for c in called),
    }
    made = []
    for f in functions:
        if any(m.startswith(("router.", "app.")) for m in marks[f]) and not any("depends" in low(d) for d in f.args.defaults):
            for c in ast.walk(f):
                if isinstance(c, ast.Call) and ((name := ast.unparse(c.func)).endswith("Service") or name in MADE_BY_HAND):
                    made.append((c.lineno, c.end_lineno, name))
    rows = []
    for c in classes:
        methods = [n.name.lower() for n in c.body if isinstance(n, FUNCTIONS)]
        rows.append((c.lineno, c.end_lineno, c.name, len(methods), sorted(d for d, parts in DOMAINS.items() if any(holds(m, parts) for m in methods))))
    env = [(c.lineno, c.end_lineno) for c in calls if reads_environment(c)]
    uses_di = "Depends" in names or "Depends(" in text
    is_root = any(c.endswith(WIRING) or c in RUNNERS or c.rsplit(".", 1)[-1] in APPLICATIONS for c in called)
    return [(path, module_of(path), len(text.splitlines()), len(functions), len(classes), sorted({*sources, *full}), sorted(d for d, x in duties.items() if x), uses_di, is_root, holds(text, RAW_DATABASE), made, env, rows)]


def python_modules(files: DataFrame) -> DataFrame:
    """Facts of every module, with its layer and, for services of three functions, the duty of business logic; ``files`` has (path, language, content)."""
    nested = {"made": ("line", "line_end", "name"), "env": ("line", "line_end"), "classes": ("line", "line_end", "name", "methods", "domains")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [r for p, t in zip(df["path"], df["content"]) for r in facts_of(p, t or "")]
            out = pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(COLUMNS)})
            for c, keys in nested.items():
                out[c] = pd.Series([[dict(zip(keys, x)) for x in v] for v in out[c]], dtype=object)
            yield out

    rows = files.where("language = 'python'").where(~architecture_excluded(F.col("path"))).select("path", "content").mapInPandas(run, MODULE_SCHEMA)
    rows = rows.withColumn("layer", layer_of(F.col("file")))
    business = (F.col("layer") == "service") & (F.col("n_functions") >= 3)
    return rows.withColumn("duties", F.when(business, F.array_sort(F.concat("duties", F.array(F.lit("business_logic"))))).otherwise(F.col("duties")))


def _module_name(path: Column) -> Column:
    """``module_of`` as a column."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")


def module_dependencies(files: DataFrame) -> DataFrame:
    """src, target and external of the imports that run when a module is loaded; of equal endings the module last by path has it."""
    known = files.where("language = 'python'").where(~architecture_excluded(F.col("path")))
    modules = python_structure(known).select(_module_name(F.col("file")).alias("module"), F.col("file").alias("ord"))  # files that parse
    named = python_imported_names(known).where(~F.col("is_deferred"))
    imports = named.select(_module_name(F.col("file")).alias("src"), "module", "name", "level")
    return module_targets(imports, modules).select("src", "target", "external").distinct()


def module_edges(files: DataFrame) -> DataFrame:
    """src, dst and line (the first import of it) of the imports between modules of the files; deferred imports don't count."""
    known = files.where("language = 'python'").where(~architecture_excluded(F.col("path")))
    modules = python_structure(known).select(_module_name(F.col("file")).alias("module"), F.col("file").alias("ord"))
    named = python_imported_names(known).where(~F.col("is_deferred")).select(_module_name(F.col("file")).alias("src"), "module", "name", "level", "line")
    keys = ("src", "module", "name", "level")
    found = module_targets(named.select(*keys), modules).where("target is not null").select(F.col("target").alias("dst"), *[F.col(k).alias(f"_{k}") for k in keys])
    lines = named.groupBy(*keys).agg(F.min("line").alias("line"))
    return found.join(lines, [lines[k].eqNullSafe(found[f"_{k}"]) for k in keys]).where("src != dst").groupBy("src", "dst").agg(F.min("line").alias("line"))


def dependency_findings(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """ENT-ARCH-001, 002, 007 and 008: cycles, routes that skip the services, modules of too many layers, and routes that work on the database where most use services.

    ``modules`` has the facts of ``python_modules``, ``edges`` src, dst and line.
    Conventions are counts over all modules, taken as scalar subqueries.
    """
    m = modules.select("module", "file", "layer", "loc", "is_root", "raw_database")
    links = edges.join(m.select(F.col("module").alias("src"), F.col("layer").alias("src_layer")), "src").join(m.select(F.col("module").alias("dst"), F.col("layer").alias("dst_layer")), "dst")
    out = []

    cycles = bounded_cycles(edges.withColumn("graph", F.lit(1)), "graph").select("cycle", "length", F.split("cycle", "->").alias("path"))
    cycles = cycles.withColumn("module", F.col("path")[0])
    inside = cycles.join(edges, F.col("module") == F.col("src")).where(F.array_contains("path", F.col("dst"))).groupBy("cycle").agg(F.min("line").alias("line"))
    c = cycles.join(inside, "cycle").join(m, "module")
    title = F.concat(F.lit("Circular Module Dependency ("), F.col("length").cast("string"), F.lit(" Modules in Cycle)"))
    out.append(_finding(c, "ENT-ARCH-001", "medium", "high", "", F.col("line"), F.col("line"), F.col("module"), title, F.col("cycle")))

    uses = links.where("src_layer = 'api' and dst_layer = 'service'").select(F.col("src").alias("module")).distinct()
    of = lambda layer: F.count_if(F.col("layer") == layer)
    layered = m.agg(((of("service") > 0) & (of("repository") > 0) & (of("api") > 0)).alias("x")).scalar()
    services, users, routes = m.agg(of("service").alias("x")).scalar(), uses.agg(F.count("*").alias("x")).scalar(), m.agg(of("api").alias("x")).scalar()
    skips = links.where("src_layer = 'api' and dst_layer = 'repository'").where(layered & ((users >= 1) | (services >= 2))).withColumn("module", F.col("src")).join(m, "module")
    out.append(_finding(skips, "ENT-ARCH-002", "medium", "medium", "Architectural Layer Violation: 'api' Directly Imports 'repository'", F.col("line"), F.col("line"), F.col("module"), sign=F.col("dst")))

    spread = links.where("dst_layer != 'unknown'").groupBy(F.col("src").alias("module")).agg(F.count_distinct("dst_layer").alias("n")).where(F.col("n") > MOST_LAYERS)
    coupled = spread.join(m.where(~F.col("is_root") & ~F.col("layer").isin("unknown", "utility")), "module")
    title = F.concat(F.lit("Excessive Cross-Layer Coupling: Direct Dependencies Across "), F.col("n").cast("string"), F.lit(" Architectural Layers"))
    out.append(_finding(coupled, "ENT-ARCH-007", "medium", "medium", "", F.lit(1), F.least(F.lit(10), F.col("loc")), F.col("module"), title))

    stores = edges.where(F.contains("dst", F.lit("db"))).select(F.col("src").alias("module")).distinct().withColumn("_db", F.lit(True))
    apart = m.where("layer = 'api'").join(uses, "module", "left_anti").join(stores, "module", "left").where(F.col("raw_database") | F.coalesce("_db", F.lit(False)))
    apart = apart.where((routes >= LEAST_ROUTES) & (users >= SHARE_ROUTES * routes))
    title = "Inconsistent Architectural Pattern: Follows 'Route -> Direct Database Access' Instead of 'Route -> Service Layer'"
    out.append(_finding(apart, "ENT-ARCH-008", "low", "medium", title, F.lit(1), F.least(F.lit(8), F.col("loc")), F.col("module")))
    return union_findings(*out)


def architecture_findings(files: DataFrame) -> DataFrame:
    """ENT-ARCH-001 to 008 of the Python files (path, language, content)."""
    modules = cut(python_modules(files))
    return union_findings(module_findings(modules), dependency_findings(modules, cut(module_edges(files))))


def config_convention(modules: DataFrame) -> DataFrame:
    """One row: whether enough modules import a configuration module for that to be the convention.

    An import names a module by any of its dotted endings, so those are the keys.
    """
    parts = F.split("module", r"\.")
    config = modules.where((F.col("layer") == "config") | F.lower("module").rlike("config|settings"))
    endings = config.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("name")).distinct()
    users = modules.select("module", F.explode("imports").alias("name")).join(endings, "name", "left_semi").select("module").distinct().withColumn("u", F.lit(1))
    n = modules.select("module").join(users, "module", "left").agg(F.coalesce(F.sum("u"), F.lit(0)).alias("dependents"), F.count("*").alias("modules"))
    return n.withColumn("is_convention", (F.col("dependents") >= LEAST_DEPENDENTS) | (F.col("dependents") > 0) & (F.col("dependents") >= SHARE_DEPENDENTS * F.col("modules")))


def _finding(rows: DataFrame, rule: str, severity: str, confidence: str, title: str, line: Column, stop: Column, symbol: Column, named: Column | None = None, sign: Column | None = None) -> DataFrame:
    sign = symbol if sign is None else sign
    return rows.select(
        "file", F.lit(rule).alias("rule_id"), line.alias("line_start"), stop.alias("line_end"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"),
        F.lit("architectural_consistency").alias("category"), (F.lit(title) if named is None else named).alias("title"), symbol.alias("symbol"),
        short_hash(F.lit(rule), F.col("file"), line, stop, sign).alias("id"), short_hash(F.lit(rule), F.col("file"), sign).alias("fingerprint"),
    )


def module_findings(modules: DataFrame) -> DataFrame:
    """ENT-ARCH-003 to 006: services made by hand beside injection, environment read beside a configuration, and modules and classes with too much to do."""
    made = modules.where((F.col("layer") == "api") & F.col("uses_di")).withColumn("x", F.explode("made"))
    out = [_finding(made, "ENT-ARCH-003", "low", "medium", "Inconsistent Dependency Pattern", F.col("x.line"), F.col("x.line_end"), F.col("x.name"))]
    env = modules.where(F.col("layer").isin("api", "service") & ~F.lower("module").rlike("config|settings")).withColumn("x", F.explode("env"))
    env = env.join(config_convention(modules).where("is_convention").select("is_convention"))  # one row or none
    out.append(_finding(env, "ENT-ARCH-004", "low", "high", "Inconsistent Configuration Access", F.col("x.line"), F.col("x.line_end"), F.concat(F.lit("env:"), F.col("x.line").cast("string"))))
    large = (F.col("loc") >= GOD_LINES) | (F.col("n_functions") + F.col("n_classes") >= GOD_PARTS)
    god = modules.where((F.size("duties") >= GOD_MODULE) & large)
    out.append(_finding(god, "ENT-ARCH-005", "high", "medium", "God Module", F.lit(1), F.least(F.lit(15), F.col("loc")), F.col("module")))
    classes = modules.withColumn("x", F.explode("classes")).where((F.col("x.methods") >= GOD_METHODS) & (F.size("x.domains") >= GOD_DOMAINS))
    out.append(_finding(classes, "ENT-ARCH-006", "medium", "medium", "God Class", F.col("x.line"), F.least(F.col("x.line") + 15, F.col("x.line_end")), F.col("x.name")))
    return union_findings(*out)
