"""Files of a scan: dispositions, manifest, directories, lines, snippets, ignore rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import extension, glob_regex, language_of, lines_of

# Limits, pruned directories, binary extensions, endings of generated files and default scope exclusions.
MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_FILES = 50_000
MAX_REPO_BYTES = 500 * 1024 * 1024
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".svn", "node_modules", "venv", ".venv", "env", "ENV", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", "dist", "build",
    "coverage", ".next", "target", "vendor", ".idea", ".vscode", ".gradle", "out", ".turbo", ".cache", "__generated__",
)
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp", ".svg", ".bmp", ".tiff", ".mp4", ".mov", ".avi", ".mkv", ".mp3", ".wav", ".ogg", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".xz",
    ".pyc", ".pyo", ".so", ".dll", ".dylib", ".exe", ".bin", ".class", ".o", ".a", ".wasm", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".sqlite", ".sqlite3", ".db",
)
IGNORED_ENDINGS = (".min.js", ".min.css", ".generated.js", ".generated.ts", ".map", ".lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock")
EXCLUDED_NAMES = (
    "test", "tests", "__tests__", "spec", "e2e", "integration", "examples", "example", "bench", "benchmarks", "benchmark", "docs", "docs_src", "fixtures", "__mocks__",
    "vendor", "third_party", "node_modules", "dist", "build",
)
EXCLUDED_GLOBS = (
    "*.test.*", "*.spec.*", "test_*.py", "*_test.py", "*_test.go", "*Test.java", "*Tests.java", "*TestCase.java", "*_test.c", "*_test.cpp", "*_test.rs", "*Test.php", "*.stories.*",
)


def scope_excluded(path: Column, names=EXCLUDED_NAMES, globs=EXCLUDED_GLOBS) -> Column:
    """A plain name excludes any directory of that name or a file called so; a glob is tried on name and whole path."""
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.get(parts, F.size(parts) - 1)
    by_name = F.arrays_overlap(directories, F.array(*map(F.lit, names))) | name.isin(*names)
    return reduce(or_, [name.rlike(glob_regex(g)) | path.rlike(glob_regex(g)) for g in globs], by_name)


# Parts of paths that duplicate and architecture rules leave out.
DUPLICATION_PARTS = ("/tests/", "tests/", "/test/", "test_", "_test.py", "fixtures/", "/fixtures/", "conftest.py", "migrations/", "site-packages", ".venv")
ARCHITECTURE_PARTS = (
    "test/", "tests/", "fixtures/", "fixture/", "migrations/", "alembic/", "vendor/", "node_modules/", ".venv/", "venv/", "env/", "dist/", "build/", "scripts/", "setup.py",
)


def _holds(path: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(path, p))


def duplication_excluded(path: Column) -> Column:
    """Paths that rules on duplicates leave out: those out of scope, and test or generated code."""
    return scope_excluded(path) | _holds(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), DUPLICATION_PARTS)


def architecture_excluded(path: Column) -> Column:
    """Paths that architecture rules leave out."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return _holds(low, ARCHITECTURE_PARTS) | F.startswith(low, F.lit("test_"))


def search_files(files: DataFrame, part: str = "", language: str | None = None) -> DataFrame:
    """Files whose path holds ``part``, whatever the case, in one language if one is named."""
    found = files.where(F.contains(F.lower("path"), F.lit(part.lower()))) if part else files
    return found.where(F.lower("language") == language.lower()) if language else found


def pruned(path: Column) -> Column:
    """Whether a directory on the way is never entered."""
    parts = F.split(path, "/")
    directories = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(directories, lambda d: d.isin(*IGNORED_DIRECTORIES) | F.startswith(d, F.lit(".")))


def disposition(path: Column, size: Column, content: Column) -> Column:
    """What becomes of a file: the first test that holds; tests of the content come last, as CASE stops early."""
    return (
        F.when(pruned(path), "ignored_directory")
        .when(extension(path).isin(*BINARY_EXTENSIONS), "binary_extension")
        .when(size > MAX_FILE_BYTES, "file_too_large")
        .when(F.locate("\0", F.substring(content, 1, 8192)) > 0, "binary_content")
        .when(language_of(path) == "unknown", "unsupported_language")
        .when(scope_excluded(path), "scope_excluded")
        .otherwise("analyzable")
    )


def excluded_by(path: Column, patterns: tuple[str, ...]) -> Column:
    """``scope_excluded`` by a caller's patterns: those with a star are globs, others names."""
    if not patterns:
        return F.lit(False)
    return scope_excluded(path, [p for p in patterns if "*" not in p] or ["/"], [p for p in patterns if "*" in p])


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"))


def manifest(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files, bytes, lines and what was left out, of each group."""
    ok = F.col("disposition") == "analyzable"
    return files.groupBy(*keys).agg(
        F.count("*").alias("total_files"), F.sum("size").alias("total_bytes"), F.sum(F.when(ok, F.col("line_count")).otherwise(0)).alias("total_loc"),
        F.count_if(ok).alias("analyzable_files"), F.count_if(~ok).alias("skipped_files"), F.count_if(F.col("disposition") == "scope_excluded").alias("excluded_files"),
    )


def directory_rollup(files: DataFrame) -> DataFrame:
    """Files and bytes under every directory, with its parent; '' is the root."""
    parts = F.split("path", "/")
    up = files.select("size", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("directory"))
    out = up.groupBy("directory").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))
    return out.withColumn("parent", F.when(F.col("directory") == "", None).otherwise(F.regexp_extract("directory", "^(.*)/[^/]*$", 1)))


def lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each line, numbered from 1."""
    return files.select(*keys, F.posexplode(lines_of(F.col("content"))).alias("pos", "line")).withColumn("line_number", F.col("pos") + 1).drop("pos")


def snippet(content: Column, start: Column, stop: Column, before: int, after: int) -> Column:
    """Lines around a place, clamped to the text."""
    ls = lines_of(content)
    first = F.greatest(F.lit(1), start - before)
    return F.array_join(F.slice(ls, first, F.greatest(F.lit(0), F.least(F.size(ls), stop + after) - first + 1)), "\n")


def numbered_snippet(content: Column, line: Column, around: int = 5) -> Column:
    ls = lines_of(content)
    first = F.greatest(F.lit(1), line - around)
    return F.array_join(F.transform(F.slice(ls, first, F.greatest(F.lit(0), F.least(F.size(ls), line + around) - first + 1)), lambda x, i: F.concat((first + i).cast("string"), F.lit(": "), x)), "\n")


def language_coverage(files: DataFrame, supported: list[str], keys: list[str]) -> DataFrame:
    """Share of lines in supported languages, and whether coverage is partial."""
    ok = F.col("language").isin(supported)
    out = files.groupBy(*keys).agg(F.sum("line_count").alias("loc"), F.sum(F.when(ok, F.col("line_count")).otherwise(0)).alias("covered_loc"), F.array_sort(F.collect_set(F.when(ok, F.col("language")))).alias("_l"))
    share = F.when(F.col("loc") > 0, F.round(100.0 * F.col("covered_loc") / F.col("loc"), 6)).otherwise(0.0)
    return out.select(*keys, "loc", "covered_loc", share.alias("covered_percent"), (F.col("covered_loc") < F.col("loc")).alias("is_partial"), F.array_join("_l", ",").alias("languages"))


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """A gitignore line as (regular expression over the path, negated)."""
    negated = pattern.startswith("!")
    p = pattern[1:] if negated else pattern
    only_dirs = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = [], 0
    while i < len(p):
        if p.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif p.startswith("**", i):
            out.append(".*")
            i += 2
        elif p[i] == "*":
            out.append("[^/]*")
            i += 1
        elif p[i] == "?":
            out.append("[^/]")
            i += 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            end = p.index("]", i + 1)
            body = p[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = end + 1
        else:
            out.append("\\" + p[i] if not p[i].isalnum() and p[i] not in "_/" else p[i])
            i += 1
    return ("^" if anchored else "(?:^|/)") + "".join(out) + ("/" if only_dirs else "(?:/|$)"), negated


def rule_key(pattern: str) -> tuple[str, str]:
    """What a path must have for a gitignore line to match it: a segment, or an extension of one; else nothing.

    A segment without wildcards matches whole segments only, and what stands
    behind the last dot of the last segment ends a segment.
    """
    segments = pattern.removeprefix("!").rstrip("/").split("/")
    plain = [x for x in segments if x and not re.search(r"[*?\[]", x)]
    if plain:
        return "segment", max(plain, key=len)
    name, dot, ending = segments[-1].rpartition(".")
    return ("ending", ending) if dot and ending and not re.search(r"[*?\[]", ending) else ("any", "")


def path_keys(path: Column) -> Column:
    """All keys by which a rule may match a path."""
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    of = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    endings = F.transform(F.filter(segments, lambda x: F.contains(x, F.lit("."))), lambda x: of("ending", F.substring_index(x, ".", -1)))
    return F.array_distinct(F.concat(F.array(of("any", F.lit(""))), F.transform(segments, lambda x: of("segment", x)), endings))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches isn't negated."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if p and not p.startswith("#"):
            regex, negated = ignore_regex(p)
            out = F.when(path.rlike(regex), F.lit(not negated)).otherwise(out)
    return out


def _above(path: Column) -> Column:
    """The directories that hold a path, outermost first, without the root."""
    parts = F.split(path, "/")
    inside = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, inside).otherwise(F.array().cast("array<string>"))


def ignore_file_rules(files: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each rule of each .gitignore file (path, content): the directory it stands in, its turn, what it matches, whether it ignores, and what a path must have for it."""
    at = files.where(F.col("path").rlike(r"(^|/)\.gitignore$")).select(*keys, F.regexp_replace("path", r"/?\.gitignore$", "").alias("base"), "content")
    schema = T.StructType([*at.drop("content").schema.fields, *T.StructType.fromDDL("turn int, regex string, ignores boolean, kind string, key string").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for *where, text in df.itertuples(index=False, name=None):
                for turn, line in enumerate((text or "").splitlines()):
                    if line.strip() and not line.strip().startswith("#"):
                        regex, negated = ignore_regex(line.strip())
                        rows.append((*where, turn, regex, not negated, *rule_key(line.strip())))
            yield pd.DataFrame(rows, columns=schema.names)

    return at.mapInPandas(run, schema)


def ignored_by_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and path of the files that the .gitignore files of their tree leave out.

    Every file, and every directory once, meets those rules of the directories
    above it that ask for one of its segments or endings; the last one that matches decides, deeper files counting as later.
    What lies in an ignored directory is out, whatever later rules say of it.
    ``keys`` tell trees apart; null paths are never ignored.
    """
    known = files.where("path is not null").select(*keys, "path")
    as_dirs = F.transform(_above(F.col("path")), lambda d: F.concat(d, F.lit("/")))
    places = known.withColumnRenamed("path", "place").unionByName(known.select(*keys, F.explode(as_dirs).alias("place"))).distinct()
    bases = F.concat(F.array(F.lit("")), _above(F.rtrim("place", F.lit("/"))))
    inner = F.when(F.col("base") == "", F.col("place")).otherwise(F.substring("place", F.length("base") + 2, F.length("place")))
    asked = places.select(*keys, "place", F.explode(bases).alias("base")).withColumn("inner", inner)
    # rules and paths meet by what the rule asks of a path, so a thousand rules above a file are not tried one by one
    met = asked.select(*keys, "place", "base", "inner", F.inline(path_keys(F.col("inner")))).join(ignore_file_rules(files, keys), [*keys, "base", "kind", "key"])
    last = met.where(F.rlike("inner", F.col("regex"))).groupBy(*keys, "place").agg(F.max_by("ignores", F.struct(F.length("base"), "turn")).alias("out"))
    return known.withColumn("place", F.explode(F.concat(F.array("path"), as_dirs))).join(last.where("out"), [*keys, "place"], "left_semi").select(*keys, "path").distinct()


def inline_directives(file_lines: DataFrame, marker: str = "tidemark:ignore") -> DataFrame:
    """Rule ids that comments on a line switch off."""
    found = F.regexp_extract("line", rf"(?:#|//)\s*{marker}\s+([A-Z0-9, -]+)", 1)
    return file_lines.where(found != "").select("file", "line_number", F.explode(F.regexp_extract_all(found, F.lit(r"[A-Z]+(?:-[A-Z0-9]+)+"), F.lit(0))).alias("rule_id"))


# Web frameworks whose routes are read, and those that are only known by name.
WEB_FRAMEWORKS = ("django", "express", "fastapi", "fastify", "flask", "hono", "nestjs", "nextjs")
OTHER_FRAMEWORKS = ("koa", "hapi", "restify", "adonis", "sails", "tornado", "aiohttp", "bottle", "falcon", "pyramid", "sanic", "litestar", "cherrypy", "web2py")


def framework_coverage(imports: DataFrame, routes: DataFrame, repositories: DataFrame, key: str) -> DataFrame:
    """Whether authentication and authorisation can be judged in each repository, and why not.

    ``imports`` has (key, name), ``routes`` (key, framework), ``repositories`` key.
    """
    low = F.lower("name")
    seen = imports.groupBy(key).agg(
        *[F.bool_or(F.contains(low, F.lit(f))).alias(f"i_{f}") for f in WEB_FRAMEWORKS],
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.array(*map(F.lit, OTHER_FRAMEWORKS)), lambda f: F.contains(low, f)))))), ", ").alias("others"),
    )
    routed = routes.groupBy(key).agg(F.count("*").alias("n_routes"), F.count_if(F.col("framework").isin(*WEB_FRAMEWORKS)).alias("n_known"))
    out = repositories.select(key).distinct().join(seen, key, "left").join(routed, key, "left")
    n, others = F.coalesce("n_routes", F.lit(0)), F.coalesce("others", F.lit(""))
    detected = reduce(or_, [F.coalesce(f"i_{f}", F.lit(False)) for f in WEB_FRAMEWORKS], F.coalesce(F.col("n_known") > 0, F.lit(False)))
    why = (
        F.when((others != "") & ~(detected & (n > 0)), F.concat(others, F.lit(" detected, not supported")))
        .when(~detected, F.lit(f"No supported web framework detected (supported: {', '.join(WEB_FRAMEWORKS)})"))
        .when(n == 0, "no HTTP routes detected")
    )
    return out.select(key, n.alias("n_routes"), why.isNull().alias("is_analyzed"), why.alias("explanation"))
