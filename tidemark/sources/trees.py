"""Source trees as tables: directories, archives, policies and baselines."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import or_
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, language_of, lines_of
from ..operators.files import BINARY_EXTENSIONS, IGNORED_ENDINGS, MAX_FILE_BYTES, MAX_FILES, MAX_REPO_BYTES, disposition, excluded_by, ignored_by_files, pruned, scope_excluded


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, raw) of every file under ``root``; one distributed read, whatever the depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    plain = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    return files.select(F.substring(plain, F.lit(len(base) + 1), F.length(plain)).alias("path"), F.col("length").alias("size"), F.col("content").alias("raw"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """The same of ZIP files, opened where they are read; entries that leave the archive, and archives beyond a tree's limits, are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for raw in df["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    n, size = len(z.infolist()), sum(i.file_size for i in z.infolist())
                    if n > MAX_FILES or size > MAX_REPO_BYTES:
                        raise ValueError(f"the archive has {n} entries of {size} bytes; the limits are {MAX_FILES} and {MAX_REPO_BYTES}")
                    for info in z.infolist():
                        p = PurePosixPath(info.filename)
                        if p.is_absolute() or ".." in p.parts:
                            raise ValueError(f"unsafe archive entry {info.filename!r}")
                        if not info.is_dir():
                            rows.append((str(p), info.file_size, z.read(info)))
            yield pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("path", "size", "raw"))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "path string, size long, raw binary")


def source_files(tree: DataFrame) -> DataFrame:
    """Language, content, lines and disposition of each file; text that isn't UTF-8 is read as Latin-1."""
    text = F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string")).otherwise(F.decode("raw", "ISO-8859-1"))
    out = tree.select("path", "size", language_of(F.col("path")).alias("language"), text.alias("content"))
    return out.withColumn("line_count", F.size(lines_of(F.col("content"))).cast("long")).withColumn("disposition", disposition(F.col("path"), F.col("size"), F.col("content")))


# Languages analysed by default, and why another one isn't.
ANALYZED_LANGUAGES = ("python", "javascript", "typescript")
NO_ANALYZER = "language_detected_but_analyzer_unavailable"


def discover(
    tree: DataFrame,
    keys: tuple[str, ...] = (),
    respect_gitignore: bool = True,
    include_tests: bool = False,
    ignored_endings: tuple[str, ...] = IGNORED_ENDINGS,
    custom_exclusions: tuple[str, ...] = (),
    languages: tuple[str, ...] = ANALYZED_LANGUAGES,
) -> DataFrame:
    """Every file of one or more trees (``keys`` tell them apart) with what becomes of it: the first test that holds.

    ``tree`` has path, size and raw, and may have is_symlink; a null raw is an
    unreadable file. Tests by name come first, so contents are looked at only
    where they decide. Files that stay are ``analyzable``, or tell that their
    language has no analyzer. ``check_limits`` is for those that were not ignored.
    """
    trees = list(keys)
    text = F.col("raw").cast("string")
    rows = tree.select(*trees, "path", "size", "raw", (F.col("is_symlink") if "is_symlink" in tree.columns else F.lit(False)).alias("_link"))
    if respect_gitignore:
        out = ignored_by_files(tree.select(*trees, "path", text.alias("content")), trees).withColumn("_out", F.lit(True))
        rows = rows.join(out, [*trees, "path"], "left")
    else:
        rows = rows.withColumn("_out", F.lit(None).cast("boolean"))
    path = F.col("path")
    ends = [F.endswith(path, F.lit(e)) for e in ignored_endings]
    tests = [
        (pruned(path), "ignored_directory"),
        (F.coalesce("_link", F.lit(False)), "symlink_ignored"),
        (reduce(or_, ends, F.lit(False)), "ignored_pattern"),
        (F.coalesce("_out", F.lit(False)), "gitignored"),
        (extension(path).isin(*BINARY_EXTENSIONS), "binary_file"),
        (F.col("raw").isNull(), "unreadable_file"),
        (F.col("size") > MAX_FILE_BYTES, "file_size_exceeds_limit"),
        (F.contains(F.substring("raw", 1, 8192), F.lit(b"\0")), "binary_content_detected"),
        (language_of(path) == "unknown", "unrecognized_language"),
        (~F.is_valid_utf8(text), "unsupported_encoding_or_unreadable"),
        (F.lit(False) if include_tests else scope_excluded(path), "scope_exclusion"),
        (excluded_by(path, custom_exclusions), "custom_exclude"),
        (~language_of(path).isin(*languages), NO_ANALYZER),
    ]
    said = reduce(lambda c, t: c.when(*t), tests[1:], F.when(*tests[0])).otherwise("analyzable")
    content = F.when(F.is_valid_utf8(text), text)
    return rows.select(*trees, "path", "size", language_of(path).alias("language"), content.alias("content"), F.size(lines_of(content)).cast("long").alias("line_count"), said.alias("disposition"))


def check_limits(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_REPO_BYTES) -> None:
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n > max_files or size > max_bytes:
        raise ValueError(f"the tree has {n} files of {size} bytes; the limits are {max_files} and {max_bytes}")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a baseline file, with a fixed schema."""
    kind = "findings array<struct<fingerprint string, rule_id string, file string, line_start int, severity string, category string, id string>>"
    return spark.read.schema(kind).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("findings").alias("f")).select("f.*")


def policy(spark: SparkSession, text: str) -> DataFrame:
    """Rules of a JSON policy document as rows; unknown keys are refused."""
    # Where each threshold stands in the document, and what it measures.
    known = {
        ("score", "max_score"): ("absolute", "score", "fail"), ("score", "warn_score"): ("absolute", "score", "warn"), ("score", "max_delta"): ("delta", "score_delta", "fail"),
        ("score", "warn_delta"): ("delta", "score_delta", "warn"), ("findings", "max_new"): ("delta", "n_new", "fail"), ("findings", "max_new_high"): ("delta", "n_new_high", "fail"),
        ("findings", "max_new_critical"): ("delta", "n_new_critical", "fail"), ("findings", "max_total"): ("absolute", "n_total", "fail"),
        ("findings", "max_total_high"): ("absolute", "n_total_high", "fail"), ("findings", "max_total_critical"): ("absolute", "n_total_critical", "fail"),
    }
    doc, rows = json.loads(text), []
    for section in ("score", "findings"):
        for key, value in (doc.get(section) or {}).items():
            if (section, key) not in known:
                raise ValueError(f"unknown policy key {section}.{key}")
            kind, metric, verdict = known[section, key]
            if value is not None:
                rows.append((key, kind, metric, float(value), verdict, None))
    per_category = {"max_score": ("absolute", "score", "fail"), "max_delta": ("delta", "score_delta", "fail"), "warn_delta": ("delta", "score_delta", "warn")}
    for key, values in (doc.get("categories") or {}).items():
        if key not in per_category:
            raise ValueError(f"unknown policy key categories.{key}")
        kind, metric, verdict = per_category[key]
        rows += [(f"categories.{c}.{key}", kind, metric, float(v), verdict, c) for c, v in (values or {}).items() if v is not None]
    if extra := set(doc.get("rules") or {}) - {"forbidden_rules"}:
        raise ValueError(f"unknown policy keys {sorted('rules.' + k for k in extra)}")
    if unknown := set(doc) - {"name", "description", "enabled", "version", "score", "findings", "categories", "rules"}:
        raise ValueError(f"unknown policy keys {sorted(unknown)}")
    return spark.createDataFrame(rows, "rule_name string, kind string, metric string, threshold double, verdict string, category string")


def forbidden_rules(text: str) -> list[str]:
    """The rules that a JSON policy document forbids, for ``compare.forbidden_rules``."""
    return list((json.loads(text).get("rules") or {}).get("forbidden_rules") or [])
