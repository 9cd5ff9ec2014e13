"""Analyzers by name: what each looks at, its rules, and all of them over one table of files."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import short_hash
from . import duplicates, line_rules, python_endpoints, python_facts, python_modules, script_facts
from .findings import union_findings
from .reachability import ensure_checkpoints


class Analyzer(NamedTuple):
    """``run`` takes files (path, language, content) and returns findings."""

    analyzer_id: str
    name: str
    languages: tuple[str, ...]
    rules: tuple[tuple[str, str], ...]
    run: Callable[[DataFrame], DataFrame]


class Registry:
    """Analyzers in the order they were added; one of a known id takes the place of the other."""

    def __init__(self, *analyzers: Analyzer):
        self._held: dict[str, Analyzer] = {}
        for a in analyzers:
            self.add(a)

    def add(self, analyzer: Analyzer) -> None:
        self._held[analyzer.analyzer_id] = analyzer

    def get(self, analyzer_id: str) -> Analyzer | None:
        return self._held.get(analyzer_id)

    def all(self) -> list[Analyzer]:
        return list(self._held.values())

    def of_category(self, category: str) -> list[Analyzer]:
        return [a for a in self.all() if any(c == category for _, c in a.rules)]

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """A row for each rule of each analyzer."""
        return spark.createDataFrame([(a.analyzer_id, a.name, r, c, list(a.languages)) for a in self.all() for r, c in a.rules], "analyzer_id string, name string, rule_id string, category string, languages array<string>")

    def run_all(self, files: DataFrame, eager: bool = False) -> tuple[DataFrame | None, dict[str, str]]:
        """Findings of all analyzers, and the errors of those that failed, which don't stop the others.

        With ``eager`` each analyzer's findings are checkpointed one after the
        other, so that errors that only show while running are kept apart too.
        """
        found, failed = [], {}
        for a in self.all():
            try:
                rows = with_ids(a.run(files))
                if eager:
                    ensure_checkpoints(rows)
                    rows = rows.checkpoint()
                found.append(rows)
            except Exception as e:  # noqa: BLE001 - whatever one analyzer raises is its own failure
                failed[a.analyzer_id] = f"{type(e).__name__}: {str(e)[:500]}"
        return (union_findings(*found) if found else None), failed


def with_ids(findings: DataFrame) -> DataFrame:
    """Findings with an id and a fingerprint where they have none.

    The fingerprint leaves out the place, so lines that move don't make a
    finding new; findings of one rule, file and title share it and are compared by number.
    """
    sign = [F.col("rule_id"), F.col("file"), F.col("title")]
    if "symbol" in findings.columns:
        sign.append(F.coalesce("symbol", F.lit("")))
    if "id" not in findings.columns:
        findings = findings.withColumn("id", short_hash(*sign, F.col("line_start"), F.col("line_end")))
    if "fingerprint" not in findings.columns:
        findings = findings.withColumn("fingerprint", short_hash(*sign))
    return findings


def endpoint_findings(files: DataFrame) -> DataFrame:
    return python_endpoints.endpoint_findings(python_endpoints.python_endpoints(files).unionByName(script_facts.script_endpoints(files)))


def of(category: str, *rules: str) -> tuple[tuple[str, str], ...]:
    return tuple((r, category) for r in rules)


ENDPOINT_RULES = (
    *of("authentication_consistency", "ENT-AUTH-001", "ENT-AUTH-002", "ENT-AUTH-003"), *of("authorization_consistency", "ENT-AUTHZ-001", "ENT-AUTHZ-002", "ENT-AUTHZ-003"), *of("input_validation", "ENT-INPUT-001", "ENT-INPUT-002", "ENT-INPUT-003"),
)


def default_registry() -> Registry:
    return Registry(
        Analyzer("error-handling", "Error handling", ("python",), of("error_handling", *(f"ENT-ERR-00{i}" for i in range(1, 6))), python_facts.python_error_handling),
        Analyzer("endpoints", "Endpoints", ("python", *script_facts.LANGUAGES), ENDPOINT_RULES, endpoint_findings),
        Analyzer("scripts", "Errors and input of scripts", script_facts.LANGUAGES, (*of("error_handling", "ENT-ERR-JS-001", "ENT-ERR-JS-002"), *of("input_validation", "ENT-INPUT-JS-001")), script_facts.script_findings),
        Analyzer("logging-and-secrets", "Logging and secrets", ("python",), of("logging_and_secrets", *(f"ENT-LOG-00{i}" for i in range(1, 5))), python_facts.python_logging_and_secrets),
        Analyzer("architecture", "Architecture", ("python",), of("architectural_consistency", *(f"ENT-ARCH-00{i}" for i in range(1, 9))), python_modules.architecture_findings),
        Analyzer("duplication", "Duplicated functions", ("python",), of("code_duplication", *(f"ENT-DUP-00{i}" for i in range(1, 6))), lambda files: duplicates.duplicate_findings(duplicates.python_signatures(files))),
        Analyzer("lines", "Line rules", tuple(sorted({r.language for r in line_rules.RULES})), tuple((r.rule_id, r.category) for r in line_rules.RULES), line_rules.find),
    )
