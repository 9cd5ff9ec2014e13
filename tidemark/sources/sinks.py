"""Findings out: JSON lines, SARIF, baselines, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.findings import SARIF_LEVEL
from ..schema import pick, severity_rank


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON text a row, in canonical order."""
    return findings.orderBy("file", "line_start", "rule_id", "id").select(F.to_json(F.struct(*findings.columns)).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result object for each finding, beside what orders it; columns count from 1 there."""
    region = [F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine")]
    if "column_start" in findings.columns:
        region += [(F.col("column_start") + 1).alias("startColumn"), (F.col("column_end") + 1).alias("endColumn")]
    region = F.struct(*region)
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(
        "file", "line_start", "line_end", "id", "rule_id", "title",
        F.struct(F.col("rule_id").alias("ruleId"), pick(F.col("severity"), SARIF_LEVEL, "none").alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"), F.create_map(F.lit("primary"), F.col("fingerprint")).alias("partialFingerprints")).alias("result")
    )


def sarif(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """The whole SARIF 2.1.0 document as one JSON text; for one scan's report, as one document can't be distributed."""
    place = ["file", "line_start", "line_end", "id"]
    first = findings.groupBy("rule_id").agg(F.min_by("title", F.struct(*place)).alias("title"))  # the title of a rule's first finding
    rules = first.agg(F.array_sort(F.collect_list(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription")))).alias("rules"))
    # a map can't be compared, so the order is taken from the columns before it
    in_order = F.array_sort(F.collect_list(F.struct(*place, F.to_json("result").alias("json"))))
    kind = sarif_results(findings).schema["result"].dataType
    results = sarif_results(findings).agg(F.transform(in_order, lambda x: F.from_json(x["json"], kind)).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return rules.join(results).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def baseline(findings: DataFrame) -> DataFrame:
    """Rows of a baseline in its order; suppressed findings stay out where the column says so."""
    kept = findings.where("not coalesce(is_suppressed, false)") if "is_suppressed" in findings.columns else findings
    return kept.orderBy("file", "line_start", "rule_id", "fingerprint").select("fingerprint", "rule_id", "file", "line_start", "severity", "category", "id")


def validation_report(results: DataFrame, findings: DataFrame, key: str = "repo", top: int = 10) -> DataFrame:
    """``results`` with the columns of the CSV report that come from findings: their number, those by category, and the gravest rules."""
    by_category = findings.groupBy(key, "category").agg(F.count("*").alias("n")).groupBy(key).agg(
        F.sum("n").alias("findings_count"), F.array_join(F.array_sort(F.collect_list(F.concat("category", F.lit(":"), F.col("n").cast("string")))), "; ").alias("findings_by_category")
    )
    place = Window.partitionBy(key).orderBy(severity_rank(F.col("severity")), "file", "line_start", "rule_id", "id")
    best = findings.select(key, "severity", "rule_id", F.row_number().over(place).alias("turn")).where(F.col("turn") <= top)
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "rule_id", "severity"))), lambda x: F.concat(x["rule_id"], F.lit("("), x["severity"], F.lit(")")))
    rules = best.groupBy(key).agg(F.array_join(said, "; ").alias("top_10_rules"))
    return results.join(by_category, key, "left").join(rules, key, "left").na.fill({"findings_count": 0, "findings_by_category": "", "top_10_rules": ""})


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A Markdown table of rows that are few enough for one report; for the caller to limit."""
    out = ["| " + " | ".join(columns) + " |", "|" + " :--- |" * len(columns)]
    return "\n".join([*out, *("| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows.select(*columns).collect())])


def change_summary(new: DataFrame, resolved: DataFrame, base: int | None, head: int | None, verdict: str | None = None, new_shown: int = 15, resolved_shown: int = 10) -> str:
    """Text of a pull request's check: scores, counts, and the first new and resolved findings."""
    order = ["file", "line_start", "rule_id", "id"]
    n_new, n_resolved = new.count(), resolved.count()
    delta = (head or 0) - (base or 0)
    out = [f"Debt score: {head or 0}/100 ({delta:+d})" if delta else f"Debt score: {head or 0}/100 (0)"]
    out += [f"Policy: {verdict.upper()}"] if verdict else []
    out += [f"New findings: {n_new}", f"Resolved findings: {n_resolved}", "", "### New"]
    out += [f"- **{r.rule_id}** (`{r.severity}`): {r.title} in `{r.file}:{r.line_start}`" for r in new.orderBy(*order).limit(new_shown).collect()] or ["*(none)*"]
    out += [f"- *...and {n_new - new_shown} more*"] if n_new > new_shown else []
    if n_resolved:
        out += ["", "### Resolved"] + [f"- **{r.rule_id}**: {r.title} in `{r.file}:{r.line_start}`" for r in resolved.orderBy(*order).limit(resolved_shown).collect()]
        out += [f"- *...and {n_resolved - resolved_shown} more*"] if n_resolved > resolved_shown else []
    return "\n".join(out)
