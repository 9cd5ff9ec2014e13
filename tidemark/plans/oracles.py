"""DuckDB SQL for the registry's queries, over the same test tables."""

from __future__ import annotations

import re

from ..operators import python_endpoints as pe


def listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


VIEWS = {
    "v_finding": """
SELECT l_orderkey AS scan_id, o_custkey AS repository_id, o_orderdate AS started_at, p_brand AS rule_id, p_type AS category,
  'src/m' || (l_suppkey % 7) || '/f' || l_suppkey || '.py' AS file, l_linenumber AS line_start, l_linenumber + 2 AS line_end,
  CASE WHEN l_quantity >= 46 THEN 'critical' WHEN l_quantity >= 36 THEN 'high' WHEN l_quantity >= 21 THEN 'medium' WHEN l_quantity >= 6 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN l_discount <= 0.03 THEN 'high' WHEN l_discount <= 0.07 THEN 'medium' ELSE 'low' END AS confidence,
  substr(sha256(p_brand || ':' || l_suppkey || ':' || p_type), 1, 16) AS fingerprint,
  substr(sha256(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT), l_returnflag)), 1, 16) AS id,
  'sym_' || (l_partkey % 50) AS symbol, p_name AS title, l_returnflag AS side,
  CASE WHEN l_quantity >= 46 THEN 10.0 WHEN l_quantity >= 36 THEN 7.0 WHEN l_quantity >= 21 THEN 4.0 WHEN l_quantity >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE
    * CASE WHEN l_discount <= 0.03 THEN 1.0 WHEN l_discount <= 0.07 THEN 0.8 ELSE 0.5 END::DOUBLE AS w
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "v_cur": "SELECT * FROM v_finding WHERE side <> 'A'",
    "v_prev": "SELECT * FROM v_finding WHERE side = 'A'",
    "v_loc": "SELECT o_custkey AS repository_id, sum(l_quantity) AS loc FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "v_weight": "SELECT * FROM (VALUES ('STANDARD', 0.20::DOUBLE, 0), ('LARGE', 0.20, 1), ('SMALL', 0.15, 2), ('MEDIUM', 0.15, 3), ('ECONOMY', 0.15, 4), ('PROMO', 0.10, 5)) t(category, weight, ord)",
    "v_rule": """
SELECT repository_id, category, rule_id, count(*) AS n, sum(w) FILTER (rn <= 20) AS base FROM
  (SELECT *, row_number() OVER (PARTITION BY repository_id, category, rule_id ORDER BY w DESC) AS rn FROM v_finding) GROUP BY 1, 2, 3""",
    "v_score": """
SELECT l.repository_id, c.category, c.weight, c.ord, coalesce(p.n, 0) AS n_findings, coalesce(p.penalty, 0.0) AS penalty,
  round(CASE WHEN coalesce(p.penalty, 0) <= 0 THEN 0.0 ELSE least(100.0, greatest(0.0, 100.0 * (1.0 - exp(-(p.penalty / (greatest(l.loc, 200) / 1000.0)) / 40.0)))) END, 1) AS score
FROM v_loc l CROSS JOIN v_weight c LEFT JOIN
  (SELECT repository_id, category, sum(n)::BIGINT AS n, sum(CASE WHEN n > 20 THEN base + base / 20 * 5.0 * ln(1.0 + n - 20) ELSE base END) AS penalty FROM v_rule GROUP BY 1, 2) p USING (repository_id, category)""",
    "v_overall": """
SELECT repository_id, CAST(least(100, greatest(0, round_even(round(sum(score * weight) / sum(weight), 9), 0))) AS INTEGER) AS score, sum(n_findings)::BIGINT AS n_findings FROM v_score GROUP BY 1""",
    "v_scan": """
SELECT o_orderkey AS scan_id, o_custkey AS repository_id, 'repo-' || (o_custkey % 400) AS repo_name, o_orderdate AS started_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'scanning' ELSE 'failed' END AS status, CAST(floor(o_totalprice) AS BIGINT) % 101 AS score, o_orderpriority AS branch FROM orders""",
    "v_file": """
SELECT doc_id, source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'tests/' WHEN doc_id % 7 = 0 THEN 'node_modules/x/' WHEN doc_id % 11 = 0 THEN 'api/' ELSE 'src/' END
    || CASE WHEN doc_id % 13 = 0 THEN 'test_f' ELSE 'f' END || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'js' WHEN 'de' THEN 'go' ELSE 'md' END AS path,
  CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'go' ELSE 'unknown' END AS language, source AS repository_id, n_chars AS size, text AS content,
  CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END AS ls FROM documents""",
    "v_disposed": """
SELECT *, len(ls) AS line_count, CASE WHEN path LIKE '%/node_modules/%' THEN 'ignored_directory' WHEN size > 2097152 THEN 'file_too_large' WHEN language = 'unknown' THEN 'unsupported_language'
  WHEN path LIKE '%/tests/%' OR regexp_matches(path, '(^|/)test_[^/]*[.]py$') THEN 'scope_excluded' ELSE 'analyzable' END AS disposition FROM v_file""",
    "v_endpoint": """
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS file, path, CASE WHEN split_part(path, '/', 2) = '' THEN '/' ELSE '/' || split_part(path, '/', 2) END AS route_group,
  CAST(page_id % 40 AS INTEGER) AS line, page_id % 3 <> 0 AS guarded, CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, 'p' || (page_id % 97) AS pattern FROM
  (SELECT page_id, url, CASE WHEN length(c) > 1 THEN regexp_replace(c, '/$', '') ELSE c END AS path FROM
    (SELECT page_id, url, regexp_replace('/' || regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g') AS c FROM pages))""",
    "v_module": """
SELECT 'm' || c_custkey AS module, ['api', 'service', 'repository', 'model', 'config', 'utility'][c_custkey % 6 + 1] AS layer, c_mktsegment = 'MACHINERY' AS is_root FROM customer""",
    "v_edge": "SELECT DISTINCT 'm' || o_custkey AS src, 'm' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_partkey",
    "v_ledge": "SELECT e.src, e.dst, a.layer AS src_layer, b.layer AS dst_layer, a.is_root FROM v_edge e JOIN v_module a ON a.module = e.src JOIN v_module b ON b.module = e.dst",
    "v_label": "SELECT doc_id, lang, source, CAST(n_chars % 101 AS INTEGER) AS score, quality = 1 AS positive, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "v_assign": """
SELECT doc_id, value, -(SELECT sum(p * log2(p)) FROM (SELECT count(*) / length(value)::DOUBLE AS p FROM (SELECT unnest(string_split(value, '')) AS c) GROUP BY c)) AS bits
FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]+)"', 1)) AS value FROM documents)""",
    "v_dup": "SELECT exact_hash, min(doc_id) AS low, count(*) AS n FROM v_func GROUP BY 1 HAVING count(*) >= 2",
    "v_func": """
SELECT doc_id, source AS file, substr(sha256(text), 1, 16) AS exact_hash, n_chars AS size, lang,
  len(CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END) AS statements FROM documents""",
    "v_metric": """
SELECT repository_id, has_baseline, metric, actual FROM (UNPIVOT (
  SELECT o.repository_id, n.a > 0 AS has_baseline, o.score::DOUBLE AS score, (n.r - n.a)::DOUBLE AS score_delta, n.r::DOUBLE AS n_new, n.h::DOUBLE AS n_new_high, n.c::DOUBLE AS n_new_critical
  FROM v_overall o JOIN (SELECT repository_id, count(*) FILTER (side <> 'A') AS r, count(*) FILTER (side = 'A') AS a, count(*) FILTER (side <> 'A' AND severity = 'high') AS h, count(*) FILTER (side <> 'A' AND severity = 'critical') AS c FROM v_finding GROUP BY 1) n USING (repository_id))
  ON score, score_delta, n_new, n_new_high, n_new_critical INTO NAME metric VALUE actual)""",
    "v_policy": """
SELECT * FROM (VALUES ('max_score', 'absolute', 'score', 80.0::DOUBLE, 'fail'), ('max_delta', 'delta', 'score_delta', 5.0, 'fail'), ('warn_delta', 'delta', 'score_delta', 2.0, 'warn'),
  ('max_new', 'delta', 'n_new', 20.0, 'fail'), ('max_new_high', 'delta', 'n_new_high', 2.0, 'fail'), ('max_new_critical', 'delta', 'n_new_critical', 0.0, 'fail')) t(rule_name, kind, metric, threshold, verdict)""",
    "v_result": """
SELECT repository_id, rule_name, kind, threshold, round(coalesce(actual, 0), 6) AS actual,
  CASE WHEN kind = 'delta' AND NOT has_baseline THEN 'not_applicable' WHEN coalesce(actual, 0) > threshold THEN verdict ELSE 'pass' END AS status FROM v_metric JOIN v_policy USING (metric)""",
}

SQL = {
    "severity_histogram": "SELECT r.repository_id, s.severity, count(f.id) AS n FROM (SELECT DISTINCT repository_id FROM v_finding) r CROSS JOIN (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) s(severity) LEFT JOIN v_finding f ON f.repository_id = r.repository_id AND f.severity = s.severity GROUP BY 1, 2",
    "category_counts": "SELECT r.repository_id, s.category, count(f.id) AS n FROM (SELECT DISTINCT repository_id FROM v_finding) r CROSS JOIN v_weight s LEFT JOIN v_finding f ON f.repository_id = r.repository_id AND f.category = s.category GROUP BY 1, 2",
    "rule_penalty": "SELECT category, rule_id, n AS n_findings, round(CASE WHEN n > 20 THEN base + base / 20 * 5.0 * ln(1.0 + n - 20) ELSE base END, 6) AS penalty FROM (SELECT category, rule_id, count(*) AS n, sum(w) FILTER (rn <= 20) AS base FROM (SELECT *, row_number() OVER (PARTITION BY category, rule_id ORDER BY w DESC) AS rn FROM v_finding) GROUP BY 1, 2)",
    "category_score": "SELECT repository_id, category, n_findings, round(penalty, 6) AS penalty, score FROM v_score",
    "overall_score": "SELECT repository_id, score, CASE WHEN score <= 20 THEN 'very_low' WHEN score <= 40 THEN 'low' WHEN score <= 60 THEN 'moderate' WHEN score <= 80 THEN 'high' ELSE 'very_high' END AS band, n_findings FROM v_overall",
    "severity_floor": "SELECT *, CASE WHEN n_critical >= 2 THEN 81 WHEN n_critical = 1 THEN 61 WHEN n_high >= 1 THEN 41 ELSE 0 END AS floor FROM (SELECT repository_id, count(*) FILTER (t AND severity = 'critical') AS n_critical, count(*) FILTER (t AND severity = 'high') AS n_high FROM (SELECT *, confidence = 'high' AND rule_id IN ('Brand#1', 'Brand#2', 'Brand#3') AS t FROM v_finding) GROUP BY 1)",
    "score_bands": "SELECT CASE WHEN score <= 20 THEN 'very_low' WHEN score <= 40 THEN 'low' WHEN score <= 60 THEN 'moderate' WHEN score <= 80 THEN 'high' ELSE 'very_high' END AS band, count(*) AS n, min(score)::INTEGER AS low, max(score)::INTEGER AS high FROM v_scan GROUP BY 1",
    "worst_category": "SELECT repository_id, category AS worst_category, score AS worst_score FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY score DESC, ord) AS k FROM v_score) WHERE k = 1",
    "top_rules": "SELECT rule_id, n AS n_findings, round(base + CASE WHEN n > 20 THEN base / 20 * 5.0 * ln(1.0 + n - 20) ELSE 0 END, 6) AS penalty FROM (SELECT rule_id, count(*) AS n, sum(w) FILTER (rn <= 20) AS base FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY w DESC) AS rn FROM v_finding) GROUP BY 1) ORDER BY penalty DESC, n_findings DESC, rule_id LIMIT 10",
    "top_findings": "SELECT id, severity, file, line_start, rule_id FROM v_finding ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, file, line_start, rule_id, id LIMIT 20",
    "finding_lifecycle": "SELECT fingerprint, occurrence, CASE WHEN p.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'resolved' ELSE 'persistent' END AS state, coalesce(c.id, p.id) AS id, coalesce(c.severity, p.severity) AS severity FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY line_start, line_end, id)::INTEGER AS occurrence FROM v_cur) c FULL JOIN (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY line_start, line_end, id)::INTEGER AS occurrence FROM v_prev) p USING (fingerprint, occurrence)",
    "multiset_diff": "SELECT fingerprint, greatest(c - p, 0)::BIGINT AS n_new, greatest(p - c, 0)::BIGINT AS n_resolved, least(c, p)::BIGINT AS n_persistent FROM (SELECT fingerprint, count(*) FILTER (side <> 'A') AS c, count(*) FILTER (side = 'A') AS p FROM v_finding GROUP BY 1)",
    "rule_deltas": "SELECT rule_id, count(*) FILTER (side <> 'A') AS n_current, count(*) FILTER (side = 'A') AS n_previous, coalesce(min(category) FILTER (side <> 'A'), min(category)) AS category, count(*) FILTER (side <> 'A') - count(*) FILTER (side = 'A') AS delta FROM v_finding GROUP BY 1",
    "baseline_new": "SELECT id, fingerprint, rule_id FROM v_cur WHERE fingerprint NOT IN (SELECT fingerprint FROM v_prev)",
    "baseline_unchanged": "SELECT id, fingerprint, rule_id FROM v_cur WHERE fingerprint IN (SELECT fingerprint FROM v_prev)",
    "baseline_resolved": "SELECT fingerprint, id, rule_id, file FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY line_start DESC, id DESC) AS k FROM v_prev WHERE fingerprint NOT IN (SELECT fingerprint FROM v_cur)) WHERE k = 1",
    "first_seen": "SELECT fingerprint, first(scan_id ORDER BY started_at, scan_id) AS first_scan, count(*) AS occurrences, count(DISTINCT scan_id) AS scans FROM v_finding GROUP BY 1",
    "forbidden_rules": "SELECT rule_id, count(*) AS n FROM v_finding WHERE rule_id IN ('Brand#3', 'Brand#7', 'Brand#99') GROUP BY 1",
    "history_page": "SELECT scan_id, repository_id, strftime(started_at, '%Y-%m-%d') AS started_on, score::INTEGER AS score FROM v_scan WHERE status = 'completed' ORDER BY started_at DESC, scan_id DESC LIMIT 25 OFFSET 25",
    "recent_scans": "SELECT scan_id, strftime(started_at, '%Y-%m-%d') AS started_on, status FROM v_scan ORDER BY started_at DESC, scan_id DESC LIMIT 10",
    "score_trend": "SELECT repository_id, scan_id, row_number() OVER w::INTEGER AS point, score::INTEGER AS score, (score - lag(score) OVER w)::INTEGER AS change FROM v_scan WHERE status = 'completed' WINDOW w AS (PARTITION BY repository_id ORDER BY started_at, scan_id)",
    "category_trend": "SELECT s.scan_id, s.repository_id, n.category, n.n_findings FROM v_scan s LEFT JOIN (SELECT scan_id, category, count(*) AS n_findings FROM v_finding GROUP BY 1, 2) n USING (scan_id) WHERE status = 'completed'",
    "latest_per_key": "SELECT repository_id, branch, scan_id, score::INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, branch ORDER BY started_at DESC, scan_id DESC) AS k FROM v_scan) WHERE k = 1",
    "current_head": "SELECT repository_id, scan_id, row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, scan_id DESC) = 1 AS is_current_head FROM v_scan",
    "resolve_identifier": "SELECT i.identifier, coalesce((SELECT max(repository_id) FROM v_scan WHERE repository_id::VARCHAR = i.identifier), (SELECT repository_id FROM v_scan WHERE repo_name = i.identifier ORDER BY started_at DESC, scan_id::VARCHAR DESC LIMIT 1), (SELECT repository_id FROM v_scan WHERE 'scan-' || scan_id = i.identifier)) AS repository_id FROM (VALUES ('7'), ('repo-3'), ('scan-11'), ('nothing')) i(identifier)",
    "page_count": "SELECT status, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM v_scan GROUP BY 1",
    "scan_point_lookup": "SELECT scan_id, repository_id, status, score::INTEGER AS score FROM v_scan WHERE scan_id = 42",
    "upsert_scans": "SELECT scan_id, repository_id, CASE WHEN scan_id % 2 = 0 THEN repo_name ELSE 'other' END AS repo_name, CASE WHEN scan_id % 2 = 0 AND scan_id % 3 <> 0 THEN status ELSE 'completed' END AS status, (score + CASE WHEN scan_id % 2 = 0 AND scan_id % 3 <> 0 THEN 0 ELSE 1 END)::INTEGER AS score FROM v_scan",
    "upsert_coalesce": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'NEW' WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment, c_nationkey FROM customer",
    "idempotent_insert": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_id % 2 = 1 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 2 = 0)) WHERE k = 1",
    "policy_absolute": "SELECT repository_id, rule_name, threshold, actual, status FROM v_result WHERE kind = 'absolute'",
    "policy_delta": "SELECT repository_id, rule_name, threshold, actual, status FROM v_result WHERE kind = 'delta'",
    "policy_verdict": "SELECT repository_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS verdict, NOT bool_or(status = 'fail') AS passed, count(*) FILTER (status IN ('fail', 'warn')) AS n_violations FROM v_result GROUP BY 1",
    "findings_filter": "SELECT id, file, rule_id, line_start FROM v_finding WHERE category = 'PROMO' AND severity = 'high' AND contains(lower(file), 'm3/f1')",
    "findings_search": "SELECT id, title, file FROM v_finding WHERE contains(lower(title), 'ring') OR contains(lower(file), 'ring') OR contains(lower(rule_id), 'ring') OR contains(lower(symbol), 'ring')",
    "apply_suppressions": "SELECT rule_id, source, count(*) AS n, min(line) FILTER (source = 'inline') AS first_line FROM (SELECT f.rule_id, CASE WHEN f.rule_id = 'Brand#5' THEN 'config_rule' WHEN f.id IN (SELECT id FROM v_finding WHERE severity = 'critical' AND side = 'A') THEN 'config_finding' WHEN l.line IS NOT NULL THEN 'inline' ELSE 'active' END AS source, l.line FROM v_finding f LEFT JOIN (SELECT s.id, min(d.line_start) AS line FROM (SELECT DISTINCT id, file, rule_id, line_start, line_end FROM v_finding) s JOIN (SELECT DISTINCT file, rule_id, line_start FROM v_finding WHERE severity = 'info' AND confidence = 'low') d ON d.file = s.file AND d.rule_id = s.rule_id AND d.line_start BETWEEN greatest(1, s.line_start - 1) AND s.line_end GROUP BY 1) l ON l.id = f.id) GROUP BY 1, 2",
    "dedupe_first": "SELECT fingerprint, first(id ORDER BY scan_id, line_start, id) AS id FROM v_finding GROUP BY 1",
    "overlap_suppression": "SELECT rule_id, count(*) AS n FROM v_finding f WHERE NOT (rule_id = 'Brand#1' AND EXISTS (SELECT 1 FROM v_finding g WHERE g.rule_id = 'Brand#2' AND g.file = f.file AND g.line_start = f.line_start)) AND NOT (rule_id = 'Brand#4' AND EXISTS (SELECT 1 FROM v_finding g WHERE g.rule_id = 'Brand#3' AND g.file = f.file AND g.line_start = f.line_start)) GROUP BY 1",
    "union_findings": "SELECT category, count(*) AS n, count(DISTINCT rule_id) AS rules FROM v_finding GROUP BY 1",
    "enclosing_scope": "SELECT l.file, l.line_id, l.line, f.scope FROM (SELECT DISTINCT file, id AS line_id, line_start AS line FROM v_finding) l LEFT JOIN (SELECT p.file, p.line, first(s.span_id ORDER BY s.stop - s.start, s.span_id) AS scope FROM (SELECT DISTINCT file, line_start AS line FROM v_finding) p JOIN (SELECT file, line_start AS start, line_end AS stop, min(id) AS span_id FROM v_finding GROUP BY 1, 2, 3) s ON s.file = p.file AND p.line BETWEEN s.start AND s.stop GROUP BY 1, 2) f USING (file, line)",
    "group_inconsistency": "SELECT page_id, file, route_group, members, n_guarded FROM (SELECT *, count(*) OVER w AS members, count(*) FILTER (guarded) OVER w AS n_guarded FROM v_endpoint WINDOW w AS (PARTITION BY file, route_group)) WHERE NOT guarded AND members >= 2 AND n_guarded BETWEEN 1 AND members - 1",
    "duplicated_pattern": "SELECT page_id, pattern, endpoints FROM v_endpoint JOIN (SELECT pattern, count(DISTINCT path) AS endpoints FROM v_endpoint GROUP BY 1 HAVING count(DISTINCT path) >= 2) USING (pattern)",
    "middleware_scope": "SELECT r.file, r.page_id AS route_id, m.page_id AS mw_id FROM v_endpoint r JOIN (SELECT *, CASE WHEN method = 'POST' THEN path ELSE route_group END AS mount FROM v_endpoint) m ON m.file = r.file AND r.line > m.line AND (m.mount = '*' OR r.path = m.mount OR starts_with(r.path, m.mount || '/'))",
    "language_counts": "SELECT language, count(*) AS n_files FROM v_file GROUP BY 1",
    "file_disposition": "SELECT path, disposition FROM v_disposed",
    "manifest_summary": "SELECT repository_id, count(*) AS total_files, sum(size)::BIGINT AS total_bytes, coalesce(sum(line_count) FILTER (disposition = 'analyzable'), 0)::BIGINT AS total_loc, count(*) FILTER (disposition = 'analyzable') AS analyzable_files, count(*) FILTER (disposition <> 'analyzable') AS skipped_files, count(*) FILTER (disposition = 'scope_excluded') AS excluded_files FROM v_disposed GROUP BY 1",
    "directory_rollup": "SELECT directory, count(*) AS n_files, sum(size)::BIGINT AS n_bytes, CASE WHEN directory = '' THEN NULL WHEN contains(directory, '/') THEN regexp_extract(directory, '^(.*)/[^/]*$', 1) ELSE '' END AS parent FROM (SELECT size, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda n: array_to_string(list_slice(string_split(path, '/'), 1, n), '/'))) AS directory FROM v_file) GROUP BY 1",
    "scope_exclusion": "SELECT path, path LIKE '%/tests/%' OR path LIKE '%/node_modules/%' OR regexp_matches(path, '(^|/)test_[^/]*[.]py$') AS excluded FROM v_file",
    "detect_language": "SELECT path, language AS detected FROM v_file",
    "language_coverage": "SELECT repository_id, sum(n)::BIGINT AS loc, coalesce(sum(n) FILTER (language <> 'unknown'), 0)::BIGINT AS covered_loc, round(100.0 * coalesce(sum(n) FILTER (language <> 'unknown'), 0)::DOUBLE / sum(n)::DOUBLE, 6) AS covered_percent, coalesce(sum(n) FILTER (language <> 'unknown'), 0) < sum(n) AS is_partial, coalesce(string_agg(DISTINCT language, ',' ORDER BY language) FILTER (language <> 'unknown'), '') AS languages FROM (SELECT *, len(ls) AS n FROM v_file) GROUP BY 1",
    "line_counts": "SELECT path, count(*) AS lines, count(*) FILTER (line = '') AS blank, max(length(line))::INTEGER AS longest FROM (SELECT path, unnest(ls) AS line FROM v_file) GROUP BY 1",
    "snippets": "SELECT path, substr(sha256(array_to_string(list_slice(ls, 1, 4), chr(10))), 1, 16) AS snippet_hash FROM v_file",
    "fingerprints": "SELECT substr(sha256(rule_id || ':' || file || ':' || symbol || ':' || category), 1, 16) AS fp, count(*) AS n FROM v_finding GROUP BY 1",
    "json_extract": "SELECT k % 10 AS bucket, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events) GROUP BY 1",
    "sarif_levels": "SELECT CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, rule_id, count(*) AS n, min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END)::INTEGER AS top_rank FROM v_finding GROUP BY 1, 2",
    "route_groups": "SELECT route_group, count(*) AS n, count(DISTINCT path) AS paths FROM v_endpoint GROUP BY 1",
    "public_endpoint": f"""
WITH h AS (SELECT page_id, lower(CASE WHEN page_id % 8 = 7 THEN path ELSE ['/login', '/api/v1/health', '/auth/users', '/admin/health', '/password-recovery/x', '/docs/a', '/oauth/token/'][page_id % 8 + 1] END) AS path,
    CASE WHEN page_id % 5 = 0 THEN 'purge_all_users' ELSE pattern END AS symbol, method = 'POST' AS changes, page_id % 11 = 0 AS marked FROM v_endpoint),
  s AS (SELECT *, list_filter(string_split(split_part(path, '?', 1), '/'), lambda x: x <> '') AS p FROM h),
  r AS (SELECT *, {listed(pe.ROUTE_PREFIXES)} AS pre, regexp_matches(replace(array_to_string(list_append(p, lower(symbol)), '/'), '_', '-'), '{"|".join(pe.NEVER_PUBLIC)}') AS denied,
    [array_to_string(p, '/'), CASE WHEN list_contains({listed(pe.ROUTE_PREFIXES)}, p[1]) THEN array_to_string(p[2:], '/') END, CASE WHEN list_contains({listed(pe.ROUTE_PREFIXES)}, p[1]) AND list_contains({listed(pe.ROUTE_PREFIXES)}, p[2]) THEN array_to_string(p[3:], '/') END] AS tried FROM s)
SELECT page_id, NOT (len(p) > 0 AND denied) AND (NOT changes OR regexp_matches(path, '{"|".join(pe.CHANGING_PUBLIC)}'))
  AND (len(list_filter(tried, lambda t: coalesce(regexp_full_match(t, '{"|".join(x.replace(".", "[.]").replace("*", "[^/]+") for x in pe.PUBLIC_ROUTES)}'), false))) > 0 OR list_contains({listed(pe.PUBLIC_EXACT)}, rtrim(path, '/'))
    OR regexp_matches(path, '^({"|".join(pe.PUBLIC_STARTS)})') OR marked) AS is_public FROM r""",
    "bits_per_char": "SELECT doc_id, value, round(bits, 6) AS bits FROM v_assign",
    "secret_candidates": "SELECT doc_id, value FROM v_assign WHERE length(value) >= 8 AND value <> '123456' AND (length(value) >= 12 AND (bits > 3.3 OR length(value) >= 20))",
    "mask_secret": "SELECT doc_id, CASE WHEN length(value) > 10 THEN substr(value, 1, 4) || '...' || right(value, 4) ELSE '***' END AS masked FROM v_assign",
    "redact_secrets": "SELECT doc_id, substr(sha256(regexp_replace(text, '(?i)(token)(\\s*=\\s*)\"[^\"\\n]+\"', '\\1\\2\"[REDACTED_SECRET]\"', 'g')), 1, 16) AS redacted_hash FROM documents",
    "exact_duplicates": "SELECT d.low AS representative, f.doc_id AS member FROM v_func f JOIN v_dup d USING (exact_hash) WHERE f.doc_id <> d.low",
    "similar_candidates": "WITH c AS (SELECT lang, statements, size, min(doc_id) AS rep, count(*) AS n FROM v_func GROUP BY 1, 2, 3) SELECT a.rep AS a, b.rep AS b, a.n AS n_a, b.n AS n_b, round(2.0 * least(a.size, b.size) / (a.size + b.size), 6) AS bound FROM c a JOIN c b ON a.lang = b.lang AND a.statements = b.statements AND (a.rep < b.rep OR a.rep = b.rep AND a.n > 1) AND abs(a.size // 6 - b.size // 6) <= 1 WHERE 2.0 * least(a.size, b.size) / (a.size + b.size) >= 0.85",
    "length_bound_pairs": "WITH c AS (SELECT lang, statements, size, min(doc_id) AS rep, count(*) AS n FROM v_func WHERE size > 0 GROUP BY 1, 2, 3) SELECT a.rep AS a, b.rep AS b, a.n AS n_a, b.n AS n_b, round(2.0 * least(a.size, b.size) / (a.size + b.size), 6) AS bound FROM c a JOIN c b ON a.lang = b.lang AND a.statements = b.statements AND (a.rep < b.rep OR a.rep = b.rep AND a.n > 1) WHERE 2.0 * least(a.size, b.size) / (a.size + b.size) >= 0.85",
    "size_class_members": "SELECT doc_id AS member, min(doc_id) OVER (PARTITION BY lang, statements, size) AS representative FROM v_func",
    "central_config": "WITH c AS (SELECT module FROM v_module WHERE layer = 'config'), d AS (SELECT count(DISTINCT src) AS dependents FROM v_edge WHERE dst IN (FROM c) AND src IN (SELECT module FROM v_module)), n AS (SELECT count(*) AS modules FROM v_module) SELECT dependents, modules, dependents >= 3 OR dependents > 0 AND dependents >= 0.15 * modules AS is_convention FROM d, n",
    "path_exclusions": "SELECT path, coalesce(contains(path, 'tests/') OR contains(path, 'test_'), false) OR path LIKE '%/node_modules/%' AS no_duplication, contains(path, 'tests/') OR contains(path, 'node_modules/') AS no_architecture FROM v_file",
    "search_files": "SELECT path, language FROM v_file WHERE contains(lower(path), 'src/') AND language = 'go'",
    "overall_with_floor": "SELECT repository_id, score, CASE WHEN score <= 20 THEN 'very_low' WHEN score <= 40 THEN 'low' WHEN score <= 60 THEN 'moderate' WHEN score <= 80 THEN 'high' ELSE 'very_high' END AS band, n_findings FROM (SELECT repository_id, greatest(o.score, coalesce(CASE WHEN c >= 2 THEN 81 WHEN c = 1 THEN 61 WHEN h >= 1 THEN 41 ELSE 0 END, 0))::INTEGER AS score, n_findings FROM v_overall o LEFT JOIN (SELECT repository_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM v_finding WHERE confidence = 'high' AND rule_id IN ('Brand#1', 'Brand#2', 'Brand#3') AND category IN (SELECT category FROM v_weight) GROUP BY 1) f USING (repository_id))",
    "policy_categories": "SELECT repository_id, category, 'categories.' || category || '.max_score' AS rule_name, CASE category WHEN 'STANDARD' THEN 60.0 ELSE 20.0 END AS threshold, score AS actual, CASE WHEN category = 'STANDARD' AND score > 60 THEN 'fail' WHEN category = 'PROMO' AND score > 20 THEN 'warn' ELSE 'pass' END AS status FROM v_score WHERE category IN ('STANDARD', 'PROMO')",
    "connected_components": "SELECT f.doc_id AS node, d.low AS component FROM v_func f JOIN v_dup d USING (exact_hash)",
    "cluster_summary": "SELECT d.low AS component, first(f.doc_id ORDER BY f.file, f.doc_id) AS representative, count(*) AS members, count(DISTINCT f.file) AS files, 1.0::DOUBLE AS avg_similarity, true AS is_exact, CASE WHEN count(*) >= 3 THEN 'ENT-DUP-005' WHEN count(DISTINCT f.file) > 1 THEN 'ENT-DUP-004' ELSE 'ENT-DUP-001' END AS rule_id FROM v_func f JOIN v_dup d USING (exact_hash) GROUP BY 1",
    "boilerplate": "WITH s AS (SELECT *, lang || '-' || statements AS shape FROM v_func) SELECT shape, count(*) AS members, count(DISTINCT file) AS files FROM s WHERE shape IN (SELECT shape FROM s GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT file) >= 2) AND exact_hash NOT IN (SELECT exact_hash FROM v_dup) GROUP BY 1 HAVING count(*) >= 3",
    "short_cycles": "WITH RECURSIVE c AS (SELECT 'm' || c_custkey AS module, c_nationkey AS nation FROM customer), e AS (SELECT a.nation, v.src, v.dst FROM v_edge v JOIN c a ON a.module = v.src JOIN c b ON b.module = v.dst WHERE a.nation = b.nation), r AS (SELECT nation, src AS s, [src, dst] AS path, dst AS last FROM e WHERE dst > src UNION ALL SELECT r.nation, s, list_append(path, e.dst), e.dst FROM r JOIN e ON e.nation = r.nation AND e.src = r.last WHERE e.dst > s AND NOT list_contains(path, e.dst) AND len(path) < 4) SELECT nation, array_to_string(path, '->') AS cycle, len(path)::BIGINT AS length FROM r JOIN e USING (nation) WHERE e.src = r.last AND e.dst = r.s QUALIFY row_number() OVER (PARTITION BY nation ORDER BY len(path), path) <= 100",
    "strong_components": "WITH RECURSIVE c AS (SELECT 'm' || c_custkey AS module, c_nationkey AS nation FROM customer), e AS (SELECT a.nation, v.src, v.dst FROM v_edge v JOIN c a ON a.module = v.src JOIN c b ON b.module = v.dst WHERE a.nation = b.nation), r AS (SELECT nation, src AS a, dst AS b FROM e UNION SELECT r.nation, r.a, e.dst FROM r JOIN e ON e.nation = r.nation AND e.src = r.b) SELECT x.nation, x.a AS module, min(x.b) AS component FROM r x JOIN r y ON x.nation = y.nation AND x.a = y.b AND x.b = y.a GROUP BY 1, 2",
    "module_degrees": "SELECT m.module, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) AS fan_in FROM v_module m LEFT JOIN (SELECT src AS module, count(*) AS n FROM v_edge GROUP BY 1) o USING (module) LEFT JOIN (SELECT dst AS module, count(*) AS n FROM v_edge GROUP BY 1) i USING (module)",
    "layer_violations": "SELECT src, count(DISTINCT dst) AS n_repositories FROM v_ledge WHERE src_layer = 'api' AND dst_layer = 'repository' GROUP BY 1",
    "cross_layer_coupling": "SELECT src, count(DISTINCT dst_layer) AS n_layers FROM v_ledge WHERE NOT is_root GROUP BY 1 HAVING count(DISTINCT dst_layer) >= 4",
    "dominant_pattern": "WITH api AS (SELECT m.module, m.module IN (SELECT src FROM v_ledge WHERE dst_layer = 'service') AS u FROM v_module m WHERE layer = 'api'), r AS (SELECT avg(u::INTEGER) AS rate, count(*) AS n FROM api) SELECT module, round(rate, 6) AS rate FROM api, r WHERE NOT u AND n >= 3 AND rate >= 0.65",
    "god_objects": "SELECT file, count(DISTINCT symbol) AS n_members, count(DISTINCT category) AS n_domains FROM v_finding GROUP BY 1 HAVING count(DISTINCT symbol) >= 10 AND count(DISTINCT category) >= 3",
    "module_edges": "SELECT DISTINCT i.src, a.dst FROM (SELECT 'm' || l_suppkey AS src, 'n' || (l_partkey % 300) AS name FROM lineitem) i JOIN (SELECT 'n' || (p_partkey % 250) AS name, 'm' || (max(p_partkey) % 90) AS dst FROM part GROUP BY 1) a USING (name) WHERE i.src <> a.dst",
    "layer_inference": "SELECT CASE WHEN path LIKE '%/api/%' THEN 'api' ELSE 'unknown' END AS layer, language, count(*) AS n FROM v_file GROUP BY 1, 2",
    "roc_auc": "SELECT c.lang, round(CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(u) / (max(np) * max(nn)) ELSE 0.5 END, 6) AS auc, max(np) AS n_positive, max(nn) AS n_negative FROM (SELECT p.lang, count(*) FILTER (n.score < p.score) + 0.5 * count(*) FILTER (n.score = p.score) AS u FROM (SELECT * FROM v_label WHERE positive) p JOIN (SELECT * FROM v_label WHERE NOT positive) n USING (lang) GROUP BY 1) a RIGHT JOIN (SELECT lang, count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nn FROM v_label GROUP BY 1) c ON c.lang = a.lang GROUP BY 1",
    "score_distribution": "SELECT lang, count(*) AS n, min(score) AS min, max(score) FILTER (rn = floor(0.25 * (n - 1)) + 1) AS p25, max(score) FILTER (rn = floor(0.5 * (n - 1)) + 1) AS median, max(score) FILTER (rn = floor(0.75 * (n - 1)) + 1) AS p75, max(score) AS max, round(avg(score), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM v_label) GROUP BY 1",
    "rule_precision": "SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision FROM (SELECT source, count(*) FILTER (toxic <> 1 AND quality = 1) AS tp, count(*) FILTER (toxic <> 1 AND quality <> 1) AS fp, count(*) FILTER (toxic = 1) AS unsure FROM v_label GROUP BY 1)",
    "class_separation": "SELECT round(avg(score) FILTER (positive) - avg(score) FILTER (NOT positive), 6) AS gap, min(score) FILTER (positive) AS min_positive, max(score) FILTER (NOT positive) AS max_negative, min(score) FILTER (positive) > max(score) FILTER (NOT positive) AS separated FROM v_label",
    "event_dedupe": "SELECT user_id, event_type, first(event_id ORDER BY ts, event_id) AS event_id, count(*) AS copies FROM events GROUP BY 1, 2",
    "event_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "cache_misses": "SELECT event_id, sha256(user_id::VARCHAR) AS cache_key FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "inline_directives": "SELECT path AS file, i::INTEGER AS line_number, unnest(['ENT-LOG-' || length(line), 'ENT-ERR-001']) AS rule_id FROM (SELECT path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM v_file) WHERE starts_with(line, 'Licensed under')",
    "gitignore_last_match": "SELECT path, CASE WHEN regexp_matches(path, '^src[2-4]/api(/|$)') THEN true WHEN regexp_matches(path, '(^|/)f1[^/]*[.]md(/|$)') THEN false WHEN contains(path, 'node_modules/') THEN true WHEN regexp_matches(path, '^src1/') THEN true WHEN path LIKE '%.md' THEN true ELSE false END AS is_ignored FROM v_file",
}


def full(sql: str) -> str:
    """``sql`` with the views it uses, and those that these use, as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for v in dict.fromkeys(re.findall(r"\bv_[a-z]+\b", text)):
            if v in VIEWS and v not in need:
                visit(VIEWS[v])
                need.append(v)

    visit(sql)
    if not need:
        return sql
    views = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in need)
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {sql[15:]}"
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"


ORACLES = {k: full(v.strip()) for k, v in SQL.items()}
