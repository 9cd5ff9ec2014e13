"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import piece_codec
from .bpe_codec import digests, encode_decode
from .common import read
from .decontaminate import hits
from .html_text import extract
from .near_dup import classes
from .periodic_runs import find_runs, plant_repeats, summaries
from .pii import find_spans
from .quality_classifier import classify
from .quality_rules import base_measures, measure
from .sharding import shard
from .spelling_variants import count_words, group_variants
from .substring_dedup import remove_repeats
from .token_count import count_tokens


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(read(spark, sf_dir, "documents"), drop_every=199))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(find_runs(plant_repeats(read(spark, sf_dir, "documents"))))


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op5 by themselves, which SQL can express: a classifier that accepts nothing adds no span."""
    return find_spans(read(spark, sf_dir, "documents"), model=[-30.0]).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of op6 by themselves, which SQL can express."""
    return base_measures(read(spark, sf_dir, "documents"), "text", ["doc_id"]).drop("_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_sharding": op4_sharding,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_near_dup": op9_near_dup,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_piece_codec": op11_piece_codec,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
    "base_personal_data": base_personal_data,
    "base_quality_measures": base_quality_measures,
}

#: op12 has SQL as a whole; the others are for the parts that do.
ORACLES: dict[str, str] = {
    "op12_spelling_variants": r"""
WITH RECURSIVE
  crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  run AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM
    (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY 1, 2),
  coded AS (SELECT doc_id, r, n, hex(encode(doc_id || ':' || r)) AS x FROM run),
  hashed AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
    FROM coded, crc),
  v AS (SELECT w AS word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w FROM hashed) WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
  cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
  near AS (SELECT a.word AS w, b.word AS o, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
  best AS (SELECT w, count(*) OVER (PARTITION BY w) AS n_near, o, n FROM near QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC, o) = 1),
  f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 5 * v.n THEN o END AS form, CASE WHEN b.n >= 5 * v.n THEN b.n END AS form_n FROM v LEFT JOIN best b ON w = word),
  chain AS (SELECT word, word AS at_word, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON f.word = c.next)
SELECT f.word, form, c.at_word AS root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN chain c ON c.word = f.word AND c.next IS NULL""",
    "base_personal_data": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
    list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS cards,
    list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones FROM d)
SELECT doc_id, len(emails) AS n_email,
  len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INTEGER), 256) > 255)) = 0)) AS n_ip,
  len(list_filter(cards, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN x[i]::INTEGER WHEN x[i]::INTEGER > 4 THEN 2 * x[i]::INTEGER - 9 ELSE 2 * x[i]::INTEGER END)) % 10 = 0)) AS n_card,
  len(list_filter(phones, lambda n: n BETWEEN 9 AND 15)) AS n_phone FROM m""",
    "base_quality_measures": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
  twice AS (SELECT doc_id, k FROM win GROUP BY 1, 2 HAVING count(*) > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM win JOIN twice USING (doc_id, k), range(0, 8) AS r(d) GROUP BY 1),
  m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(n, 0) > 30 * n_words AS base_failed FROM m LEFT JOIN rep USING (doc_id)""",
}
