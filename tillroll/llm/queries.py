"""The operators' registered queries: ``QUERIES`` and, where SQL gives the same rows, ``SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import scan
from tillroll.llm.curve_packing import curve_pack
from tillroll.llm.decontaminate import contamination, digest
from tillroll.llm.exact_dedup import exact_dedup
from tillroll.llm.license_scan import license_scan
from tillroll.llm.line_dedup import line_dedup
from tillroll.llm.lm_score import lm_scores
from tillroll.llm.packing import pack
from tillroll.llm.periodic_runs import digest as runs_digest
from tillroll.llm.periodic_runs import periodic_runs
from tillroll.llm.quality import quality_scores
from tillroll.llm.simhash import near_duplicates
from tillroll.llm.spelling import MODULUS, spelling_variants
from tillroll.llm.suffix_dedup import suffix_dedup
from tillroll.llm.token_count import token_counts


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(scan(spark, sf_dir))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(scan(spark, sf_dir), scan(spark, sf_dir, "benchmark")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(scan(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(scan(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup(scan(spark, sf_dir))
    return left.select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(scan(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup(scan(spark, sf_dir))
    return left.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(scan(spark, sf_dir), scan(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(scan(spark, sf_dir))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(scan(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_digest(periodic_runs(scan(spark, sf_dir), repeats=True))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_pack(scan(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(scan(spark, sf_dir), modulus=MODULUS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_benchmark_decontamination,
        op3_license_scan,
        op4_exact_dedup,
        op5_line_dedup,
        op6_token_counts,
        op7_suffix_array_dedup,
        op8_quality_classifier,
        op9_lm_scoring,
        op10_simhash_near_dedup,
        op11_periodic_runs,
        op12_packing,
        op13_spelling_variants,
    )
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = rf"""
WITH item AS (SELECT CAST(coalesce(CAST(item_id AS VARCHAR), '') AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark),
w AS (
  SELECT DISTINCT item, least(len(words), 10) AS width,
         words[p : p + least(len(words), 10) - 1] AS win
  FROM item, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(p) WHERE len(words) > 0
),
doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
widths AS (SELECT DISTINCT width FROM w),
place AS (
  SELECT doc_id, p, width, words[p : p + width - 1] AS win
  FROM doc, widths, unnest(range(1, len(words) - width + 2)) AS t(p)
),
found AS (SELECT doc_id, p, place.width, item FROM place JOIN w ON place.width = w.width AND place.win = w.win),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + width)) AS t(q) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP4_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body,
         translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW best AS (PARTITION BY norm ORDER BY length(body) DESC, doc_id NULLS LAST)
"""

OP5_SQL = """
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
win AS (
  SELECT doc_id, p, lines[p : p + 2] AS win FROM doc, unnest(range(1, len(lines) - 1)) AS t(p)
),
later AS (
  SELECT doc_id, p FROM win
  QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1
),
gone AS (SELECT DISTINCT doc_id, q FROM later, unnest(range(p, p + 3)) AS t(q)),
spans AS (
  SELECT doc_id, list(q) AS gone, count(*) AS n_removed, sum(CASE WHEN before = q - 1 THEN 0 ELSE 1 END) AS n_spans
  FROM (SELECT doc_id, q, lag(q) OVER (PARTITION BY doc_id ORDER BY q) AS before FROM gone) GROUP BY doc_id
)
SELECT doc_id, len(lines) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(array_to_string(
         [lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(coalesce(gone, []), i)],
         chr(10))) AS kept_sha256
FROM doc LEFT JOIN spans USING (doc_id)
"""

SQL = {
    "op2_benchmark_decontamination": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
}
