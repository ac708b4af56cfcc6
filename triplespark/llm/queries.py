"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import capture_index, exact_dedup, importance, langid, mixing, near_dedup, packing, quality_rules, secrets, toxicity
from .tables import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(spark, read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(spark, read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(spark, read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(spark, read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(spark, read(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(spark, read(spark, sf_dir, "documents"))


def op9_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_index.captures_of_pages(spark, read(spark, sf_dir, "pages"))


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, which lies beside the package and isn't part of it when that is installed alone."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_capture_index": op9_capture_index,
    "op10_importance": op10_importance,
    "pipeline": pipeline,
}

_WEIGHTS = " ".join(f"WHEN '{source}' THEN {weight}" for source, weight in mixing.WEIGHTS.items())

ORACLE: dict[str, str] = {
    "op4_mixing": rf"""
        WITH per AS (
            SELECT source, sum(len(regexp_extract_all(text, '[^ \t\n\r]+')))::BIGINT AS tokens FROM documents GROUP BY source),
        weighed AS (
            SELECT *, CASE WHEN tokens > 0 THEN CASE source {_WEIGHTS} ELSE {mixing.DEFAULT_WEIGHT} END::DOUBLE END AS weight FROM per),
        rated AS (
            SELECT source, CASE WHEN tokens > 0 THEN weight / sum(weight) OVER () * sum(tokens) OVER () / tokens ELSE 1.0::DOUBLE END AS rate FROM weighed),
        drawn AS (
            SELECT d.doc_id, d.source, floor(rate)::BIGINT + (
                ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(d.doc_id::VARCHAR, 'null'))), 1, 13))::BIGINT / {float(1 << 52)} < rate - floor(rate))::BIGINT AS times
            FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, source, unnest(range(times))::BIGINT AS copy FROM drawn""",
    "op9_capture_index": r"""
        WITH low AS (SELECT page_id, lower(trim(url)) AS u FROM pages),
        cut AS (
            SELECT page_id, regexp_replace(regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1), '^www[0-9]*\.', '') AS host,
                regexp_extract(u, '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?[^/:?#]*:([0-9]+)', 1) AS port,
                regexp_replace(regexp_extract(u, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
                regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query FROM low),
        keyed AS (
            SELECT page_id, CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')'
                || CASE path WHEN '' THEN '/' ELSE path END || CASE query WHEN '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END AS url_key FROM cut)
        SELECT page_id, url_key, CASE WHEN url_key IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY url_key) END AS captures,
            CASE WHEN url_key IS NOT NULL THEN min(page_id) OVER (PARTITION BY url_key) END AS first_page_id FROM keyed""",
    "op7_exact_dedup": """
        SELECT DISTINCT doc_id, keep_id FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
        WHERE doc_id <> keep_id""",
}
