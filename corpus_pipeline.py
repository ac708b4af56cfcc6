"""From documents to packed windows: each stage is one operator of triplespark.llm over all the last one kept.

Odd rows have one result in every stage but the last: a null or empty text is no toxic one, is no copy if null, has no
near copies, and is mixed like any other of its source; a row with a null doc_id is scored, mixed and packed and is no
copy; equal rows of one doc_id become one row; long texts are taken whole; an empty table stays empty; further columns
stay as they are, whatever their names. The last stage has a row for each piece and none for texts without tokens.
doc_id must be a whole number of up to 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triplespark.llm import exact_dedup, mixing, near_dedup, packing, scratch, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier, fitted on labels, doesn't reject; a score equal to the threshold stays."""
    return toxicity.non_toxic(spark, docs, sf_dir)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, that of the least doc_id; rows with a null doc_id or text all stay."""
    return exact_dedup.exact_dedup(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id; rows with a null doc_id or text all stay."""
    return near_dedup.near_dedup(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned so that sources have their target weights; equal doc_ids are drawn alike."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; equal rows are numbered copies."""
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: A classifier, MinHash groups and online packing have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written as Parquet and read again, so none is computed twice."""
    store = scratch.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.table(stage(spark, docs, sf_dir), name)
    return docs
