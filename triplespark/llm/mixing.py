"""Mixing sources to target weights by whole repetitions and one hash-seeded draw."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .tables import CHUNK_COPIES, repeated, small, unit_hash, words

#: Relative weights of sources; any other source has DEFAULT_WEIGHT.
WEIGHTS, DEFAULT_WEIGHT, SEED = {"src0": 3.0, "src1": 2.0, "src2": 0.5}, 1.0, 17


def rates(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT) -> DataFrame:
    """(source, tokens, rate): how often a document of the source is emitted on average.

    A source's rate is its share of the weights times the tokens of all sources over its own, so that the mixture has
    about as many tokens as the input, in proportion to the weights. Tokens are runs of non-space characters, counted
    over all documents. A source without tokens has rate 1: its documents take no room. A null source is a source.
    """
    per = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("tokens"))
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
    per = per.withColumn("weight", F.when(F.col("tokens") > 0, F.coalesce(F.try_element_at(table, F.coalesce(F.col("source").cast("string"), F.lit(""))).cast("double"), F.lit(float(default)))))
    total = per.agg(F.sum("tokens").alias("all_tokens"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("all_weight") * F.col("all_tokens") / F.col("tokens")).otherwise(F.lit(1.0))
    return per.crossJoin(F.broadcast(total)).select("source", "tokens", rate.alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """Each row of docs floor(rate) times, and once more if a hash of its doc_id and the seed falls below the rest.

    The draw depends on nothing but doc_id and seed, so a recomputed task emits the same rows. ``copy`` names a column
    to add that numbers a row's copies from 0, a long. All columns of docs stay, whatever their names; rows that repeat
    a doc_id are drawn alike; a null doc_id hashes as a word of its own; a null or empty text counts no tokens and is
    emitted like any other of its source. Whole texts are counted, however long. doc_id may be of any type. A rate may
    be of any size: the copies of one row are spread over tasks. An empty table gives an empty one. The rates, a row a
    source, are written once, so the texts are read twice in all: to count and to emit.
    """
    spark = docs.sparkSession
    names = [f"__{i}" for i in range(len(docs.columns))]
    own = docs.withColumns({n: F.col(f"`{c}`") for n, c in zip(names, docs.columns, strict=True)}).select(*names, F.col("source").alias("__source"), F.col("doc_id").alias("__id"))
    found = rates(docs, weights, default).select(F.col("source").alias("__s"), F.col("rate").alias("__rate"))
    found = Scratch(spark, "mix").table(found, "rates")
    spread = (found.agg(F.max("__rate")).first()[0] or 0) > CHUNK_COPIES
    joined = own.join(small(found), F.col("__source").eqNullSafe(F.col("__s")))
    whole = F.floor("__rate")
    times = whole + (unit_hash("__id", seed=seed) < F.col("__rate") - whole).cast("long")
    out = repeated(joined.withColumn("__times", times), "__times", "__copy", spread)
    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return out.select(*kept, *([F.col("__copy").alias(copy)] if copy else []))


def mixture(spark: SparkSession, docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, source, copy) of every document the mixture emits; odd rows as in :func:`mix`."""
    return mix(docs.select("doc_id", "source", "text"), copy="copy", **parameters).select("doc_id", "source", "copy")
