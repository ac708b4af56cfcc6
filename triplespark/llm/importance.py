"""Quality classifier by importance resampling (Xie et al., 2023).

Two bags of hashed n-grams of words and of runs of punctuation are generative models of the target texts and of the raw corpus. The log ratio of a
document's likelihoods is its importance weight; adding Gumbel noise and taking the k highest samples k documents
without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .scratch import Scratch
from .tables import small, unit_hash

BITS, FRACTION, SEED = 14, 0.85, 29


def punctuation_lut() -> np.ndarray:
    """Maps bytes to ASCII punctuation and symbols; all else becomes a space."""
    return np.array([c if c < 128 and chr(c) in string.punctuation else 32 for c in range(256)], np.uint8)


_PUNCTUATION = punctuation_lut()


def ngram_buckets(raw: np.ndarray, offs: np.ndarray, bits: int, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each document's words, of its pairs of neighbouring words, and the same of its runs of punctuation,
    with their documents."""
    buckets, docs, shift = [], [], np.uint64(64 - bits)
    for kind in (lut, _PUNCTUATION):
        h, wo = textvec.words(raw, offs, kind)
        doc = textvec.doc_of(wo)
        same = np.flatnonzero(doc[1:] == doc[:-1])
        with np.errstate(over="ignore"):
            pairs = textvec.mix(h[same] * np.uint64(0x9E3779B97F4A7C15) + h[same + 1])
        buckets += [h >> shift, pairs >> shift]
        docs += [doc, doc[same]]
    return np.concatenate(buckets).astype(np.int64), np.concatenate(docs)


def _counter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, count = textvec.byte_lut(), np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            target = batch["target"].to_numpy(zero_copy_only=False)
            for lo, hi, raw, offs in textvec.chunks(batch["text"]):
                bucket, doc = ngram_buckets(raw, offs, bits, lut)
                count[0] += np.bincount(bucket, minlength=1 << bits)
                count[1] += np.bincount(bucket[target[lo:hi][doc]], minlength=1 << bits)
        some = np.flatnonzero(count[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[0][some]), pa.array(count[1][some])], ["bucket", "raw", "target"])

    return run


def log_ratio(raw: np.ndarray, target: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log(target probability / raw probability) of each bucket, by smoothed counts; zeros without any target."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + smooth) / (target.sum() + smooth * len(target))) - np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))


def weights_of(texts: pa.Array, ratio: np.ndarray, bits: int) -> np.ndarray:
    lut, out = textvec.byte_lut(), np.zeros(len(texts))
    for lo, hi, raw, offs in textvec.chunks(texts):
        bucket, doc = ngram_buckets(raw, offs, bits, lut)
        out[lo:hi] = np.bincount(doc, ratio[bucket], hi - lo)
    return out


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, score, selected) for every row of docs; ``selected`` marks the ceil(fraction n) highest.

    The raw model counts all documents, the target model all documents labelled of quality 1. ``score`` is the weight
    plus Gumbel noise from a hash of doc_id and the seed, so a recomputed task draws the same. Ranks come from one
    range-partitioned sort, written with each row's place in its partition: no row goes to the driver, only the
    partitions' sizes. Equal scores rank by doc_id, nulls last; of equal rows either may be the last selected. A null
    or empty text has no n-gram and weight 0, as has every text without a target. Texts are weighed whole, however long;
    an empty table gives an empty result; doc_id may be of any type that orders; other columns don't count, whatever
    their names; labels of unknown documents and null ones are skipped.
    """
    scratch = Scratch(spark, "resample")
    good = scratch.table(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__good")).distinct(), "good")
    marked = docs.select("doc_id", "text").join(small(good), F.col("doc_id") == F.col("__good"), "left")
    marked = marked.select(F.coalesce("text", F.lit("")).alias("text"), F.col("__good").isNotNull().alias("target"))
    counts = marked.mapInArrow(_counter(bits), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    table = np.zeros((2, 1 << bits))
    table[:, counts["bucket"].to_numpy(int)] = counts[["raw", "target"]].to_numpy(float).T
    sent = spark.sparkContext.broadcast((log_ratio(table[0], table[1]), bits))
    weigh = F.arrow_udf(lambda text: pa.array(weights_of(text, *sent.value)), "double")
    u = unit_hash("doc_id", seed=seed) + F.lit(0.5 / (1 << 52))
    scored = docs.select("doc_id", weigh(F.coalesce("text", F.lit(""))).alias("log_weight"))
    scored = scratch.table(scored.withColumn("score", F.col("log_weight") - F.log(-F.log(u))), "scored")
    ranked = scored.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ranked = scratch.table(ranked, "ranked")
    sizes = ranked.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    left = math.ceil(fraction * sum(r["count"] for r in sizes))
    last = -1
    for r in sizes:
        if left <= 0:
            break
        last = (r["part"] << 33) + min(left, r["count"]) - 1
        left -= r["count"]
    return ranked.select("doc_id", "log_weight", "score", (F.col("at") <= F.lit(last)).alias("selected"))
