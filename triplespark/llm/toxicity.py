"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

The model of Wang and Manning (2012): each n-gram's smoothed log-count ratio between toxic and other labelled texts
scales log2(1 + its count in the text), and a logistic regression is fitted over these features. A single occurrence
weighs as mere presence would; a long text that repeats an n-gram differs from one that has it by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .linear import fit_logistic
from .scratch import Scratch
from .tables import read

#: Labelled documents of each class that the fit reads at most, the lowest by a hash of doc_id.
TRAIN_PER_CLASS = 2000
SIZES, BITS, FEATURES = (4, 5, 6), 20, 10_000


@dataclass
class Model:
    """Weights of the buckets, already scaled by their ratios, and the intercept; without weights nothing is toxic."""

    weights: np.ndarray
    intercept: float
    bits: int = BITS
    sizes: tuple[int, ...] = SIZES


def _counted(raw: np.ndarray, offs: np.ndarray, table: np.ndarray, sizes: tuple[int, ...], bits: int, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) without repeats, for the n-grams whose bucket isn't zero in ``table``."""
    found = [np.zeros(0, np.int64)]
    for n in sizes:
        h, at = textvec.char_ngrams(raw, offs, n, bits, lut)
        use = np.flatnonzero(table[h])
        doc = np.searchsorted(offs, at[use], "right") - 1
        found.append((doc << bits) | h[use].astype(np.int64))
    both, count = np.unique(np.concatenate(found), return_counts=True)
    return both >> bits, both & ((1 << bits) - 1), count


def _features(sizes: tuple[int, ...], bits: int, table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = textvec.byte_lut(keep_digits=False)
        for batch in batches:
            for lo, hi, raw, offs in textvec.chunks(batch["text"]):
                doc, bucket, count = _counted(raw, offs, table, sizes, bits, lut)
                cut = np.searchsorted(doc, np.arange(1, hi - lo))
                each = [pa.array([x.tobytes() for x in np.split(v.astype(np.int32), cut)], pa.binary()) for v in (bucket, count)]
                yield pa.RecordBatch.from_arrays([batch["toxic"].slice(lo, hi - lo), *each], ["toxic", "buckets", "counts"])

    return run


def _frequencies(sizes: tuple[int, ...], bits: int):
    """For a mapInArrow: the number of toxic texts and of all texts that have each bucket, of those a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut, every = textvec.byte_lut(keep_digits=False), np.ones(1 << bits, bool)
        count = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False)
            for lo, hi, raw, offs in textvec.chunks(batch["text"]):
                doc, bucket, _ = _counted(raw, offs, every, sizes, bits, lut)
                count[1] += np.bincount(bucket, minlength=1 << bits)
                count[0] += np.bincount(bucket[toxic[lo:hi][doc] == 1], minlength=1 << bits)
        some = np.flatnonzero(count[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[0][some]), pa.array(count[1][some])], ["bucket", "p", "n"])

    return run


def _padded(docs: DataFrame, *others: str) -> DataFrame:
    return docs.select(*others, F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" ")).alias("text"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, sizes: tuple[int, ...] = SIZES, bits: int = BITS, features: int = FEATURES, smooth: float = 1.0, penalty: float = 1e-5) -> Model:
    """Fits the classifier on at most ``per_class`` labelled documents of each class.

    Document frequencies of all n-grams are counted on the executors; the ``features`` buckets whose frequency differs
    most between the classes remain, ties by bucket. With labels of one class only, or none, the model has no weights.
    A document labelled more than once is toxic if any label says so; labels of other values, null ones, and those of
    null or unknown doc_ids are skipped. Repeated rows of a labelled document are read as often as they occur.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    picked = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(sample, "doc_id")
    texts = _padded(texts, F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    texts = Scratch(spark, "toxic").table(texts, "sample").coalesce(8)
    rows = texts.mapInArrow(_frequencies(sizes, bits), "bucket int, p long, n long")
    counts = rows.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p >= 2 or n >= 20")
    size = texts.agg(F.sum("toxic"), F.count("*")).first()
    p, q = (size[0] or 0), size[1] - (size[0] or 0)
    empty = Model(np.zeros(1 << bits, np.float32), 0.0, bits, sizes)
    if not p or not q:
        return empty
    gap = F.abs(F.col("p") / F.lit(float(p)) - (F.col("n") - F.col("p")) / F.lit(float(q)))
    chosen = counts.orderBy(gap.desc(), "bucket").limit(features).toPandas().sort_values("bucket")
    if not len(chosen):
        return empty
    bucket = chosen["bucket"].to_numpy()
    toxic, clean = chosen["p"].to_numpy(float), (chosen["n"] - chosen["p"]).to_numpy(float)
    ratio = np.log((toxic + smooth) / (p + 2 * smooth)) - np.log((clean + smooth) / (q + 2 * smooth))
    table = np.zeros(1 << bits, bool)
    table[bucket] = True
    got = texts.mapInArrow(_features(sizes, bits, table), "toxic int, buckets binary, counts binary").collect()
    y = np.array([r["toxic"] for r in got], float)
    length = np.array([len(r["buckets"]) // 4 for r in got])
    column = np.searchsorted(bucket, np.frombuffer(b"".join(r["buckets"] for r in got), np.int32)).astype(np.int32)
    value = np.log2(1 + np.frombuffer(b"".join(r["counts"] for r in got), np.int32)).astype(np.float32)
    del got
    ends = np.cumsum(length)
    starts, some = ends - length, length > 0

    def times(w: np.ndarray) -> np.ndarray:
        z = np.zeros(len(y))
        if some.any():
            z[some] = np.add.reduceat((w * ratio)[column] * value, starts[some])
        return z

    def back(g: np.ndarray) -> np.ndarray:
        return np.bincount(column, np.repeat(g, length) * value, len(bucket)) * ratio

    weights, intercept = fit_logistic(times, back, len(bucket), y, penalty, 100)
    full = np.zeros(1 << bits, np.float32)
    full[bucket] = weights * ratio
    return Model(full, float(intercept), bits, sizes)


def score_texts(texts: pa.Array, weights: np.ndarray, intercept: float, bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Log-odds of toxicity, by a model's parts, of texts that have a space at either end."""
    lut, out = textvec.byte_lut(keep_digits=False), np.full(len(texts), intercept)
    table = weights != 0
    for lo, hi, raw, offs in textvec.chunks(texts):
        doc, bucket, count = _counted(raw, offs, table, sizes, bits, lut)
        out[lo:hi] += np.bincount(doc, weights[bucket] * np.log2(1 + count), hi - lo)
    return out


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.0) -> DataFrame:
    """docs with toxic_score, log-odds over the whole text, and toxic, whether they exceed the threshold.

    A null or empty text has no n-gram and so the intercept's score; it counts as not toxic, as does a score equal to
    the threshold. Texts are scored whole, however long. Rows are scored one by one, so repeats score alike, and an empty
    table gives an empty one; doc_id isn't looked at. Columns of the same two names are replaced and all others stay.
    """
    sent = spark.sparkContext.broadcast(astuple(model))
    scored = F.arrow_udf(lambda text: pa.array(score_texts(text, *sent.value)), "double")
    text = F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" "))
    found = docs.withColumn("toxic_score", scored(text))
    return found.withColumn("toxic", (F.col("toxic_score") > threshold) & (F.length(F.coalesce("text", F.lit(""))) > 0))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.0, **parameters) -> DataFrame:
    """(doc_id, toxic_score, toxic) for every row of docs, by a model fitted on the labelled ones among them.

    Odd rows as in :func:`score` and :func:`train`; only doc_id and text of docs count, whatever else there is.
    """
    return score(spark, docs.select("doc_id", "text"), train(spark, docs, labels, **parameters), threshold).drop("text")


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.0) -> DataFrame:
    """The rows of docs that aren't toxic, with their own columns, whatever their names; labels come from the labels table.
    Rows with a null or empty text, or a null doc_id, are scored like any other; null and empty texts stay."""
    model = train(spark, docs, read(spark, sf_dir, "labels"))
    own = docs.withColumns({f"__{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    kept = score(spark, own.select(*[f"__{i}" for i in range(len(docs.columns))], F.col("text")), model, threshold).where("not toxic")
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
