"""Language identification by error-correcting output codes.

Each language has a codeword; one binary n-gram classifier predicts each bit. A text gets the language whose codeword
is nearest by loss-weighted decoding (Escalera et al., 2010): the logistic loss of each bit counts in proportion to how
often that bit's classifier is right on that language. A text whose two nearest codewords lie close is ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .linear import fit_logistic
from .scratch import Scratch

#: Documents of each language, and of all together, that the fit reads at most, the lowest by a hash of doc_id. With
#: more than 26 values of ``lang`` each has an equal share of the second.
TRAIN_PER_LANGUAGE, TRAIN_ROWS = 300, 8000
SIZES, BITS, GAP = (1, 2, 3), 12, 0.25


def codewords(classes: int, seed: int = 3) -> np.ndarray:
    """A row of +1 and -1 for each class: all distinct splits for up to 6 classes, else the best of random codes."""
    if classes <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=classes) if s[:1] == (1,) and -1 in s]
        return np.array(splits, np.int8).reshape(-1, classes).T if splits else np.ones((classes, 0), np.int8)
    rng, width, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes))), None, -1
    for _ in range(max(2, min(200, 8_000_000 // classes**2))):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, width))
        if (np.abs(code.sum(0, dtype=np.int64)) == classes).any():
            continue
        alike = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(alike, -width)
        near = int((width - alike.max()) / 2)  # the least number of bits in which two codewords differ
        if near > apart:
            best, apart = code, near
    return best


def features(raw: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...], bits: int, lut: np.ndarray) -> np.ndarray:
    """Square roots of the relative frequencies of hashed n-grams, a row for each document; zeros without n-grams."""
    n, wide = len(offs) - 1, 1 << bits
    counts = np.zeros(n * wide, np.int64)
    for size in sizes:
        if size == 1:
            b = lut[raw]
            at = np.flatnonzero(b != 32)
            h = b[at].astype(np.int64)
        else:
            h, at = textvec.char_ngrams(raw, offs, size, bits, lut)
        doc = np.searchsorted(offs, at, "right") - 1
        counts += np.bincount((doc << bits) | h.astype(np.int64), minlength=n * wide)
    counts = counts.reshape(n, wide)
    return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True))).astype(np.float32)


def distances(margins: np.ndarray, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss-weighted distance of each row of bit margins from each codeword; without codewords a row of none."""
    if not len(code):
        return np.zeros((len(margins), 0))
    return np.stack([(weights[r] * np.logaddexp(0, -code[r] * margins)).sum(1) for r in range(len(code))], 1)


def _rows_per_chunk(bits: int) -> int:
    return max(1, (1 << 21) >> bits)


def _blocks(texts: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks that also hold few enough documents for a matrix of their counts."""
    most = _rows_per_chunk(bits)
    for lo, hi, raw, offs in textvec.chunks(texts):
        for at in range(lo, hi, most):
            to = min(hi, at + most)
            o = offs[at - lo : to - lo + 1]
            yield at, to, raw[o[0] : o[-1]], o - o[0]


def _padded(text: str = "text"):
    return F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))


def _extractor(sizes: tuple[int, ...], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = textvec.byte_lut(keep_digits=False)
        for batch in batches:
            for lo, hi, raw, offs in _blocks(batch["text"], bits):
                x = features(raw, offs, sizes, bits, lut)
                yield pa.RecordBatch.from_arrays([batch["lang"].slice(lo, hi - lo), batch["at"].slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "at", "x"])

    return run


def train(spark: SparkSession, docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, sizes: tuple[int, ...] = SIZES, bits: int = BITS, rows: int = TRAIN_ROWS) -> tuple:
    """(languages, codewords, bit weights of each language, classifier weights, intercepts) fitted on labelled rows.

    A language is a non-null value of ``lang``; its lowest rows by a hash of doc_id are the bounded sample: at most
    ``per_language``, and with many values of lang at most an equal share of ``rows``, so what reaches the driver stays
    under rows * 2^bits * 4 bytes, 131 MB. More values than rows are an error: such a column names no languages.
    The weight of a bit for a language is how often its classifier is right on that language's rows of the other half of
    the sample, by the same hash, when fitted on one half; the classifiers kept are fitted on both.
    """
    values = docs.where("lang is not null").agg(F.count_distinct("lang")).first()[0]
    if values > rows:
        raise ValueError(f"{values} values of lang, more than the {rows} rows of the sample")
    per_language = max(1, min(per_language, rows // max(1, values)))
    at = F.xxhash64("doc_id", F.lit(23))
    order = Window.partitionBy("lang").orderBy(at, "doc_id")
    named = docs.where("lang is not null and doc_id is not null and length(text) > 0").select("doc_id", "lang")
    picked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("doc_id", "lang").distinct()
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])
    sample = Scratch(spark, "langid").table(sample.select("lang", at.alias("at"), _padded().alias("text")), "sample")
    got = sample.mapInArrow(_extractor(sizes, bits), "lang string, at long, x binary").toPandas()
    got = got.sort_values(["lang", "at", "x"], ignore_index=True)  # the same at every run, however files are listed
    languages = sorted(got["lang"].unique().tolist())
    y = np.searchsorted(languages, got["lang"].to_numpy(str)) if languages else np.zeros(0, int)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), 1 << bits)
    code = codewords(len(languages)) if languages else np.ones((0, 0), np.int8)
    half = np.zeros(len(got), bool)
    for r in range(len(languages)):
        half[np.flatnonzero(y == r)[::2]] = True
    w, b = _fitted(x, y, code, np.ones(len(got), bool), bits)
    rates = np.ones((len(languages), code.shape[1]))
    if code.shape[1]:
        right = np.ones((len(got), code.shape[1]))
        for fit, held in ((half, ~half), (~half, half)):
            if len(set(y[fit])) == len(languages):  # else a language has one row, which says nothing of its bits
                u, c = _fitted(x, y, code, fit, bits)
                right[held] = (x[held] @ u + c > 0) == (code[y[held]] > 0)
        rates = np.stack([right[y == r].mean(0) for r in range(len(languages))])
    return languages, code, rates / np.maximum(1e-9, rates.sum(1, keepdims=True)), w, b


def _fitted(x: np.ndarray, y: np.ndarray, code: np.ndarray, use: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of the classifiers of all bits, fitted on these rows."""
    m, t = x[use], code[y[use]] > 0
    fits = [fit_logistic(lambda v: m @ v.astype(np.float32), lambda g: g.astype(np.float32) @ m, 1 << bits, t[:, s].astype(float), 1e-5, 60) for s in range(code.shape[1])]
    w = np.stack([f[0] for f in fits], 1).astype(np.float32) if fits else np.zeros((1 << bits, 0), np.float32)
    return w, np.array([f[1] for f in fits], np.float32)


def classify_texts(texts: pa.Array, languages: list[str], code: np.ndarray, weights: np.ndarray, w: np.ndarray, b: np.ndarray, sizes: tuple[int, ...], bits: int, gap: float) -> pa.StructArray:
    """(predicted, distance, gap, ambiguous) of texts that have a space at either end."""
    lut, n = textvec.byte_lut(keep_digits=False), len(texts)
    first, near, apart, some = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for lo, hi, raw, offs in _blocks(texts, bits):
        x = features(raw, offs, sizes, bits, lut)
        d = distances((x @ w + b).astype(float), code, weights)
        some[lo:hi] = x.any(1)
        if d.shape[1]:
            order = np.sort(d, 1)
            first[lo:hi], near[lo:hi] = d.argmin(1), order[:, 0]
            apart[lo:hi] = order[:, 1] - order[:, 0] if d.shape[1] > 1 else np.inf
    some &= bool(languages)
    names = pa.array(np.array(languages or [""], object)[first], pa.string(), mask=~some)
    return pa.StructArray.from_arrays([names, pa.array(near, mask=~some), pa.array(apart, mask=~some), pa.array(~some | (apart < gap))], ["predicted", "distance", "gap", "ambiguous"])


def language_id(spark: SparkSession, docs: DataFrame, gap: float = GAP, sizes: tuple[int, ...] = SIZES, bits: int = BITS, **parameters) -> DataFrame:
    """(doc_id, predicted, distance, gap, ambiguous) for every row of docs, over whole texts.

    A null or empty text, or one without a letter, has a null language and is ambiguous, as is every row when docs
    name no language. With one language all texts get it. Repeated rows are classified alike; other columns don't
    count, whatever their names; doc_id may be of any type, and a null one is kept as it is (but isn't fitted on). Of
    equal distances the language first by name is nearest, and the row is ambiguous. ``gap`` is the least difference of
    distances at which the nearest codeword is sure. An empty table gives an empty result.
    """
    model = train(spark, docs, sizes=sizes, bits=bits, **parameters)
    sent = spark.sparkContext.broadcast((*model, sizes, bits, gap))
    found = F.arrow_udf(lambda text: classify_texts(text, *sent.value), "predicted string, distance double, gap double, ambiguous boolean")
    return docs.select("doc_id", found(_padded()).alias("__f")).select("doc_id", "__f.*")
