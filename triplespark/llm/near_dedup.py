"""MinHash near-duplicate groups: banded candidates, sequential Bayesian pruning, exact verification.

Two documents are near duplicates if the Jaccard index of their sets of word shingles reaches ``threshold``; groups
are the connected components of that relation over the banded candidates. Documents of the same words are one class
from the start: only one of them has bands, so a text copied a million times costs an aggregate, not pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .components import components
from .scratch import Scratch
from .tables import fresh, integer_id, small

#: Jaccard indices of near copies run from about 0.55 up to 1 and few pairs lie below, so the threshold is 0.5.
HASHES, BAND_ROWS, SHINGLE, THRESHOLD, MISS, BATCH = 120, 4, 3, 0.5, 0.01, 24
#: The most documents of a bucket whose pairs are listed; those of a larger one are compared in blocks, all the same.
LISTED, BLOCK = 64, 1024


def shingles(h: np.ndarray, offs: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of w words of each document, with their offsets; a shorter document is one shingle."""
    n = np.diff(offs)
    out_n = np.where(n > 0, np.maximum(n - w + 1, 1), 0)
    out_offs = np.concatenate([[0], np.cumsum(out_n)])
    padded = np.concatenate([h, np.zeros(w - 1, np.uint64)])
    at = np.arange(out_offs[-1]) - np.repeat(out_offs[:-1], out_n) + np.repeat(offs[:-1], out_n)
    left = np.repeat(offs[1:], out_n) - at
    with np.errstate(over="ignore"):
        x = np.zeros(len(at), np.uint64)
        for i in range(w):
            word = padded[at + i]
            if i:
                word = np.where(left > i, word, 0)
            x = (x ^ word) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)
        return textvec.mix(x), out_offs


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = len(rows), rows.shape[1] * rows.itemsize
    offs = (np.arange(n + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(rows))])


def _signer(hashes: int, w: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, lut = np.random.default_rng(seed), textvec.byte_lut()
        mul = rng.integers(0, 1 << 31, hashes, np.uint32) * np.uint32(2) + np.uint32(1)
        add = rng.integers(0, 1 << 32, hashes, np.uint32)
        for batch in batches:
            ids, digests, sigs = [], [], []
            for lo, hi, raw, offs in textvec.chunks(batch["text"]):
                h, wo = textvec.words(raw, offs, lut)
                x, so = shingles(h, wo, w)
                some = np.flatnonzero(np.diff(so))
                if not len(some):
                    continue
                x, starts = (x >> np.uint64(32)).astype(np.uint32), so[some]
                sig = np.empty((hashes, len(some)), np.uint32)
                with np.errstate(over="ignore"):
                    for j in range(hashes):
                        y = x * mul[j]
                        y += add[j]
                        np.minimum.reduceat(y, starts, out=sig[j])
                ids.append(batch["doc_id"].slice(lo, hi - lo).take(pa.array(some)))
                data = memoryview(h).cast("B")
                digests += [hashlib.blake2b(data[8 * wo[i] : 8 * wo[i + 1]], digest_size=16).digest() for i in some.tolist()]
                sigs.append(sig.T)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(digests, pa.binary()), _binary(np.concatenate(sigs))], ["doc_id", "words", "sig"])

    return run


def signatures(docs: DataFrame, hashes: int = HASHES, w: int = SHINGLE, seed: int = 7) -> DataFrame:
    """(doc_id, words, sig) of the documents that have a doc_id and a word: a digest of the sequence of words, and the
    MinHash signature, 4 bytes a hash."""
    return _texts(docs).mapInArrow(_signer(hashes, w, seed), "doc_id long, words binary, sig binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(integer_id(docs).alias("doc_id"), "text")


def _setter(w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lut = textvec.byte_lut()
        for batch in batches:
            for lo, hi, raw, offs in textvec.chunks(batch["text"]):
                x, so = shingles(*textvec.words(raw, offs, lut), w)
                sets = [np.unique(x[so[i] : so[i + 1]]).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return run


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest of n matching hashes at which a Jaccard index of the threshold or more has a posterior probability
    of at least ``miss``, under a uniform prior: P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    p, m = 0.0, 0
    for m in range(n + 1):
        p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if p >= miss:
            return m
    return m


def _pruner(hashes: int, threshold: float, miss: float, step: int):
    cuts = [(n - step, n, least_matches(n, threshold, miss)) for n in range(step, hashes + 1, step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(batch.num_rows, hashes) for c in ("sa", "sb"))
            alive, found = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for lo, hi, least in cuts:
                found[alive] += (x[alive, lo:hi] == y[alive, lo:hi]).sum(1, dtype=np.int32)
                alive = alive[found[alive] >= least]
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch["a"].take(keep), batch["b"].take(keep)], ["a", "b"])

    return run


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (p, q) in enumerate(zip(batch["sa"], batch["sb"], strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (p, q))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(at), batch["b"].take(at)], ["a", "b"])

    return run


def _comparer(hashes: int, threshold: float, miss: float, step: int):
    """For one block of a bucket against one block of the same bucket: the pairs of documents of different components
    that survive pruning, an array of matches a batch of hashes at a time."""
    cuts = [(n - step, n, least_matches(n, threshold, miss)) for n in range(step, hashes + 1, step)]

    def run(rows: pa.Table) -> pa.Table:
        i, j = (rows[c][0].as_py() for c in ("i", "j"))
        own = rows["own"].to_numpy()
        ids, comp = rows["doc_id"].to_numpy(), rows["comp"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint32).reshape(len(ids), hashes)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = []
        for p in range(0, len(left), 64):
            x = left[p : p + 64]
            alive = comp[x][:, None] != comp[right][None, :]
            if i == j:
                alive &= x[:, None] < right[None, :]
            a, b = np.nonzero(alive)
            found = np.zeros(len(a), np.int32)
            for lo, hi, least in cuts:
                found += (sig[x[a], lo:hi] == sig[right[b], lo:hi]).sum(1, dtype=np.int32)
                keep = found >= least
                a, b, found = a[keep], b[keep], found[keep]
            ends = np.stack([ids[x[a]], ids[right[b]]])
            out.append(ends[:, ends[0] != ends[1]])
        ends = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(ends.min(0)), "b": pa.array(ends.max(0))})

    return run


def _with_both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    left = of.select(F.col("doc_id").alias("a"), F.col(value).alias("sa"))
    right = of.select(F.col("doc_id").alias("b"), F.col(value).alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")


def _classes(sig: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures of one document of each sequence of words, (doc_id, rep) of the others, version links (a, b)).

    A document stands for its class if it has the least doc_id. Rows of one doc_id with different words are versions of
    a document, linked to what stands for each.
    """
    multi = scratch.table(sig.groupBy("words").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("words", "rep"), "classes")
    joined = sig.join(small(multi), "words", "left")
    first = joined.where("rep = doc_id").groupBy("words", "doc_id").agg(F.first("sig").alias("sig"))
    reps = scratch.table(joined.where("rep is null").select("words", "doc_id", "sig").unionByName(first).select("doc_id", "sig"), "reps")
    copies = scratch.table(joined.where("rep <> doc_id").select("words", "doc_id", "rep").distinct(), "copies")
    keys = sig.select("doc_id", "words")
    versions = keys.groupBy("doc_id").agg(F.min("words").alias("lo"), F.max("words").alias("hi")).where("lo <> hi").select("doc_id")
    versions = scratch.table(versions, "versions")
    links = copies.join(small(versions), "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    return reps, copies.select("doc_id", "rep").distinct(), links


def groups(
    spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, hashes: int = HASHES, band_rows: int = BAND_ROWS, w: int = SHINGLE, step: int = BATCH,
    listed: int = LISTED, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, keep_id) for each document that isn't the first of its group; keep_id is the group's least doc_id.

    Every pair of documents that shares a band is a candidate. A candidate whose two ends verified edges already
    connect adds nothing to the groups and isn't compared; all others are, so the groups equal the components over
    all candidates. Stars around a bucket's least and around a hashed member come first, which connects a group of n
    near copies with n comparisons rather than n squared. Of buckets whose documents are then still in several
    components, those of up to ``listed`` documents list their pairs; in larger ones blocks of ``block`` documents are
    compared in memory, each with each, and only what survives pruning leaves them. No bucket is a window or one task.
    A pair of Jaccard index J shares a band with probability 1 - (1 - J^4)^30: 0.856 at 0.5, 0.985 at 0.6, 0.9997 at 0.7.

    Rows with a null doc_id, a null text or no word are in no group; an empty table has none. doc_id must be a whole
    number of up to 64 bits. Rows that share a doc_id are versions of one document, which is a near duplicate if any
    version is; repeated rows count once. A text of fewer words than a shingle is one shingle; texts are taken whole,
    however long. An index equal to ``threshold`` counts. Other columns, whatever their names, don't.
    """
    if hashes % band_rows or hashes % step:
        raise ValueError("hashes must be a multiple of band_rows and of step")
    scratch = Scratch(spark, "near")
    sig, copies, links = _classes(scratch.table(signatures(docs, hashes, w), "sig"), scratch)
    scratch.drop("sig")
    width = 4 * band_rows
    bands = [F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(hashes // band_rows)]
    every = sig.select(F.explode(F.array(*bands)).alias("band"), "doc_id")
    shared = every.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("hi")).where("hub <> hi").select("band", "hub")
    shared = scratch.table(shared, "shared-0")
    live = scratch.table(every.join(small(shared), "band").select("band", "doc_id", F.col("doc_id").alias("comp"), "hub", F.col("hub").alias("hub_comp"), F.lit(2).cast("long").alias("n")), "live-0")
    member = scratch.table(live.select("doc_id").distinct(), "members")
    sig = scratch.table(sig.join(small(member), "doc_id", "left_semi"), "member-sig")
    scratch.drop("reps")
    edges, tested = links, None
    for k in range(3):
        blocks = None
        if k < 2:
            pairs = live.where("comp <> hub_comp").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b"))
        else:
            x, y = (live.where(F.col("n") <= listed).select("band", F.col("doc_id").alias(i), F.col("comp").alias(f"c{i}")) for i in "ab")
            pairs = x.join(y, "band").where("ca <> cb and a < b").select("a", "b")
            big = scratch.table(live.where(F.col("n") > listed).select("band", "doc_id", "comp", "n"), "big")
            if not big.isEmpty():
                blocks = big.withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
                met = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j")))
                blocks = blocks.withColumn("at", F.explode(met)).select("band", "doc_id", "comp", "own", "at.i", "at.j").join(sig, "doc_id")
                blocks = blocks.groupBy("band", "i", "j").applyInArrow(_comparer(hashes, threshold, miss, step), "a long, b long").distinct()
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, f"pairs-{k}")
        close = _with_both(pairs, sig, "sig").mapInArrow(_pruner(hashes, threshold, miss, step), "a long, b long")
        close = scratch.table((close if blocks is None else close.unionByName(blocks)).distinct(), f"close-{k}")
        ends = scratch.table(close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"ends-{k}")
        sets = scratch.table(_texts(docs).join(small(ends), "doc_id", "left_semi").mapInArrow(_setter(w), "doc_id long, set binary"), f"sets-{k}")
        true = _with_both(close, sets, "set").mapInArrow(_verifier(threshold), "a long, b long")
        edges = edges.unionByName(scratch.table(true, f"edges-{k}"))
        scratch.drop(f"sets-{k}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        comp = scratch.table(components(edges, scratch, f"stars-{k}"), f"comp-{k}")
        if k == 2:
            break
        known = live.select("band", "doc_id").join(small(comp.withColumnRenamed("node", "doc_id")), "doc_id", "left")
        known = scratch.table(known.withColumn("comp", F.coalesce("comp", "doc_id")), f"known-{k + 1}")
        scratch.drop(f"live-{k}")
        hub = F.min_by(F.struct("doc_id", "comp"), F.xxhash64("doc_id", F.lit(k)))
        shared = known.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), hub.alias("at"), F.count("*").alias("n")).where("lo <> hi")
        shared = scratch.table(shared.select("band", F.col("at.doc_id").alias("hub"), F.col("at.comp").alias("hub_comp"), "n"), f"shared-{k + 1}")
        live = scratch.table(known.join(small(shared), "band"), f"live-{k + 1}")
        scratch.drop(f"known-{k + 1}")
    of_copies = copies.join(small(comp.select(F.col("node").alias("rep"), "comp")), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("keep_id"))
    of_others = comp.select(F.col("node").alias("doc_id"), F.col("comp").alias("keep_id"))
    return of_copies.unionByName(of_others).where("doc_id <> keep_id").distinct()


def near_dedup(spark: SparkSession, docs: DataFrame, **parameters) -> DataFrame:
    """docs without the documents that :func:`groups` lists: one of each group stays, with all its rows and columns,
    whatever their names. Rows that are in no group stay, such as those with a null doc_id or text."""
    (key,) = fresh(docs, "__gone")
    gone = groups(spark, docs, **parameters).select(F.col("doc_id").alias(key))
    gone = small(Scratch(spark, "near").table(gone, "gone"))
    return docs.join(gone, integer_id(docs) == F.col(key), "left_anti")
