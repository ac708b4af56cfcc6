"""Exact duplicates against immutable snapshots screened by static binary-fuse filters.

Documents arrive in batches. Each batch becomes an immutable snapshot in shared storage once it's in: its exact buckets
and one 3-wise binary-fuse filter (Graf and Lemire, 2022) for each shard of its digests. A digest of a later batch that
passes no stored filter is certainly new; one that passes joins the exact buckets. Copies within a batch are grouped
apart from that. Whatever shares a digest is at last compared byte for byte.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .scratch import Scratch, list_folder
from .tables import integer_id, small, without

BATCHES, SHARD_KEYS = 4, 1 << 17


def _places(keys: np.ndarray, seed: int, segment: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The three places of each key, and its fingerprint."""
    with np.errstate(over="ignore"):
        h = textvec.mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, span, table) of a binary-fuse filter over distinct 64-bit keys; 9 bits a key or so."""
    n = len(keys)
    segment = 1 << min(18, max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + segment
    count = max(1, -(-size // segment) - 2)
    span, length = count * segment, (count + 2) * segment
    for seed in range(1, 100):
        places, prints = _places(keys, seed, segment, span)
        degree = np.bincount(places.ravel(), minlength=length)
        holder = np.zeros(length, np.int64)
        for row in places:
            np.bitwise_xor.at(holder, row, np.arange(n))
        layers, left = [], n
        front = np.flatnonzero(degree == 1)
        while len(front):
            peeled, where = np.unique(holder[front], return_index=True)
            layers.append((peeled, front[where]))
            left -= len(peeled)
            touched = places[:, peeled].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(holder, touched, np.tile(peeled, 3))
            touched = np.unique(touched)
            front = touched[degree[touched] == 1]
        if left:
            continue
        table = np.zeros(length, np.uint8)
        for peeled, at in reversed(layers):
            p = places[:, peeled]
            table[at] = prints[peeled] ^ table[p[0]] ^ table[p[1]] ^ table[p[2]]
        return seed, segment, span, table
    raise RuntimeError("no seed gave a filter; are the keys distinct?")


def may_contain(keys: np.ndarray, seed: int, segment: int, span: int, table: np.ndarray) -> np.ndarray:
    """True for each key of the filter, and for one in 256 of the others."""
    places, prints = _places(keys, seed, segment, span)
    return (table[places[0]] ^ table[places[1]] ^ table[places[2]]) == prints


_FILTER = "shard int, shards int, seed int, segment int, span long, filter binary"


def _builder(shards: int):
    def run(rows: pa.Table) -> pa.Table:
        seed, segment, span, table = build_filter(np.unique(rows["key"].to_numpy().view(np.uint64)))
        values = [rows["shard"][0].as_py(), shards, seed, segment, span, table.tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[f.split(" ")[0] for f in _FILTER.split(", ")])

    return run


def _screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    keys = incoming["key"].to_numpy().view(np.uint64)
    hit = np.zeros(len(keys), bool)
    for f in filters.to_pylist():
        rest = np.flatnonzero(~hit)
        hit[rest] = may_contain(keys[rest], f["seed"], f["segment"], f["span"], np.frombuffer(f["filter"], np.uint8))
    return incoming.filter(pa.array(hit)).select(["digest"])


class Snapshots:
    """The snapshots in a folder of shared storage. Each is a folder of its own, written once and never changed:
    ``buckets`` (doc_id, digest, th) and ``filters``, a row a shard. A snapshot counts once its filters are committed,
    so one that a lost driver left unfinished doesn't.

    The number of shards is set by the first snapshot, from its size and ``shard_keys``, and kept: a later, larger one
    has larger filters of the same 9 bits a digest.
    """

    def __init__(self, spark: SparkSession, path: str, shard_keys: int = SHARD_KEYS):
        self.spark, self.path, self.shard_keys = spark, path, shard_keys

    def names(self) -> list[str]:
        return [n for n in list_folder(self.spark, self.path) if "_SUCCESS" in list_folder(self.spark, f"{self.path}/{n}/filters")]

    def _read(self, table: str, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{n}/{table}" for n in names])

    def shards(self, names: list[str]) -> int | None:
        """The number of shards; None before the first snapshot that holds anything."""
        row = self._read("filters", names).select("shards").first() if names else None
        return row[0] if row else None

    def _keyed(self, digests: DataFrame, shards: int) -> DataFrame:
        key = F.xxhash64("digest")
        return digests.select("digest").distinct().select("digest", key.alias("key"), F.pmod(key, F.lit(shards)).cast("int").alias("shard"))

    def known(self, incoming: DataFrame, scratch: Scratch) -> DataFrame:
        """The distinct digests of ``incoming`` that some snapshot holds. Filters screen them, shard by shard; only what
        passes meets the buckets, which are shuffled only if that is more than can be broadcast."""
        names = self.names()
        if not (shards := self.shards(names)):
            return incoming.select("digest").limit(0)
        filters, keyed = self._read("filters", names), self._keyed(incoming, shards)
        hits = keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screen, "digest binary")
        hits = small(scratch.table(hits, f"hits-{uuid.uuid4().hex}"))
        return self._read("buckets", names).select("digest").join(hits, "digest", "left_semi").distinct()

    def add(self, batch: DataFrame) -> str:
        """Makes a snapshot of a batch of (doc_id, digest, th)."""
        names, name = self.names(), f"snapshot-{uuid.uuid4().hex}"
        buckets = f"{self.path}/{name}/buckets"
        batch.select("doc_id", "digest", "th").write.option("compression", "zstd").parquet(buckets)
        kept = self.spark.read.schema("doc_id long, digest binary, th long").parquet(buckets)
        shards = self.shards(names) or max(1, -(-kept.count() // self.shard_keys))
        filters = self._keyed(kept, shards).groupBy("shard").applyInArrow(_builder(shards), _FILTER)
        filters.write.parquet(f"{self.path}/{name}/filters")
        return name


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, th): the SHA-256 and the xxhash64 of each text; rows with a null doc_id or text are left out."""
    known = docs.where("doc_id is not null and text is not null")
    return known.select(integer_id(docs).alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("th"))


def shared_digests(batch: DataFrame, store: Snapshots, scratch: Scratch) -> DataFrame:
    """The digests of a batch (doc_id, digest, th) that the store holds or that occur more than once in the batch."""
    within = batch.groupBy("digest").count().where("count > 1").select("digest")
    return store.known(batch, scratch).unionByName(within).distinct()


def verified(texts: DataFrame, keys: DataFrame, shared: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, th, digest, keep_id, rows) for the rows whose text occurs more than once: keep_id is the least doc_id
    that has it, rows how often this one does.

    The texts of shared digests are grouped by all their bytes; each is shuffled once at most, equal ones of a task
    together. If that leaves one text a digest, as it does unless SHA-256 collides, the digests stand for the texts and
    the rest needs no text; the texts of a digest that has several are classes of their own.
    """
    hashes = scratch.table(keys.join(small(shared), "digest", "left_semi").select("th").distinct(), "hashes")
    known = texts.where("doc_id is not null and text is not null").select(integer_id(texts).alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    suspects = known.join(small(hashes), "th", "left_semi").withColumn("digest", F.unhex(F.sha2("text", 256)))
    distinct = suspects.groupBy("digest", "text").agg(F.count("*").alias("copies"))
    sizes = scratch.table(distinct.groupBy("digest").agg(F.count("*").alias("texts"), F.sum("copies").alias("copies")), "sizes")
    sure = scratch.table(sizes.where("texts = 1 and copies > 1").select("digest"), "sure")
    members = keys.join(small(sure), "digest", "left_semi").groupBy("digest", "doc_id", "th").agg(F.count("*").alias("rows"))
    members = scratch.table(members, "members")
    keep = scratch.table(members.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), "keep")
    flagged = members.join(small(keep), "digest").select("doc_id", "th", "digest", "keep_id", "rows")
    collided = sizes.where("texts > 1").select("digest")
    if not collided.isEmpty():
        apart = suspects.join(collided, "digest", "left_semi")
        first = apart.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
        apart = apart.groupBy("digest", "text", "doc_id", "th").agg(F.count("*").alias("rows")).join(first, ["digest", "text"])
        flagged = flagged.unionByName(apart.select(*flagged.columns))
    return scratch.table(flagged, "flagged")


def _flagged(spark: SparkSession, docs: DataFrame, batches: int, shard_keys: int) -> DataFrame:
    scratch = Scratch(spark, "exact")
    store = Snapshots(spark, f"{scratch.path}/snapshots", shard_keys)
    cuts = docs.agg(F.percentile_approx(integer_id(docs), [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    batch = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts or []), F.lit(0))
    keys = scratch.table(keys_of(docs).withColumn("batch", batch), "keys")
    shared = None
    for k in range(batches):
        mine = keys.where(F.col("batch") == k)
        found = scratch.table(shared_digests(mine, store, scratch), f"shared-{k}")
        shared = found if shared is None else shared.unionByName(found)
        if k + 1 < batches:
            store.add(mine)
    return verified(docs, keys, scratch.table(shared.distinct(), "shared"), scratch)


def arrivals(spark: SparkSession, store: Snapshots, incoming: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id) for each document of a batch whose bytes an earlier or another one of the batch has; the batch
    is then added to the store.

    keep_id is the least doc_id of the earlier documents that have the text, or else of the batch's own. ``history``
    are the documents of the store's snapshots, of which only texts of matching digests are compared. Odd rows as in
    :func:`duplicates`.
    """
    scratch = Scratch(spark, "exact")
    mine = scratch.table(keys_of(incoming), "keys")
    shared = scratch.table(shared_digests(mine, store, scratch), "shared")
    names = store.names()
    if names and history is None:
        raise ValueError("the documents of the store's snapshots are needed to compare bytes")
    keys, texts, old = mine, incoming.select("doc_id", "text"), None
    if names:
        old = store._read("buckets", names).join(small(shared), "digest", "left_semi")
        keys, texts = mine.unionByName(old), texts.unionByName(history.select("doc_id", "text"))
    flagged = verified(texts, keys, shared, scratch)
    out = flagged.select("doc_id", "th", "keep_id")
    if old is not None:
        first = old.join(flagged.select("doc_id", "th", F.col("keep_id").alias("class")), ["doc_id", "th"]).groupBy("th", "class").agg(F.min("doc_id").alias("before"))
        first = scratch.table(first, "first")
        out = flagged.withColumnRenamed("keep_id", "class").join(small(first), ["th", "class"], "left").select("doc_id", "th", F.coalesce("before", "class").alias("keep_id"))
    out = out.join(mine.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi").where("doc_id <> keep_id")
    out = scratch.table(out.select("doc_id", "keep_id").distinct(), "out")
    store.add(mine)
    return out


def duplicates(spark: SparkSession, docs: DataFrame, batches: int = BATCHES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, keep_id) for each document whose bytes an earlier document has; keep_id is the least such doc_id.

    Batches are quantiles of doc_id, the order of arrival, wherever the ids lie; doc_id must be a whole number of up to
    64 bits. The empty text is a text like any other, and long ones are taken whole. Rows with a null doc_id or a null
    text are never duplicates; rows that repeat a doc_id with the same text aren't listed, as their doc_id is kept; an
    empty table has none. Other columns, whatever their names, don't count. Only digests and filters are shuffled, and
    the texts of rows whose digest occurs twice.
    """
    return _flagged(spark, docs, batches, shard_keys).where("doc_id <> keep_id").select("doc_id", "keep_id").distinct()


def exact_dedup(spark: SparkSession, docs: DataFrame, batches: int = BATCHES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs with one row for each distinct text, that of the least doc_id, with all its columns, whatever their names.
    Rows with a null doc_id or text all stay; of equal rows of one doc_id one stays."""
    flagged, scratch = _flagged(spark, docs, batches, shard_keys), Scratch(spark, "exact")
    drop = scratch.table(flagged.where("doc_id <> keep_id").select("doc_id", "th").distinct(), "drop")
    again = scratch.table(flagged.where("doc_id = keep_id and rows > 1").select("doc_id", "th").distinct(), "again")
    return without(docs, drop, again)
