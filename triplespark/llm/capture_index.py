"""A two-level index of web captures.

Captures are sorted by reversed-host URL key into shards, each a file of compressed blocks in shared storage. Beside it
lies its sparse directory: the first and last key of each block, and where in the file it is. A lookup finds its shards
by binary search over the shards' bounds, its blocks by binary search over the shard's directory, and then reads those
ranges of bytes alone.
"""

from __future__ import annotations

import bisect
import io
import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, qualified
from .tables import integer_id

BLOCK_ROWS, SHARD_ROWS, MOST_SHARDS = 1000, 200_000, 10_000


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, the port unless it's the scheme's own, a bracket, then path and
    sorted query in lower case. User, fragment, a leading www and a closing slash are dropped. Null without a host."""
    low = F.lower(F.trim(url))
    host = F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), r"^www[0-9]*\.", "")
    port = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?[^/:?#]*:([0-9]+)", 1)
    path = F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(low, r"^[^?#]*\?([^#]*)", 1)
    shown = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    asked = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), shown, F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path), asked))


#: Where a capture's record lies, kept in the index if the table has all three columns.
LOCATION = {"warc_file": "string", "warc_offset": "long", "warc_length": "long"}
_ENTRY = "key string, page_id long, " + ", ".join(f"{n} {t}" for n, t in LOCATION.items())
_SHARD = "shard int, file string, blocks int, rows long, lo string, hi string"


@dataclass
class Index:
    """``shards`` has (shard, file, blocks, rows, lo, hi), a row for each file in ``folder``; the directory of a file is
    the file of that name and ``.dir``. ``reads`` and ``bytes_read`` count what lookups have read of the blocks."""

    folder: str
    shards: list[tuple[int, str, int, int, str, str]]
    reads: Accumulator
    bytes_read: Accumulator


def _packed(table: pa.Table | pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write(table)
    return out.getvalue()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _writer(folder: str, block_rows: int):
    """Writes a task's sorted captures to a file of its own. The name is new at each attempt, and only attempts that
    succeed are listed, so one that is lost or runs twice leaves a file that nothing reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name, at, rows, entries, held = f"shard-{uuid.uuid4().hex}", 0, 0, [], None
        out = None
        for batch in itertools.chain(_tables(batches), [None]):
            held = batch if held is None else held if batch is None else pa.concat_tables([held, batch])
            while held is not None and held.num_rows and (held.num_rows >= block_rows or batch is None):
                block, held = held.slice(0, block_rows).combine_chunks(), held.slice(block_rows)
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}")
                data = _packed(block)
                out.write(data)
                entries.append((block["key"][0].as_py(), block["key"][-1].as_py(), at, len(data)))
                at, rows = at + len(data), rows + block.num_rows
        if out is not None:
            out.close()
            kinds = [("first", pa.string()), ("last", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
            with system.open_output_stream(f"{root}/{name}.dir") as d:
                d.write(_packed(pa.table({n: pa.array([e[i] for e in entries], t) for i, (n, t) in enumerate(kinds)})))
            values = [TaskContext.get().partitionId(), name, len(entries), rows, entries[0][0], entries[-1][1]]
            types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split(" ")[0] for c in _SHARD.split(", ")])

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for batch in batches:
        yield pa.Table.from_batches([batch])


def captures_in(pages: DataFrame) -> DataFrame:
    """(key, page_id, location columns) of all pages; the key is null without a host."""
    named = set(LOCATION) <= set(pages.columns)
    place = [(F.col(n) if named else F.lit(None)).cast(t).alias(n) for n, t in LOCATION.items()]
    return pages.select(url_key(F.col("url")).alias("key"), integer_id(pages, "page_id").alias("page_id"), *place)


def build(spark: SparkSession, captures: DataFrame, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS) -> Index:
    """The index of the captures (see :func:`captures_in`; a written table) that have a key.

    The number of shards follows the number of captures, up to a bound that keeps the shards' bounds small; a key with
    more captures than a shard holds goes on in the next, as rows are spread by key and page_id. Nothing is dropped.
    """
    some = captures.where("key is not null")
    shards = min(MOST_SHARDS, max(1, -(-some.count() // shard_rows)))
    spread = some.repartitionByRange(shards, "key", "page_id", F.xxhash64("page_id")).sortWithinPartitions("key", "page_id")
    scratch = Scratch(spark, "captures")
    folder = qualified(spark, f"{scratch.path}/blocks")
    made = scratch.table(spread.mapInArrow(_writer(folder, block_rows), _SHARD), "shards").orderBy("lo", "hi", "shard").collect()
    return Index(folder, [tuple(r) for r in made], spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))


def _route(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = sent.value
        lows, highs = [s[4].encode() for s in shards], [s[5].encode() for s in shards]
        for batch in batches:
            keys, at = [], []
            for key in batch["key"].to_pylist():
                k = key.encode()
                for i in range(bisect.bisect_left(highs, k), bisect.bisect_right(lows, k)):
                    keys.append(key)
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at, pa.int32())], ["key", "at"])

    return run


def _reader(sent, folder: str, reads: Accumulator, bytes_read: Accumulator):
    """For asked keys sorted by shard and key: opens each shard once, finds each key's blocks in its directory by binary
    search, and reads every block that some key needs once, when the keys have passed it. Held are a directory, and the
    keys of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        shards, last, blocks = sent.value, None, None
        firsts: list[bytes] = []
        lasts: list[bytes] = []
        wanted: dict[int, list[str]] = {}  # by block, in order, as keys are sorted

        def passed(before: int) -> Iterator[pa.RecordBatch]:
            for i in [i for i in wanted if i < before]:
                size = directory["length"][i].as_py()
                block = _unpacked(blocks.read_at(size, directory["offset"][i].as_py()))
                reads.add(1)
                bytes_read.add(size)
                yield from block.filter(pc.is_in(block["key"], pa.array(wanted.pop(i), pa.string()))).to_batches()

        for batch in itertools.chain(batches, [None]):
            rows = zip(batch["at"].to_pylist(), batch["key"].to_pylist(), strict=True) if batch is not None else [(None, None)]
            for at, key in rows:
                if at != last:
                    if last is not None:
                        yield from passed(len(firsts))
                        blocks.close()
                    if at is not None:
                        name = shards[at][1]
                        with system.open_input_stream(f"{root}/{name}.dir") as d:
                            directory = _unpacked(d.read())
                        firsts, lasts = ([k.encode() for k in directory[c].to_pylist()] for c in ("first", "last"))
                        blocks = system.open_input_file(f"{root}/{name}")
                    last = at
                if key is not None:
                    k = key.encode()
                    lo = bisect.bisect_left(lasts, k)
                    yield from passed(lo)
                    for i in range(lo, bisect.bisect_right(firsts, k)):
                        wanted.setdefault(i, []).append(key)

    return run


def lookup(spark: SparkSession, index: Index, keys: DataFrame) -> DataFrame:
    """(key, page_id, warc_file, warc_offset, warc_length) of every capture of the distinct non-null values of ``key``;
    keys without captures give no row. A shard's keys are looked up by one task, which holds no more than one block and the
    keys asked of it."""
    sent = spark.sparkContext.broadcast(index.shards)
    asked = keys.select("key").where("key is not null").distinct().mapInArrow(_route(sent), "key string, at int")
    sorted_ = asked.repartition("at").sortWithinPartitions("at", "key")
    return sorted_.mapInArrow(_reader(sent, index.folder, index.reads, index.bytes_read), _ENTRY)


def captures_of_pages(spark: SparkSession, pages: DataFrame, **parameters) -> DataFrame:
    """(page_id, url_key, captures, first_page_id): each page's URL looked up in the index of all pages.

    A page whose URL is null, empty or has no host isn't indexed: its key is null and it has 0 captures. URLs are taken
    whole, however long, with whatever characters. Repeated rows are captures of their own and each is looked up; a
    null page_id counts as a capture but is never the first. page_id must be a whole number of up to 64 bits. An empty
    table gives an empty result; other columns don't count, but for those of :data:`LOCATION`. The counts are joined
    back by key, by a shuffle that is split where a key is hot.
    """
    captures = Scratch(spark, "captures").table(captures_in(pages), "captures")
    index = build(spark, captures, **parameters)
    found = lookup(spark, index, captures.select("key")).groupBy("key").agg(F.count("*").alias("captures"), F.min("page_id").alias("first_page_id"))
    asked = captures.select("page_id", F.col("key").alias("url_key"))
    joined = asked.join(found, F.col("url_key") == F.col("key"), "left")
    return joined.select("page_id", "url_key", F.coalesce("captures", F.lit(0)).cast("long").alias("captures"), "first_page_id")
