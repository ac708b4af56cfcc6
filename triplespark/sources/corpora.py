"""Corpus loaders: files in, DataFrames out."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import decomposition_type, html_text, source_label
from ..schema import CHUNK_INFO, MULTIHOP_ROW, WEB_ROW
from .storage import list_folder


def existing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The paths that exist, in order; others are skipped without a word."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(conf).exists(where):
            out.append(p)
    return out


def lines_with_position(spark: SparkSession, path: str) -> DataFrame:
    """(position, value): lines of a text file, plain or compressed, with their 0-based numbers; the files of a folder in
    order of their names.

    Numbers come from one count a block of a file and an offset; the file is read in parallel, twice, and never gathered.
    Blocks are told apart by file and start, as Spark packs them into partitions by size and not by place.
    """
    block = ["__file", "__start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    sizes = lines.groupBy(*block).agg(F.count("*").alias("n"), F.min("__id").alias("first"))  # a block is read in one go, so its ids follow each other
    before = F.coalesce(F.sum("n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*block, (before - F.col("first")).alias("offset"))
    joined = lines.join(F.broadcast(offsets), block)  # a row for each block
    return joined.select((F.col("offset") + F.col("__id")).alias("position"), "value")


def at_positions(spark: SparkSession, path: str, ids: list[int] | DataFrame, schema: str) -> DataFrame:
    """(query_id, fields of schema) of the lines at these positions, a list or a table (position); other lines are never
    parsed."""
    lines = lines_with_position(spark, path)
    if isinstance(ids, DataFrame):
        kept = lines.join(ids.select(F.col("position").cast("long").alias("position")).distinct(), "position", "left_semi")
    elif ids:
        kept = lines.where(F.col("position").isin(*ids))
    else:
        return spark.createDataFrame([], f"query_id long, {schema}")
    return kept.select(F.col("position").alias("query_id"), F.from_json("value", schema).alias("r")).select("query_id", "r.*")


def query_ids(argument: str, low: int = 0, high: int = 2416) -> list[int]:
    """The numbers of a comma-separated list that lie in the range."""
    return [n for n in (int(x.strip()) for x in argument.split(",")) if low <= n <= high]


def valid_ids(arguments: DataFrame, column: str = "ids", low: int = 0, high: int = 2416) -> DataFrame:
    """arguments with query_id, a row for each number in range of a comma-separated column."""
    each = arguments.withColumn("query_id", F.explode(F.split(column, ",")))
    return each.withColumn("query_id", F.trim("query_id").try_cast("int")).where(F.col("query_id").between(low, high))


def chunk_info(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(file_idx, chunk_idx, source, chunk, entities, triples) of the files that exist, each a JSON list.

    All files are read by one scan, whatever their number; a file's number is its place among those that exist. A path may
    also be a folder of such files, as Spark writes it: they count as one, in order of their names, and each is read by a
    task of its own, where a file that is one JSON list can't be split.

    Numbers within a file come from one count a part and an offset, so no file's rows gather in one task.
    """
    found = existing(spark, paths)
    if not found:
        return spark.createDataFrame([], f"file_idx int, chunk_idx int, {CHUNK_INFO}")
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    index: dict[str, int] = {}
    for i, p in enumerate(found):
        uri = path_of(p).getFileSystem(conf).makeQualified(path_of(p)).toUri().toString()
        index.setdefault(re.sub("^file:/+", "/", uri), i)
    numbers = spark.createDataFrame(list(index.items()), "__file string, file_idx int")
    rows = spark.read.schema(CHUNK_INFO).option("multiLine", True).json(list(dict.fromkeys(found)))
    rows = rows.select("*", plain(F.col("_metadata.file_path")).alias("__file"), F.monotonically_increasing_id().alias("__at"))
    folders = numbers.select(F.col("__file").alias("__folder"), F.col("file_idx").alias("__idx"))
    rows = rows.withColumn("__folder", F.regexp_replace("__file", "/[^/]*$", ""))
    rows = rows.join(F.broadcast(numbers), "__file", "left").join(F.broadcast(folders), "__folder", "left")  # a row for each path
    rows = rows.withColumn("file_idx", F.coalesce("file_idx", "__idx"))
    sizes = rows.groupBy("file_idx", "__file").agg(F.count("*").alias("n"), F.min("__at").alias("first"))  # a part is read in one go
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_idx").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__file", (before - F.col("first")).alias("offset")))  # a row for each part
    return rows.join(offsets, "__file").select("file_idx", (F.col("__at") + F.col("offset")).cast("int").alias("chunk_idx"), "source", "chunk", "entities", "triples")


def _within(value: Column, bits: int, what: str) -> Column:
    fits = (value >= 0) & (value < F.lit(1 << bits))
    return F.when(fits, value.cast("long")).otherwise(F.raise_error(F.lit(f"more than 2^{bits} {what}")).cast("long"))


def triples_of(chunks: DataFrame) -> DataFrame:
    """(ord, subject, label, object, subject_type, object_type): the triples of chunk-info rows in file order.

    ``ord`` holds up to 2^19 files, 2^28 chunks a file and 2^16 triples a chunk; more raise an error.
    """
    t = chunks.select("file_idx", "chunk_idx", "entities", F.posexplode("triples").alias("triple_idx", "t"))
    order = (_within(F.col("file_idx"), 19, "files") * F.lit(1 << 28) + _within(F.col("chunk_idx"), 28, "chunks of a file")) * F.lit(1 << 16) + _within(F.col("triple_idx"), 16, "triples of a chunk")
    kind = lambda c: F.try_element_at("entities", F.col(c))
    return t.select(order.alias("ord"), F.col("t.subject").alias("subject"), F.col("t.relationship").alias("label"), F.col("t.object").alias("object"), kind("t.subject").alias("subject_type"), kind("t.object").alias("object_type"))


class ChunkCache:
    """Chunk-info rows of queries as JSON lines, a folder for each query: what is there is read, what isn't is built once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def present(self) -> set[int]:
        return {int(n.removeprefix("query_id=")) for n in list_folder(self.spark, self.path) if n.startswith("query_id=")}

    def get(self, ids: list[int], build: Callable[[list[int]], DataFrame]) -> DataFrame:
        """(query_id, file_idx, chunk_idx, source, chunk, entities, triples) of these queries; ``build`` makes such rows of
        those without a folder."""
        if missing := sorted(set(ids) - self.present()):
            build(missing).write.partitionBy("query_id").mode("append").json(self.path)
        if not self.present():
            return self.spark.createDataFrame([], f"query_id int, file_idx int, chunk_idx int, {CHUNK_INFO}")
        rows = self.spark.read.schema(f"file_idx int, chunk_idx int, {CHUNK_INFO}, query_id int").json(self.path)
        return rows.where(F.col("query_id").isin(*ids)).select("query_id", "file_idx", "chunk_idx", "source", "chunk", "entities", "triples")


def write_chunk_info(chunks: DataFrame, path: str) -> None:
    """Writes chunk-info rows as JSON lines; ``mode('ignore')`` semantics make it a cache."""
    chunks.write.mode("ignore").json(path)


def distinct_pages(results: DataFrame) -> DataFrame:
    """(query_id, page_idx, page_name, page_result) of search results (query_id, pos, page_name, page_result).

    Empty pages go; of identical pages the first position and the last name stay; positions are then renumbered.
    """
    some = results.where("page_result is not null and page_result <> ''")
    one = some.groupBy("query_id", "page_result").agg(F.min("pos").alias("pos"), F.max_by("page_name", "pos").alias("page_name"))
    order = Window.partitionBy("query_id").orderBy("pos")
    return one.select("query_id", (F.row_number().over(order) - 1).alias("page_idx"), "page_name", "page_result")


class Corpus(ABC):
    """Something that yields (query_id, source_label, content)."""

    @abstractmethod
    def contents(self, spark: SparkSession, **which) -> DataFrame: ...


def paragraphs_of(rows: DataFrame) -> DataFrame:
    """(query_id, source_label, content) of the paragraphs of rows; of equal labels of a query the last counts."""
    each = rows.select("query_id", F.posexplode("paragraphs").alias("pos", "p"))
    labelled = each.select("query_id", "pos", source_label(F.col("p.idx"), F.col("p.title")).alias("source_label"), F.col("p.paragraph_text").alias("content"))
    return labelled.groupBy("query_id", "source_label").agg(F.max_by("content", "pos").alias("content"))


class MultihopCorpus(Corpus):
    """JSON lines whose rows carry a question, its decomposition and its paragraphs."""

    def __init__(self, path: str):
        self.path = path

    def queries(self, spark: SparkSession, ids: list[int] | DataFrame) -> DataFrame:
        rows = at_positions(spark, self.path, ids, MULTIHOP_ROW)
        return rows.withColumn("decomposition_type", decomposition_type(F.transform("question_decomposition", lambda q: q["question"])))

    def contents(self, spark: SparkSession, **which) -> DataFrame:
        if not which.get("query_ids"):
            raise ValueError("query_ids are needed")
        rows = self.queries(spark, which["query_ids"])
        if missing := set(which["query_ids"]) - {r[0] for r in rows.select("query_id").collect()}:
            raise KeyError(f"no such query: {sorted(missing)}")
        return paragraphs_of(rows)


class WebCorpus(Corpus):
    """JSON lines, plain or bzip2, whose rows carry a question and the pages found for it."""

    def __init__(self, path: str):
        self.path = path

    def queries(self, spark: SparkSession, ids: list[int]) -> DataFrame:
        return at_positions(spark, self.path, ids, WEB_ROW)

    def contents(self, spark: SparkSession, **which) -> DataFrame:
        if not which.get("query_ids"):
            raise ValueError("query_ids are needed")
        each = self.queries(spark, which["query_ids"]).select("query_id", F.posexplode("search_results").alias("pos", "r"))
        pages = distinct_pages(each.select("query_id", "pos", "r.page_name", "r.page_result"))
        return pages.select("query_id", source_label(F.col("page_idx"), F.col("page_name")).alias("source_label"), html_text(F.col("page_result")).alias("content"))


class TitledCorpus(Corpus):
    """Articles by title out of a table (title, text): the offline stand-in for an encyclopedia's service."""

    def __init__(self, articles: DataFrame):
        self.articles = articles

    def contents(self, spark: SparkSession, **which) -> DataFrame:
        if not which.get("titles"):
            raise ValueError("titles are needed")
        wanted = self.articles.where(F.col("title").isin(*which["titles"]))
        return wanted.select(F.lit(0).alias("query_id"), F.col("title").alias("source_label"), F.col("text").alias("content"))
