"""From a corpus of questions to judged answers: load, extract, cache, build the graph, answer, judge, log.

    python -m triplespark.plans.run CORPUS --query-ids 0,3 --method triples --output FOLDER --models MODULE:FUNCTION

The function gives the models: (language model, entity model, embedder).
"""

from __future__ import annotations

import argparse
import importlib
import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..models import Embedder, EntityModel, LanguageModel
from ..operators.construction import build_graph, extract
from ..sources.corpora import ChunkCache, MultihopCorpus, query_ids
from ..sources.storage import release
from .community_search import CommunitySearch
from .qa import NaiveRetrieval, PlainModel, judge
from .triple_search import TripleSearch

METHODS = ("plain", "retrieval", "triples", "communities")
RESULT = "query_id int, method string, query string, prediction string, correct boolean, duration double, record string, error string"


def log_of(query_id: int, method: str, folder: str) -> logging.Logger:
    """A log of its own for a query and a method: a file in the folder, written anew."""
    log = logging.getLogger(f"triplespark.run.{folder}.{query_id}.{method}")
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    handler = logging.FileHandler(Path(folder) / f"query_{query_id}_{method}.log", mode="w", encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    log.propagate = False
    return log


@dataclass
class Run:
    """Answers queries of a corpus by one method. ``output`` is a folder of the driver's: logs, pages and results; the
    cache of chunk-info rows lies in ``cache``, by default a folder of it, or anywhere that executors reach."""

    spark: SparkSession
    corpus: MultihopCorpus
    model: LanguageModel
    entities: EntityModel
    embedder: Embedder
    output: str
    cache: str | None = None
    judged_by: Callable[[DataFrame, LanguageModel], DataFrame] = judge
    settings: dict = field(default_factory=dict)

    def extracted(self, ids: list[int]) -> DataFrame:
        """Chunk-info rows of these queries with their query_id: one paragraph is one chunk, in order of its label."""
        pages = self.corpus.contents(self.spark, query_ids=ids)
        order = Window.partitionBy("query_id").orderBy("source_label")
        chunks = pages.select(F.col("query_id").cast("int").alias("file_idx"), (F.row_number().over(order) - 1).alias("chunk_idx"), F.col("source_label").alias("source"), F.col("content").alias("chunk"))
        return extract(chunks, self.entities, self.model).withColumn("query_id", F.col("file_idx"))

    def chunks(self, ids: list[int]) -> DataFrame:
        os.makedirs(self.output, exist_ok=True)
        return ChunkCache(self.spark, self.cache or f"file://{Path(self.output).absolute()}/chunks").get(ids, self.extracted)

    def _answered(self, query_id: int, question: DataFrame, method: str) -> DataFrame:
        if method == "plain":
            return PlainModel(self.model).answer(self.spark, question)
        rows = self.chunks([query_id])
        if method == "retrieval":
            return NaiveRetrieval(rows, self.model, self.embedder, **{"top_n": 4, **self.settings}).answer(self.spark, question)
        kg, folder = build_graph(rows).stored(), f"{self.output}/query_{query_id}_{method}"
        if method == "triples":
            return TripleSearch(kg, self.model, self.entities, graph_folder=folder, **self.settings).answer(self.spark, question)
        return CommunitySearch(kg, self.model, self.embedder, graph_folder=folder, **self.settings).answer(self.spark, question)

    def one(self, query_id: int, method: str) -> tuple:
        """A row of results. What fails is logged and leaves an error in the row; the run goes on."""
        log, began = log_of(query_id, method, self.output), time.monotonic()
        log.info("query %d, method %s", query_id, method)
        query = None
        try:
            row = self.corpus.queries(self.spark, [query_id]).first()
            if row is None:
                raise KeyError(f"no such query: {query_id}")
            query, answers = row["question"], [row["answer"], *(row["answer_aliases"] or [])]
            question = self.spark.createDataFrame([(query_id, query)], "qid long, query string")
            answered = self._answered(query_id, question, method)
            known = self.spark.createDataFrame([(query_id, answers)], "qid long, answers array<string>")
            told = self.judged_by(answered.join(known, "qid"), self.model).withColumn("__record", F.to_json(F.struct(*[F.col(c) for c in answered.columns])))
            last = told.select("prediction", "correct", "__record").first()
            log.info("prediction: %s", last["prediction"])
            log.info("correct: %s", last["correct"])
            return query_id, method, query, last["prediction"], last["correct"], time.monotonic() - began, last["__record"], None
        except Exception as e:  # noqa: BLE001 - the other queries are to run all the same
            log.error("failed: %s", e, exc_info=True)
            return query_id, method, query, None, None, time.monotonic() - began, None, f"{type(e).__name__}: {e}"
        finally:
            release(self.spark)
            for h in log.handlers:
                h.flush()

    def run(self, ids: list[int], method: str) -> DataFrame:
        """The results of these queries, one after the other, also as JSON lines in ``results`` of the output folder."""
        if method not in METHODS:
            raise ValueError(f"no such method: {method}")
        os.makedirs(self.output, exist_ok=True)
        rows = [self.one(i, method) for i in ids]  # a row for each asked query
        results = self.spark.createDataFrame(rows, RESULT)
        results.write.mode("append").json(f"file://{Path(self.output).absolute()}/results")
        return results


def accuracy(results: DataFrame) -> DataFrame:
    """(method, asked, failed, accuracy): the share of right answers among the judged ones."""
    return results.groupBy("method").agg(F.count("*").alias("asked"), F.count("error").alias("failed"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("corpus", help="JSON lines of questions")
    parser.add_argument("--query-ids", required=True, help="numbers of lines, separated by commas")
    parser.add_argument("--method", choices=METHODS, default="triples")
    parser.add_argument("--output", default="output")
    parser.add_argument("--models", required=True, help="MODULE:FUNCTION that gives (language model, entity model, embedder)")
    given = parser.parse_args(arguments)
    module, _, name = given.models.partition(":")
    models = getattr(importlib.import_module(module), name)()
    spark = SparkSession.builder.getOrCreate()
    results = Run(spark, MultihopCorpus(given.corpus), *models, output=given.output).run(query_ids(given.query_ids), given.method)
    for row in accuracy(results).collect():
        print(f"{row['method']}: {row['asked']} asked, {row['failed']} failed, accuracy {row['accuracy']}")


if __name__ == "__main__":
    main()
