"""The four ways to answer, and the judge."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import cosine_top
from ..functions.text import judged_true
from ..models import Embedder, LanguageModel, ask, embed


class Answerer(ABC):
    """Answers a table of queries (qid, query) all together."""

    @abstractmethod
    def retrieve(self, spark: SparkSession, queries: DataFrame) -> object: ...

    @abstractmethod
    def answer(self, spark: SparkSession, queries: DataFrame) -> DataFrame: ...


@dataclass
class PlainModel(Answerer):
    """The model alone."""

    model: LanguageModel

    def retrieve(self, spark: SparkSession, queries: DataFrame) -> DataFrame:
        return queries.select("qid", F.lit("").alias("context"))

    def answer(self, spark: SparkSession, queries: DataFrame) -> DataFrame:
        return ask(queries, self.model, "query").withColumnRenamed("response", "prediction")


def retrieved_context(queries: DataFrame, chunks: DataFrame, top_n: int = 3) -> DataFrame:
    """(qid, context): the chunks nearest to each query by cosine, best first; (query, q_emb) and (candidate, emb, ord)."""
    top = cosine_top(queries.select(F.col("qid").alias("query"), "q_emb"), chunks, 0.0, top_n)
    return top.groupBy(F.col("query").alias("qid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda x: x["candidate"]), "\n\n").alias("context"))


@dataclass
class NaiveRetrieval(Answerer):
    """The nearest chunks as context; equal chunks count once."""

    chunks: DataFrame
    model: LanguageModel
    embedder: Embedder
    top_n: int = 3

    def retrieve(self, spark: SparkSession, queries: DataFrame) -> DataFrame:
        vectors = embed(self.chunks, self.embedder, "chunk").select(F.col("text").alias("candidate"), "emb", F.col("text").alias("ord"))
        asked = embed(queries, self.embedder, "query").select(F.col("text").alias("query"), F.col("emb").alias("q_emb"))
        return retrieved_context(queries.join(asked, "query"), vectors, self.top_n)

    def answer(self, spark: SparkSession, queries: DataFrame) -> DataFrame:
        found = queries.join(self.retrieve(spark, queries), "qid", "left")
        prompt = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\nQ: "), F.col("query"), F.lit("\nA: "))
        return ask(found.withColumn("prompt", prompt), self.model).select("qid", "query", F.col("response").alias("prediction"))


def judge(predictions: DataFrame, model: LanguageModel) -> DataFrame:
    """predictions (qid, query, prediction, answers array) with ``correct`` by a model's word."""
    prompt = F.concat(F.lit('Is the prediction right? Say {\n"Accuracy": "True"\n} or False.\nQ: '), F.col("query"), F.lit("\nAnswers: "), F.array_join("answers", ", "), F.lit("\nPrediction: "), F.col("prediction"))
    asked = ask(predictions.withColumn("prompt", prompt), model)
    return asked.withColumn("correct", judged_true(F.col("response"))).drop("prompt", "response")


def exact_match(predictions: DataFrame) -> DataFrame:
    """predictions with ``correct``: an answer equals the prediction but for case, articles and punctuation. This is
    our own offline stand-in for the judge."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N} ]+|\b(?:the|an?)\b", " "), r"\s+", " "))
    return predictions.withColumn("correct", F.coalesce(F.exists("answers", lambda a: plain(a) == plain(F.col("prediction"))), F.lit(False)))
