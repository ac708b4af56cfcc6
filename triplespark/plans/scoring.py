"""Pluggable scorers for pruning: uniform, by embedding, or by a language model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import dot, match_scores, norm
from ..functions.text import SCORED, scored_items
from ..models import Embedder, LanguageModel, ask, embed
from ..operators.graph import KnowledgeGraph
from ..sources.storage import checkpointed

_SEP = "\x1f"


class Scorer:
    """Scores items (keys..., qid, query, item, ord) within each group of keys; rows left out are pruned."""

    def score(self, items: DataFrame, keys: list[str]) -> DataFrame:
        raise NotImplementedError


class UniformScorer(Scorer):
    """Shares 1 evenly among the items of a group."""

    def score(self, items: DataFrame, keys: list[str]) -> DataFrame:
        sizes = items.groupBy(*keys).agg((1.0 / F.count("*")).alias("score"))
        return items.join(sizes, keys).select(*items.columns, "score")


def all_embeddings(kg: KnowledgeGraph, embedder: Embedder) -> DataFrame:
    """(text, emb) of all entities and relation labels of a graph, written once for all the rounds of a search."""
    texts = kg.nodes.select(F.col("id").alias("text")).unionByName(kg.distinct_labels().select(F.col("label").alias("text")))
    return checkpointed(embed(texts, embedder))


@dataclass
class EmbeddingScorer(Scorer):
    """Cosine with the query, rounded to 9 decimals; the best ``top_n`` of 0 or more stay, ties by ord.

    ``vectors`` (text, emb) are kept ones, as of :func:`all_embeddings`; only other texts are embedded at a prune.
    """

    embedder: Embedder
    top_n: int = 3
    vectors: DataFrame | None = None

    def embedded(self, items: DataFrame, column: str) -> DataFrame:
        """(text, emb) of the distinct texts of a column: the kept vectors, and new ones of what has none."""
        if self.vectors is None:
            return embed(items, self.embedder, column)
        texts = items.select(F.col(column).alias("text")).where("text is not null").distinct()
        return self.vectors.join(texts, "text", "left_semi").unionByName(embed(texts.join(self.vectors, "text", "left_anti"), self.embedder))

    def score(self, items: DataFrame, keys: list[str]) -> DataFrame:
        q = self.embedded(items, "query").select(F.col("text").alias("query"), F.col("emb").alias("q_emb"))
        e = self.embedded(items, "item").select(F.col("text").alias("item"), "emb")
        scored = items.join(q, "query").join(e, "item").withColumn("score", F.round(dot(F.col("emb"), F.col("q_emb")) / (norm(F.col("emb")) * norm(F.col("q_emb"))), 9))
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "ord")
        kept = scored.where("score >= 0 and not isnan(score)").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.top_n)
        return kept.select(*items.columns, "score")


@dataclass
class ModelScorer(Scorer):
    """One prompt a group; what the answer scores goes to the items most like it."""

    model: LanguageModel
    task: str = "Score how useful each item is for the question, as {item (Score: x)} with scores that sum to 1."
    pattern: str = SCORED

    def score(self, items: DataFrame, keys: list[str]) -> DataFrame:
        named = items.withColumn("__g", F.concat_ws(_SEP, *[F.col(k).cast("string") for k in keys]))
        lists = named.groupBy("__g").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("x"))
        prompt = F.concat(F.lit(self.task + "\nQ: "), F.col("query"), F.lit("\nItems: "), F.array_join(F.transform("x", lambda t: t["item"]), "; "), F.lit("\nA: "))
        asked = ask(lists.select("__g", prompt.alias("prompt")), self.model)
        found = asked.select(F.col("__g").alias("qid"), F.posexplode(scored_items(F.col("response"), self.pattern)).alias("ord", "r"))
        results = checkpointed(found.select("qid", F.col("r.item").alias("label"), F.col("r.score").alias("score"), "ord").where("score is not null"))
        matched = match_scores(results, named.select(F.col("__g").alias("qid"), F.col("item").alias("target"), "ord"))
        return named.join(matched.select(F.col("qid").alias("__g"), F.col("target").alias("item"), "score"), ["__g", "item"]).select(*items.columns, "score")


def prune(items: DataFrame, keys: list[str], scorer: Scorer) -> DataFrame:
    """items with ``score``: a single candidate scores 1 and isn't sent to the scorer.

    Groups are counted by an aggregate and joined back. Both the items and the scores are checkpointed, as they are read
    more than once: no model is asked twice.
    """
    items = checkpointed(items)
    sizes = items.groupBy(*keys).agg(F.count("*").alias("__n"))
    counted = checkpointed(items.join(sizes, keys).select(*items.columns, "__n"))
    single = counted.where("__n = 1").drop("__n").withColumn("score", F.lit(1.0))
    return checkpointed(single.unionByName(scorer.score(counted.where("__n > 1").drop("__n"), keys)))
