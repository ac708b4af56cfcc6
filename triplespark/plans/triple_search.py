"""Question answering by beam search over triples, for a batch of queries in lockstep."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SCORED, SCORED_TRIPLE, follow_up, recognise, says_yes_first, scored_items
from ..functions.similarity import match_entities
from ..models import EntityModel, LanguageModel, ask
from ..operators.beam import commit, entity_search, frontier_update, relation_search, spent_entities, triple_prune, triple_scores
from ..operators.graph import KnowledgeGraph
from ..operators.render import colored_rounds, gradient, render, save_html
from ..sources.storage import checkpointed
from .qa import Answerer
from .scoring import ModelScorer, Scorer, UniformScorer, prune

_USED = "qid long, ord long, subject string, label string, object string, round int"


@dataclass
class TripleSearch(Answerer):
    """Settings: ``topics`` is model or entities; ``paths`` is score, scorer, model or model_with_history."""

    kg: KnowledgeGraph
    model: LanguageModel
    entities: EntityModel | None = None
    scorer: Scorer = field(default_factory=UniformScorer)
    top_n: int = 3
    topics: str = "model"
    paths: str = "score"
    new_query: bool = False
    style: str = "triples"
    with_notes: bool = False
    rounds: int = 10
    empty_rounds: int = 3
    graph_folder: str | None = None

    def __post_init__(self) -> None:
        if self.topics not in ("model", "entities") or self.paths not in ("score", "scorer", "model", "model_with_history") or self.style not in ("triples", "paths", "trees"):
            raise ValueError("no such setting")

    def settings(self) -> dict[str, str]:
        return {k: str(getattr(self, k)) for k in ("top_n", "topics", "paths", "new_query", "style", "with_notes", "rounds", "empty_rounds")} | {"model": type(self.model).__name__, "scorer": type(self.scorer).__name__, "entities": type(self.entities).__name__}

    def topic_entities(self, queries: DataFrame, used: DataFrame) -> DataFrame:
        """The first frontier: entities that a query names, of those with an edge left."""
        if self.topics == "entities":
            found = checkpointed(recognise(queries, self.entities, key="qid", text="query"))
            found = found.join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid")
            results = found.select("qid", F.col("entity").alias("label"), (1.0 / F.col("n")).alias("score"), F.xxhash64("entity").alias("ord"))
        else:
            asked = ask(queries.select("qid", F.concat(F.lit("Name the entities of the question as {entity (Score: x)}.\nQ: "), F.col("query")).alias("prompt")), self.model)
            found = asked.select("qid", F.posexplode(scored_items(F.col("response"), SCORED)).alias("ord", "r"))
            results = found.select("qid", F.col("r.item").alias("label"), F.col("r.score").alias("score"), "ord").where("score is not null")
        return match_entities(results, self.kg.nodes, spent_entities(self.kg, used)).select("qid", F.col("target").alias("topic"), F.col("score").alias("topic_score"))

    def retrieved_text(self, used: DataFrame) -> DataFrame:
        return render(used, self.style, "qid", "label" if self.style == "trees" else "round", ["round"] if self.style == "trees" else None)

    def save_used_graph(self, used: DataFrame, path: str) -> None:
        """The edges that all queries have used so far as a page, with the graph's own colours."""
        save_html(self.kg.nodes, used.select("ord", "subject", "label", "object").distinct(), path)

    def save_reasoning_graph(self, used: DataFrame, path: str) -> None:
        """The whole graph as a page in which what was used has the colour of its first round, from blue to red; nothing
        is written if nothing was used."""
        rounds = used.agg(F.max("round")).first()[0]
        if rounds is not None:
            save_html(*colored_rounds(self.kg, used, gradient(rounds)), path)

    def _select(self, queries: DataFrame, scored: DataFrame, used: DataFrame) -> DataFrame:
        if self.paths == "score":
            return triple_prune(scored, self.top_n)
        joined = scored.drop("score").join(queries.select("qid", F.col("query").alias("__q")), "qid")
        if self.paths == "model_with_history":
            known = self.retrieved_text(used).select("qid", F.col("text").alias("__known"))
            joined = joined.join(known, "qid", "left").withColumn("__q", F.concat_ws("\nKnown:\n", "__q", "__known")).drop("__known")
        bar = " " if self.paths == "scorer" else " | "
        line = F.concat_ws(bar, "subject", "label", "object")
        items = joined.withColumn("item", line if self.paths == "scorer" else F.concat(F.lit("("), line, F.lit(")"))).withColumnRenamed("__q", "query")
        scorer = self.scorer if self.paths == "scorer" else ModelScorer(self.model, "Choose and score the triples that help to answer, as {(s | r | o) (Score: x)}.", SCORED_TRIPLE)
        return triple_prune(prune(items, ["qid"], scorer).drop("item", "query"), self.top_n)

    def retrieve(self, spark: SparkSession, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(used edges, records (qid, query, rounds, early_stop, notes)). A round is a few joins over all open queries;
        its frontier and selection are checkpointed. Empty rounds are tried again a bounded number of times."""
        asked = queries.select(F.col("qid").cast("long").alias("qid"), "query")
        live = checkpointed(asked.withColumn("now", F.col("query")))
        used = spark.createDataFrame([], _USED)
        front = checkpointed(self.topic_entities(live.select("qid", F.col("now").alias("query")), used))
        records: list[DataFrame] = []
        done, empty = 0, 0
        while done < self.rounds and empty < self.empty_rounds and not live.isEmpty():
            here = front.join(live.select("qid", F.col("now").alias("query")), "qid")
            relations = relation_search(self.kg, here.select("qid", "topic", "topic_score"), used).join(live.select("qid", F.col("now").alias("query")), "qid")
            relations = prune(relations.withColumns({"item": F.col("label"), "ord": F.col("label")}), ["qid", "topic"], self.scorer).withColumnRenamed("score", "relation_score").drop("item", "ord")
            found = entity_search(self.kg, relations, used)
            found = prune(found.withColumns({"item": F.col("entity"), "ord": F.col("entity")}), ["qid", "topic", "label"], self.scorer).withColumnRenamed("score", "entity_score").drop("item", "ord")
            chosen = checkpointed(self._select(live, triple_scores(self.kg, found), used))
            if chosen.isEmpty():
                empty += 1
                front = checkpointed(self.topic_entities(live.select("qid", F.col("now").alias("query")), used))
                if front.isEmpty():
                    break
                continue
            done, empty = done + 1, 0
            used = checkpointed(commit(used, chosen, done))
            if self.graph_folder:
                self.save_used_graph(used, f"{self.graph_folder}/used_graph_{done}.html")
            text = self.retrieved_text(used)
            prompt = F.concat(F.lit("Is this enough to answer? Say {Yes} or {No} and why.\nQ: "), F.col("query"), F.lit("\n"), F.coalesce("text", F.lit("")))
            text = checkpointed(text)
            said = ask(live.join(text, "qid", "left").select("qid", "query", "now", prompt.alias("prompt")), self.model)
            said = checkpointed(said.select("qid", "query", "now", F.col("response").alias("notes"), says_yes_first(F.col("response")).alias("enough")))
            last = done == self.rounds
            over = said.where(F.lit(True) if last else F.col("enough"))
            records.append(over.select("qid", "query", F.lit(done).alias("rounds"), F.lit(last).alias("early_stop"), "notes"))
            live = said.where(F.lit(False) if last else ~F.col("enough"))
            if self.new_query:
                wish = ask(live.join(text, "qid", "left").select("qid", "query", "now", F.concat(F.lit('Write the next query as {\n"query": ".."\n}.\nQ: '), F.col("query"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("prompt")), self.model)
                live = wish.select("qid", "query", follow_up(F.col("response"), F.col("now")).alias("next"), "now")
                changed = checkpointed(live.where("next <> now").select("qid", F.col("next").alias("query")))
                live = live.select("qid", "query", F.col("next").alias("now"))
            else:
                changed = None
            live = checkpointed(live.select("qid", "query", "now"))
            ahead = frontier_update(chosen).join(live.select("qid"), "qid", "left_semi")
            if changed is not None:
                ahead = ahead.join(changed.select("qid"), "qid", "left_anti")
            ahead = checkpointed(ahead)
            bare = live.join(ahead.select("qid").distinct(), "qid", "left_anti").select("qid", F.col("now").alias("query"))
            front = checkpointed(ahead.unionByName(self.topic_entities(bare, used)))
            out = checkpointed(live.join(front.select("qid").distinct(), "qid", "left_anti"))
            records.append(out.select("qid", "query", F.lit(done).alias("rounds"), F.lit(True).alias("early_stop"), F.lit(None).cast("string").alias("notes")))
            live = live.join(front.select("qid").distinct(), "qid", "left_semi")
        records.append(live.select("qid", "query", F.lit(done).alias("rounds"), F.lit(True).alias("early_stop"), F.lit(None).cast("string").alias("notes")))
        return used, checkpointed(reduce(DataFrame.unionByName, records))

    def answer(self, spark: SparkSession, queries: DataFrame) -> DataFrame:
        """(qid, query, method, settings, rounds, early_stop, duration, prediction).

        Queries are answered together, so ``duration``, in seconds, is that of the batch. With ``graph_folder`` the used
        edges are drawn after each round, and the whole graph at the end.
        """
        began = time.monotonic()
        used, records = self.retrieve(spark, queries)
        if self.graph_folder:
            self.save_reasoning_graph(used, f"{self.graph_folder}/final.html")
        joined = records.join(self.retrieved_text(used), "qid", "left")
        notes = F.when(F.lit(self.with_notes) & ~F.col("early_stop"), F.concat(F.lit("\nNotes: "), F.col("notes"))).otherwise(F.lit(""))
        prompt = F.concat(F.lit("Answer from what is known.\nKnown:\n"), F.coalesce("text", F.lit("")), F.coalesce(notes, F.lit("")), F.lit("\nQ: "), F.col("query"), F.lit("\nA: "))
        told = checkpointed(ask(joined.withColumn("prompt", prompt), self.model).select("qid", "query", "rounds", "early_stop", "response"))
        pairs = [F.lit(x) for kv in self.settings().items() for x in kv]
        took = F.lit(time.monotonic() - began).alias("duration")
        return told.select("qid", "query", F.lit("triple_search").alias("method"), F.create_map(*pairs).alias("settings"), "rounds", "early_stop", took, F.col("response").alias("prediction"))
