"""Question answering by chains of communities, for a batch of queries in lockstep."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine_top_alike, match_entities
from ..functions.text import choices, says_yes_once, scored_items
from ..models import Embedder, LanguageModel, ask, embed
from ..operators import community
from ..operators.graph import KnowledgeGraph
from ..operators.louvain import detect
from ..operators.render import colored_chains, gradient, render, save_html
from ..sources.storage import checkpointed
from .qa import Answerer

_LETTERS = 26


@dataclass
class CommunitySearch(Answerer):
    """A chain is a list of communities (qid, chain, pos, comm, nodes, center); each step appends one."""

    kg: KnowledgeGraph
    model: LanguageModel
    embedder: Embedder | None = None
    width: int = 3
    depth: int = 10
    hops: int = 3
    cap: int = 5
    most_candidates: int = 8
    many_centers: bool = False
    update_history: bool = False
    with_hint: bool = False
    tries: int = 3
    threshold: float = 0.8
    top_centers: int = 5
    graph_folder: str | None = None
    _vectors: DataFrame | None = field(default=None, init=False, repr=False)

    def __post_init__(self) -> None:
        if not 0 < self.most_candidates <= _LETTERS:
            raise ValueError("candidates are lettered: 1 to 26 of them")
        if self.many_centers and self.embedder is None:
            raise ValueError("several centers need an embedder")

    def settings(self) -> dict[str, str]:
        return {k: str(getattr(self, k)) for k in ("width", "depth", "hops", "cap", "most_candidates", "many_centers", "update_history", "with_hint", "tries", "threshold", "top_centers")} | {"model": type(self.model).__name__, "embedder": type(self.embedder).__name__}

    def start_nodes(self, queries: DataFrame) -> DataFrame:
        """(qid, chain, node): entities of all the graph that a query names."""
        asked = ask(queries.select("qid", F.concat(F.lit("Name the entities of the question as {entity (Score: x)}.\nQ: "), F.col("query")).alias("prompt")), self.model)
        found = asked.select("qid", F.posexplode(scored_items(F.col("response"))).alias("ord", "r"))
        results = found.select("qid", F.col("r.item").alias("label"), F.col("r.score").alias("score"), "ord").where("score is not null")
        order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "target")
        return match_entities(results, self.kg.nodes).select("qid", (F.row_number().over(order) - 1).alias("chain"), F.col("target").alias("node"))

    def centers_around(self, tails: DataFrame) -> DataFrame:
        """(part, center): the nodes that a tail's ball is drawn around; part names the tail's own center."""
        own = tails.select(F.col("center").alias("part"), "center").distinct()
        if not self.many_centers:
            return own
        if self._vectors is None:  # the nodes are embedded once, however many rounds ask
            vectors = embed(self.kg.nodes, self.embedder, "id").select(F.col("text").alias("candidate"), "emb", F.col("text").alias("ord"))
            self._vectors = checkpointed(vectors)
        vectors = self._vectors
        asked = own.join(vectors, F.col("center") == F.col("candidate")).select(F.col("part").alias("query"), F.col("emb").alias("q_emb"))
        like = cosine_top_alike(asked, vectors, self.threshold, self.top_centers).select(F.col("query").alias("part"), F.col("candidate").alias("center"))
        return own.unionByName(like).distinct()

    def detected(self, around: DataFrame, seed: int) -> DataFrame:
        """(part, comm, node): communities of each part's ball, detected once however many chains share it."""
        ball = self.kg.k_hop(around.select("center").distinct(), self.hops)
        ball = ball.join(around, "center").select("part", "node").distinct()
        parts = detect(self.kg.induced(ball, "part"), ball, "part", self.cap, seed)
        return checkpointed(parts.select("part", F.concat_ws("#", "part", "comm").alias("comm"), "node"))

    def step(self, tails: DataFrame, used: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
        """(picked (qid, chain, comm, nodes, center), home (part, nodes)) for tails (qid, query, chain, center, text)."""
        around = checkpointed(self.centers_around(tails))
        parts, edges = self.detected(around, seed), self.kg.edges
        own = around.select("part", F.col("part").alias("node"))
        at_home = checkpointed(community.community_of(parts, own, "part").where("comm is not null").select("part", F.col("comm").alias("home")))
        home = parts.join(at_home, "part").where("comm = home").select("part", "node")
        if self.many_centers:  # all centers and the home of the first make one community, by which neighbours are told
            home = home.unionByName(around.select("part", F.col("center").alias("node"))).distinct()
            merged = parts.join(home.withColumn("__home", F.lit(True)), ["part", "node"], "left").join(at_home, "part", "left")
            merged = merged.select("part", F.when(F.col("__home"), F.coalesce("home", "part")).otherwise(F.col("comm")).alias("comm"), "node")
        else:
            merged = parts
        merged = checkpointed(merged)
        mine = at_home.select("part", F.col("home").alias("comm"))
        near = community.neighbor_communities(edges, merged, "part").join(mine, "comm").select("part", F.col("comm").alias("home"), F.col("neighbor").alias("comm"), "ord")
        lines = community.edge_lines(community.edges_between(edges, merged, "part"), ["a", "b"])
        near = near.withColumns({"a": F.least("home", "comm"), "b": F.greatest("home", "comm")}).join(lines, ["a", "b"], "left").select("part", "comm", "ord", "bridge")
        near = checkpointed(near)
        candidate = checkpointed(parts.join(near.select("comm").distinct(), "comm", "left_semi"))
        facts = community.scores(edges, candidate, "part").join(community.centers(edges, candidate, "part"), "comm").join(candidate.groupBy("comm").agg(F.array_sort(F.collect_list("node")).alias("nodes")), "comm")
        body = render(community.inner_edges(edges, candidate, "part"), "paths", "comm").select("comm", F.col("text").alias("paths"))
        facts = facts.join(body, "comm", "left").withColumn("body", community.community_text(F.col("center"), F.col("nodes"), F.col("paths"))).drop("paths")
        options = tails.join(near, tails["center"] == near["part"]).select("qid", "query", "chain", "text", "comm", "ord", "bridge").join(facts, "comm")
        options = options.join(used.select("qid", "center"), ["qid", "center"], "left_anti")
        first = Window.partitionBy("qid", "chain", "center").orderBy("ord", "comm")
        options = options.withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("chain_key", F.concat_ws("/", "qid", "chain"))
        kept = community.coarse_prune(options, self.most_candidates, "chain_key")
        lettered = kept.withColumn("idx", F.row_number().over(Window.partitionBy("chain_key").orderBy("rank")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("chain_key")))
        lettered = checkpointed(lettered)
        option = F.concat(F.char(F.col("idx") + 65), F.lit(".\n"), F.concat_ws("\n", "bridge", "body"))
        asked = lettered.where("n > 1").groupBy("chain_key", "query", "text").agg(F.array_sort(F.collect_list(F.struct("idx", option.alias("o")))).alias("os"))
        prompt = F.concat(F.lit("Which option helps to answer? Say {letter (Score: x)}.\nPremise:\n"), F.col("text"), F.lit("\nQ: "), F.col("query"), F.lit("\n"), F.array_join(F.transform("os", lambda x: x["o"]), "\n\n"))
        said = ask(asked.select("chain_key", prompt.alias("prompt")), self.model)
        picks = said.select("chain_key", F.explode(choices(scored_items(F.col("response")))).alias("c")).select("chain_key", "c.idx", "c.score")
        alone = lettered.where("n = 1").select("chain_key", "idx", F.lit(1.0).alias("score"))
        chosen = community.fine_prune(lettered.drop("score", "rank"), picks.where("score > 0").unionByName(alone), 1, "chain_key")
        picked = chosen.select("qid", "chain", "comm", "nodes", "center")
        return checkpointed(picked), checkpointed(home.groupBy("part").agg(F.array_sort(F.collect_set("node")).alias("nodes")))

    def texts(self, chains: DataFrame) -> DataFrame:
        """(qid, chain, text): the communities of a chain in order, each after the first led in by the edges that bridge
        it to the one before."""
        keyed = chains.withColumn("__k", F.concat_ws("/", "qid", "chain", "pos"))
        member = keyed.select(F.col("__k").alias("comm"), F.col("__k").alias("scope"), F.explode("nodes").alias("node"))
        inner = community.inner_edges(self.kg.edges, member, "scope")
        body = render(inner, "paths", "comm").select(F.col("comm").alias("__k"), F.col("text").alias("paths"))
        keyed = keyed.join(body, "__k", "left").select("qid", "chain", "pos", community.community_text(F.col("center"), F.col("nodes"), F.col("paths")).alias("body"), "nodes")
        last = keyed.select("qid", "chain", (F.col("pos") + 1).alias("pos"), F.col("nodes").alias("before"))
        step = keyed.join(last, ["qid", "chain", "pos"]).select("qid", "chain", "pos", F.array_except("nodes", "before").alias("mine"), F.array_except("before", "nodes").alias("theirs"))
        scope = F.concat_ws("/", "qid", "chain", "pos")
        sides = step.select(scope.alias("scope"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("mine").alias("ns")), F.struct(F.lit(1).alias("side"), F.col("theirs").alias("ns")))).alias("s"))
        sides = sides.select("scope", F.concat_ws("#", "scope", "s.side").alias("comm"), F.explode("s.ns").alias("node"))
        bridge = community.edge_lines(community.edges_between(self.kg.edges, sides, "scope"), ["a"]).select(F.regexp_replace("a", "#0$", "").alias("__k"), "bridge")
        steps = keyed.withColumn("__k", scope).join(bridge, "__k", "left")
        return community.join_chain(steps.select("qid", "chain", "pos", "bridge", "body"))

    def save_reasoning_graph(self, chains: DataFrame, path: str) -> None:
        """The whole graph as a page in which the chains' communities and bridges have the colours of their places, from
        blue to red; nothing is written without chains."""
        longest = chains.agg(F.max("pos")).first()[0]
        if longest is None:
            return
        placed = chains.select(F.concat_ws("/", "qid", "chain").alias("chain"), "pos", F.concat_ws("/", "qid", "chain", "pos").alias("comm"), "nodes")
        member = placed.select("comm", F.explode("nodes").alias("node"))
        nodes, edges = colored_chains(self.kg, placed.select("chain", "pos", "comm"), member, gradient(2 * (longest + 1) - 1))
        save_html(nodes, edges, path)

    def retrieve(self, spark: SparkSession, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chains, records (qid, query, steps, early_stop, notes))."""
        live = checkpointed(queries.select(F.col("qid").cast("long").alias("qid"), "query"))
        start = self.start_nodes(live)
        chains = checkpointed(start.select("qid", "chain", F.lit(0).alias("pos"), F.col("node").alias("comm"), F.array("node").alias("nodes"), F.col("node").alias("center")))
        records = live.select("qid", "query", F.lit(1).alias("steps"), F.lit(True).alias("early_stop"), F.lit(None).cast("string").alias("notes")).limit(0)
        for count in range(2, self.depth + 1):
            if live.isEmpty():
                break
            here = chains.join(live.select("qid"), "qid", "left_semi")
            used = checkpointed(community.used_centers(here.drop("center").withColumn("comm", F.concat_ws("/", "qid", "chain", "pos")), here.select(F.concat_ws("/", "qid", "chain", "pos").alias("comm"), "center")))
            text = self.texts(here)
            last = here.groupBy("qid", "chain").agg(F.max_by(F.struct("center", "nodes", "pos"), "pos").alias("t"), F.min_by("center", "pos").alias("head"))
            open_chains = checkpointed(last.join(live, "qid").join(text, ["qid", "chain"]).select("qid", "query", "chain", "text", "t.center", "t.pos", F.col("t.nodes").alias("tail_nodes"), "head"))
            added = None
            for seed in range(2 * self.tries):
                from_head = seed >= self.tries
                rest = open_chains if added is None else open_chains.join(added.select("qid", "chain"), ["qid", "chain"], "left_anti")
                if rest.isEmpty():
                    break
                tails = rest.withColumn("center", F.col("head")) if from_head else rest
                picked, home = self.step(tails.select("qid", "query", "chain", "center", "text"), used, seed % self.tries)
                picked = picked.join(rest.select("qid", "chain", "pos", F.col("center").alias("part"), "tail_nodes"), ["qid", "chain"]).join(home.withColumnRenamed("nodes", "home_nodes"), "part", "left").withColumn("from_tail", F.lit(not from_head))
                added = checkpointed(picked if added is None else added.unionByName(picked))
            grown = added.select("qid", "chain", (F.col("pos") + 1).alias("pos"), "comm", "nodes", "center")
            if count == 2 or self.update_history:
                wider = added.where("from_tail").select("qid", "chain", "pos", F.array_sort(F.array_union("tail_nodes", "home_nodes")).alias("wide"))
                chains = chains.join(wider, ["qid", "chain", "pos"], "left").withColumn("nodes", F.coalesce("wide", "nodes")).drop("wide")
            chains = checkpointed(chains.select("qid", "chain", "pos", "comm", "nodes", "center").unionByName(grown))
            failed = live.join(added.select("qid").distinct(), "qid", "left_anti")
            records = records.unionByName(failed.select("qid", "query", F.lit(count).alias("steps"), F.lit(True).alias("early_stop"), F.lit(None).cast("string").alias("notes")))
            going = live.join(added.select("qid").distinct(), "qid", "left_semi")
            text = self.texts(chains).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chain", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
            said = ask(going.join(text, "qid", "left").select("qid", "query", F.concat(F.lit("Is this enough to answer? Say {Yes} or {No} and why.\nQ: "), F.col("query"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("prompt")), self.model)
            said = said.withColumnRenamed("response", "notes").withColumn("once", says_yes_once(F.col("notes")))
            again = ask(said.where("once is null").select("qid", F.concat(F.lit("Does this say yes? Say yes or no.\n"), F.col("notes")).alias("prompt")), self.model)
            again = again.select("qid", F.contains(F.lower("response"), F.lit("yes")).alias("second"))
            said = checkpointed(said.join(again, "qid", "left").select("qid", "query", "notes", F.coalesce("once", "second", F.lit(False)).alias("enough")))
            end = F.lit(count == self.depth)
            records = checkpointed(records.unionByName(said.where(F.col("enough") | end).select("qid", "query", F.lit(count).alias("steps"), (~F.col("enough")).alias("early_stop"), F.when(F.col("enough"), F.col("notes")).alias("notes"))))
            live = checkpointed(said.where(~F.col("enough") & ~end).select("qid", "query"))
        return chains, records

    def answer(self, spark: SparkSession, queries: DataFrame) -> DataFrame:
        """(qid, query, method, settings, steps, early_stop, chain_lengths, duration, prediction).

        Queries are answered together, so ``duration``, in seconds, is that of the batch. With ``graph_folder`` the
        chains are drawn in it.
        """
        began = time.monotonic()
        chains, records = self.retrieve(spark, queries)
        if self.graph_folder:
            self.save_reasoning_graph(chains, f"{self.graph_folder}/final.html")
        numbered = self.texts(chains).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("chain", "text"))).alias("ts"))
        text = F.array_join(F.transform("ts", lambda x: F.concat(F.lit("Chain "), (x["chain"] + 1).cast("string"), F.lit(":\n"), x["text"])), "\n\n")
        lengths = chains.groupBy("qid", "chain").agg(F.count("*").cast("int").alias("n")).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("chain", "n"))), lambda x: x["n"]).alias("chain_lengths"))
        joined = records.join(numbered.select("qid", text.alias("text")), "qid", "left").join(lengths, "qid", "left")
        hint = F.when(F.lit(self.with_hint) & F.col("notes").isNotNull(), F.concat(F.lit("\nHint: "), F.col("notes"))).otherwise(F.lit(""))
        told = ask(joined.withColumn("prompt", F.concat(F.lit("Answer from these chains.\n"), F.coalesce("text", F.lit("")), hint, F.lit("\nQ: "), F.col("query"), F.lit("\nA: "))), self.model)
        pairs = [F.lit(x) for kv in self.settings().items() for x in kv]
        told = checkpointed(told.select("qid", "query", "steps", "early_stop", "chain_lengths", "response"))
        took = F.lit(time.monotonic() - began).alias("duration")
        return told.select("qid", "query", F.lit("community_search").alias("method"), F.create_map(*pairs).alias("settings"), "steps", "early_stop", F.coalesce("chain_lengths", F.array().cast("array<int>")).alias("chain_lengths"), took, F.col("response").alias("prediction"))
