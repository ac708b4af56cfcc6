"""The steps of a beam search over triples, each for all queries at once.

A frontier has (qid, topic, topic_score), the used edges (qid, ord, subject, label, object, round).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import KnowledgeGraph, pair


def spent_entities(kg: KnowledgeGraph, used: DataFrame) -> DataFrame:
    """(qid, node) of the nodes all of whose incident edges a query has used: a few, as only ends of used edges can be."""
    ends = F.explode(F.array_distinct(F.array("subject", "object"))).alias("node")
    spent = used.select("qid", "ord", ends).distinct().groupBy("qid", "node").agg(F.count("*").alias("used"))
    total = kg.adjacency.join(spent.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
    return spent.join(total, "node").where("used >= n").select("qid", "node")


def unused_entities(kg: KnowledgeGraph, candidates: DataFrame, used: DataFrame) -> DataFrame:
    """candidates (qid, node) without those of which a query has used every incident edge.

    "Unused" is asked of the nodes that a query is about: no table of all queries times all nodes is made.
    """
    return candidates.join(spent_entities(kg, used), ["qid", "node"], "left_anti")


def open_edges_at(kg: KnowledgeGraph, frontier: DataFrame, used: DataFrame) -> DataFrame:
    """(qid, topic, topic_score, neighbor, label) of the unused edges at the frontier. The edges meet it from either end,
    in four columns; both searches of a round read the same, so it should be written once for them."""
    e = kg.edges.select("ord", "subject", "label", "object")
    out = frontier.join(e, F.col("topic") == F.col("subject")).select(*frontier.columns, F.col("object").alias("neighbor"), "label", "ord")
    back = e.where(~F.col("subject").eqNullSafe(F.col("object")))
    out = out.unionByName(frontier.join(back, F.col("topic") == F.col("object")).select(*frontier.columns, F.col("subject").alias("neighbor"), "label", "ord"))
    return out.join(used.select("qid", "ord"), ["qid", "ord"], "left_anti").select("qid", "topic", "topic_score", "neighbor", "label")


def relation_search(kg: KnowledgeGraph, frontier: DataFrame, used: DataFrame, open_edges: DataFrame | None = None) -> DataFrame:
    """(qid, topic, topic_score, label): distinct labels of unused edges at each topic, in either direction. ``open_edges``
    are those of :func:`open_edges_at`, if they are at hand."""
    return (open_edges_at(kg, frontier, used) if open_edges is None else open_edges).select("qid", "topic", "topic_score", "label").distinct()


def entity_search(kg: KnowledgeGraph, relations: DataFrame, used: DataFrame, open_edges: DataFrame | None = None) -> DataFrame:
    """relations (qid, topic, topic_score, label, ...) with entity: neighbours along unused edges of that label.
    ``open_edges`` are those of a frontier that has all the relations' topics, if they are at hand."""
    if open_edges is None:
        open_edges = open_edges_at(kg, relations.select("qid", "topic", "topic_score").distinct(), used)
    ends = open_edges.select("qid", "topic", "label", F.col("neighbor").alias("entity")).distinct()
    return relations.join(ends, ["qid", "topic", "label"])


def triple_scores(kg: KnowledgeGraph, entities: DataFrame) -> DataFrame:
    """(qid, ord, subject, label, object, score, topics) from (qid, topic, topic_score, label, relation_score, entity,
    entity_score): products summed over all ways to a triple; an edge away from the topic is looked up first."""
    edges = kg.edges.select("ord", "subject", "label", "object")
    ends = lambda a, b: dict(zip(("__lo", "__hi"), pair(a, b), strict=True))
    edges = edges.where("subject is not null and object is not null").withColumns(ends("subject", "object"))  # each edge once
    entities = entities.where("topic is not null and entity is not null").withColumns(ends("topic", "entity"))
    ways = entities.join(edges, ["__lo", "__hi", "label"]).withColumn("way", F.when(F.col("subject") == F.col("topic"), 0).otherwise(1))
    one = ways.groupBy("qid", "topic", "label", "entity").agg(F.min_by(F.struct("ord", "subject", "object", (F.col("topic_score") * F.col("relation_score") * F.col("entity_score")).alias("s")), F.struct("way", "ord")).alias("x"))
    return one.groupBy("qid", F.col("x.ord").alias("ord"), F.col("x.subject").alias("subject"), "label", F.col("x.object").alias("object")).agg(F.sum("x.s").alias("score"), F.array_sort(F.collect_set("topic")).alias("topics"))


def triple_prune(scored: DataFrame, top_n: int = 3) -> DataFrame:
    """scored with rank: the best ``top_n`` triples of each query with a positive score, ties by ord; a query's only
    triple scores 1.

    Triples are counted by an aggregate, and the rank has a limit, which each task applies before the shuffle: no
    query's triples gather in one task.
    """
    single = scored.groupBy("qid").agg(F.count("*").alias("__n")).where("__n = 1").select("qid", F.lit(1.0).alias("__one"))
    counted = scored.join(single, "qid", "left").withColumn("score", F.coalesce("__one", "score")).drop("__one").select(*scored.columns)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "ord")
    return counted.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def commit(used: DataFrame, selected: DataFrame, round_number: int) -> DataFrame:
    """used with the selected triples, which bear the number of this round."""
    return used.unionByName(selected.select("qid", "ord", "subject", "label", "object", F.lit(round_number).alias("round")))


def frontier_update(selected: DataFrame) -> DataFrame:
    """(qid, topic, topic_score) of the next round: the far end of each selected triple that one topic led to, with
    the score of the last such triple, as a share of the query's total."""
    single = selected.where(F.size("topics") == 1)
    far = F.when(F.col("topics")[0] == F.col("subject"), F.col("object")).otherwise(F.col("subject"))
    last = single.groupBy("qid", far.alias("topic")).agg(F.max_by("score", "rank").alias("s"))
    return last.select("qid", "topic", (F.col("s") / F.sum("s").over(Window.partitionBy("qid"))).alias("topic_score"))
