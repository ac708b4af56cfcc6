"""Communities over (edges, membership): extraction, scores, neighbourhoods and pruning, for all communities at once.

``membership`` has (comm, node) and is a partition of some nodes. Where several partitions are looked at together, say
those of several balls of a graph, it has a further column, named by ``scope``, that tells them apart: both ends of an
edge are then looked up in the same partition, and comm must be unique over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def _touching(edges: DataFrame, membership: DataFrame, scope: str | None = None) -> DataFrame:
    """([scope,] comm, ord, subject, label, object, inside, outside, other): each edge once for each of its ends that is
    in a community, with the community of the other end, null without any; a self-loop once."""
    end = lambda a, b: F.struct(F.col(a).alias("inside"), F.col(b).alias("outside"))
    ends = F.when(F.col("subject") == F.col("object"), F.array(end("subject", "object"))).otherwise(F.array(end("subject", "object"), end("object", "subject")))
    sides = edges.select("ord", "subject", "label", "object", F.explode(ends).alias("s")).select("ord", "subject", "label", "object", "s.*")
    more = [scope] if scope else []
    here = sides.join(membership.select(*more, "comm", F.col("node").alias("inside")), "inside")
    there = membership.select(*more, F.col("comm").alias("other"), F.col("node").alias("outside"))
    return here.join(there, [*more, "outside"], "left").select(*more, "comm", "ord", "subject", "label", "object", "inside", "outside", "other")


def inner_edges(edges: DataFrame, membership: DataFrame, scope: str | None = None) -> DataFrame:
    """(comm, ord, subject, label, object) with both ends in the community."""
    return _touching(edges, membership, scope).where("comm = other and inside = subject").select("comm", "ord", "subject", "label", "object")


def outer_edges(edges: DataFrame, membership: DataFrame, scope: str | None = None) -> DataFrame:
    """(comm, ord, subject, label, object, inside, outside) with one end in it; a crossing edge counts for both."""
    return _touching(edges, membership, scope).where("not (comm <=> other)").select("comm", "ord", "subject", "label", "object", "inside", "outside")


def scores(edges: DataFrame, membership: DataFrame, scope: str | None = None) -> DataFrame:
    """(comm, score): inner edges less the squared sum of degrees over twice the edges of the graph. Fails without edges."""
    degree = edges.select(F.explode(F.array("subject", "object")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    total = membership.join(degree, "node", "left").groupBy("comm").agg(F.sum(F.coalesce("d", F.lit(0))).alias("d"))
    inner = inner_edges(edges, membership, scope).groupBy("comm").agg(F.count("*").alias("e"))
    m = edges.agg(F.count("*").alias("m")).select(F.when(F.col("m") > 0, F.col("m")).otherwise(F.raise_error(F.lit("a score needs a graph with edges")).cast("long")).alias("m"))
    joined = total.join(inner, "comm", "left").crossJoin(F.broadcast(m))  # m is one row
    return joined.select("comm", (F.coalesce("e", F.lit(0)) - F.col("d").cast("double") * F.col("d") / (2.0 * F.col("m"))).alias("score"))


def centers(edges: DataFrame, membership: DataFrame, scope: str | None = None) -> DataFrame:
    """(comm, center): the node of the highest degree within the community, ties by name."""
    inside = inner_edges(edges, membership, scope).select("comm", F.explode(F.array("subject", "object")).alias("node")).groupBy("comm", "node").agg(F.count("*").alias("d"))
    joined = membership.join(inside, ["comm", "node"], "left").select("comm", "node", F.coalesce("d", F.lit(0)).alias("d"))
    return joined.groupBy("comm").agg(F.min_by("node", F.struct((-F.col("d")).alias("d"), "node")).alias("center"))


def community_of(membership: DataFrame, nodes: DataFrame, scope: str | None = None) -> DataFrame:
    """([scope,] node, comm) with the lowest community of each node, null without any."""
    keys = [scope, "node"] if scope else ["node"]
    return nodes.select(*keys).distinct().join(membership.groupBy(*keys).agg(F.min("comm").alias("comm")), keys, "left")


def _linking(edges: DataFrame, membership: DataFrame, scope: str | None = None) -> DataFrame:
    """(a, b, ord, subject, label, object): each edge between two communities, a the lower one; an edge passes through the
    joins once, not once for each end."""
    more = [scope] if scope else []
    here = membership.select(*more, F.col("comm").alias("cs"), F.col("node").alias("subject"))
    there = membership.select(*more, F.col("comm").alias("co"), F.col("node").alias("object"))
    both = edges.select("ord", "subject", "label", "object").join(here, "subject").join(there, [*more, "object"]).where("cs <> co")
    return both.select(F.least("cs", "co").alias("a"), F.greatest("cs", "co").alias("b"), "ord", "subject", "label", "object")


def neighbor_communities(edges: DataFrame, membership: DataFrame, scope: str | None = None) -> DataFrame:
    """(comm, neighbor, ord): communities that an outer edge leads to, with the first such edge."""
    led = _linking(edges, membership, scope).groupBy("a", "b").agg(F.min("ord").alias("ord"))
    way = lambda x, y: F.struct(F.col(x).alias("comm"), F.col(y).alias("neighbor"))
    return led.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w"), "ord").select("w.comm", "w.neighbor", "ord")


def edges_between(edges: DataFrame, membership: DataFrame, scope: str | None = None) -> DataFrame:
    """(a, b, ord, subject, label, object): edges from one community to another, a the lower one."""
    return _linking(edges, membership, scope)


def edge_lines(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bridge): the edges of each key as lines, in order of insertion."""
    line = F.struct("ord", F.concat_ws(", ", "subject", "label", "object").alias("t"))
    return edges.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_set(line)), lambda x: x["t"]), "\n").alias("bridge"))


def community_text(center: Column, nodes: Column, paths: Column) -> Column:
    """A community as text: its center, its nodes as a sorted list, its inner edges as paths, none for a null."""
    names = F.concat(F.lit("['"), F.array_join(nodes, "', '"), F.lit("']"))
    return F.concat(F.lit("Community("), center, F.lit("\nnodes="), names, F.lit("\n"), F.coalesce(paths, F.lit("")), F.lit("\n)"))


def coarse_prune(candidates: DataFrame, most: int = 8, by: str = "qid") -> DataFrame:
    """candidates (by, comm, score) cut to the best ``most`` of each key, ties by comm."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "comm")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def fine_prune(candidates: DataFrame, scored: DataFrame, top_k: int = 1, by: str = "qid") -> DataFrame:
    """candidates (by, comm, idx) with the choice scores (by, idx, score): the best ``top_k`` of each key.

    Choices out of range are skipped; of one choice's scores the highest counts.
    """
    best = scored.groupBy(by, "idx").agg(F.max("score").alias("score"))
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "idx")
    return candidates.join(best, [by, "idx"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def used_centers(chains: DataFrame, center: DataFrame) -> DataFrame:
    """(qid, center) of all communities of all chains (qid, chain, pos, comm)."""
    return chains.join(center, "comm").select("qid", "center").distinct()


def join_chain(steps: DataFrame) -> DataFrame:
    """(qid, chain, text) of steps (qid, chain, pos, bridge, body), in order: each body led in by its bridge, with blank
    lines between; empty and null parts are left out."""
    whole = F.array_join(F.filter(F.array("bridge", "body"), lambda x: x.isNotNull() & (x != "")), "\n\n")
    parts = steps.withColumn("p", whole).groupBy("qid", "chain").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("ps"))
    return parts.select("qid", "chain", strip(F.array_join(F.filter(F.transform("ps", lambda x: x["p"]), lambda p: p != ""), "\n\n")).alias("text"))


def chain_text(chains: DataFrame, edges: DataFrame, membership: DataFrame, rendered: DataFrame) -> DataFrame:
    """(qid, chain, text): renderings (comm, body) of chains (qid, chain, pos, comm), each after the first led in by the
    edges that bridge it to the one before. A community without a rendering has its bridge alone."""
    lines = edge_lines(edges_between(edges, membership), ["a", "b"])
    order = Window.partitionBy("qid", "chain").orderBy("pos")
    steps = chains.withColumn("last", F.lag("comm").over(order)).withColumns({"a": F.least("last", "comm"), "b": F.greatest("last", "comm")})
    steps = steps.join(lines, ["a", "b"], "left").join(rendered, "comm", "left")
    return join_chain(steps.select("qid", "chain", "pos", F.when(F.col("last").isNotNull(), F.col("bridge")).alias("bridge"), "body"))
