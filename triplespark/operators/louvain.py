"""Community detection by Louvain's method with a cap on a community's size.

Local moving is sequential, so whole ego graphs, which are small, go to ``applyInPandas``, one group each. A graph of
any size is partitioned by :func:`partition_graph`, in rounds of joins and aggregates of which each accepts moves that
don't meet.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed


def weighted(edges: DataFrame) -> DataFrame:
    """(u, v, weight) with u <= v: parallel edges counted."""
    return edges.groupBy(F.least("subject", "object").alias("u"), F.greatest("subject", "object").alias("v")).agg(F.count("*").alias("weight"))


def _degrees(w: DataFrame) -> DataFrame:
    return w.select(F.explode(F.array("u", "v")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("k"))


def first_gains(w: DataFrame) -> DataFrame:
    """(node, neighbor, gain) of each move of a first pass over singletons: weight / m - k_i k_j / 2 m^2.

    A pair meets the degrees of its ends once, before it becomes two moves; ``w`` is read three times, so it should be a
    written table.
    """
    k, m = _degrees(w), w.agg(F.sum("weight").cast("double").alias("m"))
    both = w.where("u <> v").join(k.select(F.col("node").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("node").alias("v"), F.col("k").alias("kv")), "v").crossJoin(F.broadcast(m))
    move = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("neighbor"), F.col(f"k{a}").alias("ki"), F.col(f"k{b}").alias("kj"))
    moves = both.select(F.explode(F.array(move("u", "v"), move("v", "u"))).alias("x"), "weight", "m").select("x.*", "weight", "m")
    return moves.select("node", "neighbor", (F.col("weight") / F.col("m") - F.col("ki").cast("double") * F.col("kj") / (2 * F.col("m") * F.col("m"))).alias("gain"))


def aggregate(w: DataFrame, membership: DataFrame) -> DataFrame:
    """(u, v, weight) over communities; edges within one become its self-loop."""
    a = membership.select(F.col("node").alias("u"), F.col("comm").alias("cu"))
    b = membership.select(F.col("node").alias("v"), F.col("comm").alias("cv"))
    joined = w.join(a, "u").join(b, "v")
    return joined.groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("weight").alias("weight"))


def pairs(edges: DataFrame) -> DataFrame:
    """(u, v, weight) with u <= v, a row for each edge: what :func:`modularity` sums, without the shuffle of a count."""
    return edges.select(F.least("subject", "object").alias("u"), F.greatest("subject", "object").alias("v"), F.lit(1).cast("long").alias("weight"))


def modularity(w: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the sum over communities of L / m - (d / 2m)^2. The edges meet the communities of either end once, and
    give degrees and inner weights in one aggregate."""
    of = membership.groupBy("node").agg(F.collect_list("comm").alias("cs"))
    both = w.join(of.select(F.col("node").alias("u"), F.col("cs").alias("cu")), "u", "left").join(of.select(F.col("node").alias("v"), F.col("cs").alias("cv")), "v", "left")
    none = F.lit(0).cast("long")
    part = lambda c, d, l: F.struct(c.alias("comm"), d.alias("d"), l.alias("l"))
    ends = [F.transform(F.coalesce(cs, F.array().cast(both.schema["cu"].dataType)), lambda c: part(c, F.col("weight"), none)) for cs in (F.col("cu"), F.col("cv"))]
    inner = F.flatten(F.transform("cu", lambda c: F.transform(F.filter("cv", lambda o: o == c), lambda o: part(o, none, F.col("weight")))))
    held = both.select(F.explode(F.concat(*ends, F.coalesce(inner, F.array().cast(both.select(ends[0]).schema[0].dataType)))).alias("x")).select("x.*").groupBy("comm").agg(F.sum("d").alias("d"), F.sum("l").alias("l"))
    m = w.agg(F.sum("weight").cast("double").alias("m"))
    return held.crossJoin(F.broadcast(m)).agg(F.sum(F.col("l") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))).alias("modularity"))


def singletons(w: DataFrame) -> float:
    """The modularity of every node by itself."""
    return _singletons(w, _degrees(w), w.agg(F.sum("weight").cast("double")).first()[0])


def _quality(weight: dict[tuple, int], part: dict) -> float:
    m = sum(weight.values())
    inner: dict = {}
    degree: dict = {}
    for (u, v), w in weight.items():
        for end in (u, v):
            degree[part[end]] = degree.get(part[end], 0) + w
        if part[u] == part[v]:
            inner[part[u]] = inner.get(part[u], 0) + w
    return sum(inner.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


def _move(weight: dict[tuple, int], size: dict, cap: float, rng: random.Random) -> dict:
    """One pass of local moving to a standstill; a move needs a positive gain, the largest, and room."""
    near: dict = {n: {} for n in size}
    for (u, v), w in weight.items():
        near[u][v] = near[u].get(v, 0) + w
        near[v][u] = near[v].get(u, 0) + (w if u != v else 0)
    degree = {n: sum(x.values()) + x.get(n, 0) for n, x in near.items()}
    m = sum(weight.values())
    of, held, room = {n: n for n in size}, dict(degree), dict(size)
    nodes = sorted(size)
    rng.shuffle(nodes)
    moved = m > 0
    while moved:
        moved = False
        for n in nodes:
            home = of[n]
            held[home] -= degree[n]
            room[home] -= size[n]
            towards: dict = {}
            for o, w in near[n].items():
                if o != n:
                    towards[of[o]] = towards.get(of[o], 0) + w
            best, gain = home, 0.0
            for c in sorted(towards):
                g = towards[c] / m - degree[n] * held[c] / (2 * m * m)
                if g > gain and room[c] + size[n] <= cap:
                    best, gain = c, g
            of[n] = best
            held[best] += degree[n]
            room[best] += size[n]
            moved |= best != home
    return of


def partition(nodes: list[str], weight: dict[tuple[str, str], int], cap: int | None = None, seed: int = 0, size: dict[str, int] | None = None) -> list[list[str]]:
    """Communities, each sorted, in order of their first node. At most ``cap`` nodes make one community, connected or
    not; otherwise rounds of moving and aggregation go on while modularity strictly rises, and the last partition
    before that stops is the result. ``size`` says how many nodes some of them count as, of the others each is one."""
    size = size or {}
    if cap is not None and sum(size.get(n, 1) for n in nodes) <= cap:
        return [sorted(nodes)] if nodes else []
    rng = random.Random(seed)
    ids = {n: i for i, n in enumerate(sorted(nodes))}
    members = {i: [n] for n, i in ids.items()}
    small = {tuple(sorted((ids[u], ids[v]))): w for (u, v), w in weight.items()}
    best, quality = [[n] for n in sorted(nodes)], None
    if weight:
        quality = _quality(weight, {n: n for n in nodes})
    while weight:
        of = _move(small, {i: sum(size.get(n, 1) for n in x) for i, x in members.items()}, cap or float("inf"), rng)
        names = {c: k for k, c in enumerate(sorted(set(of.values())))}
        merged: dict[int, list[str]] = {k: [] for k in names.values()}
        for i, x in members.items():
            merged[names[of[i]]] += x
        grouped: dict = {}
        for (u, v), w in small.items():
            key = tuple(sorted((names[of[u]], names[of[v]])))
            grouped[key] = grouped.get(key, 0) + w
        after = _quality(weight, {n: k for k, x in merged.items() for n in x})
        if after <= quality:
            break
        members, small, quality = merged, grouped, after
        best = [sorted(x) for x in merged.values()]
    return sorted(best)


def detect(edges: DataFrame, members: DataFrame | None = None, key: str = "center", cap: int | None = 5, seed: int = 0) -> DataFrame:
    """(key, comm, node): the partition of each key's graph of edges (key, subject, object); ``members`` (key, node)
    adds nodes without edges. Communities are numbered from 0 in order of their first node, under a fixed seed."""
    w = edges.groupBy(key, F.least("subject", "object").alias("u"), F.greatest("subject", "object").alias("v")).agg(F.count("*").alias("weight"))
    if members is not None:
        w = w.unionByName(members.select(key, F.col("node").alias("u"), F.lit(None).cast("string").alias("v"), F.lit(0).cast("long").alias("weight")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        linked = pdf[pdf["weight"] > 0]
        weight = {(u, v): int(x) for u, v, x in zip(linked["u"], linked["v"], linked["weight"], strict=True)}
        nodes = sorted(set(pdf["u"].dropna()) | set(pdf["v"].dropna()))
        rows = [(pdf[key].iloc[0], c, n) for c, x in enumerate(partition(nodes, weight, cap, seed)) for n in x]
        return pd.DataFrame(rows, columns=[key, "comm", "node"])

    kind = edges.schema[key].dataType.simpleString()
    return w.groupBy(key).applyInPandas(run, f"{key} {kind}, comm long, node string")


def detect_folded(w: DataFrame, cap: int, seed: int = 0, key: str = "center") -> DataFrame:
    """(key, comm, node): the partition of each key's graph of pairs (key, u, v, weight); a row without v stands for leaves
    of u that stay alone (:meth:`KnowledgeGraph.folded_balls`), with their weight in all. They have no rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf["u"]) | set(pdf["v"].dropna()))
        weight: dict = {}
        size: dict = {}
        for u, v, x in zip(pdf["u"], pdf["v"], pdf["weight"], strict=True):
            if pd.isna(v):
                v = f"{nodes[-1]}~{len(size)}"  # after all names; too large for any community
                size[v] = cap
            weight[(u, v)] = int(x)
        parts = [x for x in partition([*nodes, *size], weight, cap, seed, size) if x[0] not in size]
        rows = [(pdf[key].iloc[0], c, n) for c, x in enumerate(parts) for n in x]
        return pd.DataFrame(rows, columns=[key, "comm", "node"])

    kind = w.schema[key].dataType.simpleString()
    return w.groupBy(key).applyInPandas(run, f"{key} {kind}, comm long, node string")


#: Communities that a node may choose from in a round of :func:`partition_graph`.
CHOICES = 8


def _keyed(name: Column, seed: int) -> Column:
    return F.when(name.isNotNull(), F.xxhash64(name, F.lit(seed)))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, node) and (u, v, weight) over ids: hashes of the names, under the first seed by which no two names meet."""
    seed = 0
    while True:
        lo, hi = F.least("subject", "object"), F.greatest("subject", "object")
        named = edges.select(lo.alias("a"), hi.alias("b")).select(F.explode(F.array("a", "b")).alias("node")).where("node is not null")
        names = checkpointed(named.groupBy(_keyed(F.col("node"), seed).alias("id")).agg(F.min("node").alias("node"), F.max("node").alias("other")))
        if names.where("node <> other").isEmpty():
            return names.select("id", "node"), checkpointed(edges.select(_keyed(lo, seed).alias("a"), _keyed(hi, seed).alias("b")).groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("weight")))
        seed += 1


def _singletons(w: DataFrame, state: DataFrame, m: float) -> float:
    """The modularity of a graph whose nodes, of degree k, are communities each by itself."""
    inner = w.agg(F.sum(F.when(F.col("u") == F.col("v"), F.col("weight")))).first()[0] or 0
    return inner / m - state.agg(F.sum(F.pow(F.col("k") / (2 * m), F.lit(2)))).first()[0]


def _wishes(links: DataFrame, state: DataFrame, m: float, cap: int | None) -> DataFrame:
    """(node, home, size, k, to, room, rise) of the nodes that gain by a move: to the communities, of those with room, that
    they gain most by joining, ``CHOICES`` of them, as a round may close the first."""
    held = state.groupBy("comm").agg(F.sum("k").alias("held"), F.sum("size").alias("room"))
    at = checkpointed(state.join(held, "comm"))
    far = links.join(at.select(F.col("node").alias("neighbor"), F.col("comm").alias("to"), F.col("held").alias("to_held"), "room"), "neighbor")
    towards = far.select("node", "to", "weight", "to_held", "room").repartition("node").groupBy("node", "to", "to_held", "room").agg(F.sum("weight").alias("w"))
    near = towards.join(at.select("node", F.col("comm").alias("home"), F.col("held").alias("home_held"), "size", "k"), "node")
    own = F.col("to") == F.col("home")
    cost = lambda held: F.col("k").cast("double") * held / (2 * m * m)
    gain = F.col("w") / m - cost(F.col("to_held") - F.when(own, F.col("k")).otherwise(0))
    near = near.withColumn("gain", gain)
    fits = F.lit(True) if cap is None else F.col("room") + F.col("size") <= cap
    free = ~own & fits & (F.col("gain") > 0)
    near = near.withColumn("stay", F.coalesce(F.max(F.when(own, F.col("gain"))).over(Window.partitionBy("node")), -cost(F.col("home_held") - F.col("k"))))
    wish = near.where(free).select("node", "home", "size", "k", "to", "room", (F.col("gain") - F.col("stay")).alias("rise")).where(F.col("rise") * m > 1e-9)
    return wish.withColumn("choice", F.row_number().over(Window.partitionBy("node").orderBy(F.col("rise").desc(), "to"))).where(F.col("choice") <= CHOICES).drop("choice")


def _sweep(links: DataFrame, state: DataFrame, m: float, cap: int | None, passes: int = 4) -> DataFrame:
    """(node, to): the moves accepted in a round.

    Of each community the node that gains most may leave. A community takes in others if more nodes want to join it than
    the one that its own node wants to join, and none leaves it then; the rest may leave if they come among the first
    that fit. Nodes are taken in order of their gain, each as far as it fits and still gains with all before it inside.
    What meets none of the communities that were left or joined goes on, with the next choice if the first is closed, in
    ``passes`` in all. So a community is left once or joined in one pass, gains add up, and modularity rises.
    """
    order = F.struct((-F.col("rise")).alias("r"), "node", "to")
    rest, accepted = checkpointed(_wishes(links, state, m, cap)), None
    for last in [False] * (passes - 1) + [True]:
        wish = checkpointed(rest.groupBy("home").agg(F.min_by(F.struct("node", "size", "k", "to", "room", "rise"), order).alias("x")).select("home", "x.*"))
        asked = wish.groupBy("to").agg(F.count("*").alias("asked"))
        both = wish.join(asked, "to").join(asked.select(F.col("to").alias("home"), F.col("asked").alias("home_asked")), "home", "left")
        up = F.struct("asked", F.xxhash64("to").alias("h"), F.col("to").alias("c")) > F.struct(F.coalesce("home_asked", F.lit(0)).alias("asked"), F.xxhash64("home").alias("h"), F.col("home").alias("c"))
        turn = Window.partitionBy("to").orderBy(F.col("rise").desc(), "node")
        rising = both.where(up).select("node", "home", "size", "k", "to", "room", "rise")
        if cap is not None:  # no more than these fit; each task drops the rest before the shuffle
            rising = rising.withColumn("n", F.row_number().over(turn)).where(F.col("n") < cap).drop("n")
        rising = checkpointed(rising)
        coming = rising.join(rising.select(F.col("home").alias("to")), "to", "left_anti")
        before = turn.rowsBetween(Window.unboundedPreceding, -1)
        coming = coming.withColumns({"filled": F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, 0)), "ahead": F.coalesce(F.sum("k").over(before), F.lit(0))})
        fits = F.lit(True) if cap is None else F.col("room") + F.col("filled") <= cap
        gains = F.col("rise") - F.col("k").cast("double") * F.col("ahead") / (2 * m * m) > 0
        took = checkpointed(coming.where(fits & ((F.col("ahead") == 0) | gains)).select("node", "home", "to"))
        accepted = took if accepted is None else accepted.unionByName(took)
        if last:
            break
        met = took.select(F.explode(F.array("home", "to")).alias("met")).distinct()
        rest = checkpointed(rest.join(met, F.col("home") == F.col("met"), "left_anti").join(met, F.col("to") == F.col("met"), "left_anti"))
        if rest.isEmpty():
            break
    return checkpointed(accepted.select("node", "to"))


def partition_graph(edges: DataFrame, cap: int | None = 5, settled: float = 0.002) -> DataFrame:
    """(node, comm): the partition of a graph of any size, comm being the least node of each community.

    The levels are those of :func:`partition`: moves from single nodes on until no move gains, or until a round
    makes no more moves than a share of ``settled`` of the graph's nodes (with 0, and in graphs of under 500 nodes, none),
    then communities become nodes; a level whose first round is already such a one is the last; levels go on while modularity strictly
    rises, and the last partition before that stops is the result. Every state is a written table over numbers, nothing is
    collected but totals; a node's links are summed in one task, by hash.
    """
    names, w = _numbered(edges)
    m = w.agg(F.sum("weight").cast("double")).first()[0]
    members = names.select("id", F.col("id").alias("comm"))
    if m:
        state = checkpointed(_degrees(w).where("node is not null").withColumn("size", F.lit(1).cast("long")))
        quality, enough = _singletons(w, state, m), settled * names.count()
    while m:
        both = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("neighbor")), F.struct(F.col("v").alias("node"), F.col("u").alias("neighbor"))))
        links = checkpointed(w.where("u <> v").select(both.alias("x"), "weight").select("x.*", "weight"))
        state, moved = state.withColumn("comm", F.col("node")), []
        while not moved or moved[-1] > enough:
            accepted = _sweep(links, state, m, cap)
            moved.append(accepted.count())
            state = checkpointed(state.join(accepted, "node", "left").withColumn("comm", F.coalesce("to", "comm")).drop("to"))
        merged = checkpointed(aggregate(w, state.select("node", "comm")))
        joined = checkpointed(state.groupBy(F.col("comm").alias("node")).agg(F.sum("k").alias("k"), F.sum("size").alias("size")))
        risen = _singletons(merged, joined, m)
        over = risen <= quality
        if not over:
            to = state.select(F.col("node").alias("comm"), F.col("comm").alias("to"))
            members = checkpointed(members.join(to, "comm").select("id", F.col("to").alias("comm")))
        if over or moved[0] <= enough:
            break
        w, state, quality = merged, joined, risen
    named = members.join(names, "id").select("node", "comm")
    least = named.groupBy("comm").agg(F.min("node").alias("least"))
    return named.join(least, "comm").select("node", F.col("least").alias("comm"))
