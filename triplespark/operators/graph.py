"""The knowledge graph: an undirected multigraph held as two DataFrames, nodes and edges.

``edges`` has (ord, subject, label, object); ord is a total order of insertion. Direction lives in the columns only:
adjacency, degrees and neighbourhoods look at both ends. Every method returns DataFrames and runs nothing by itself,
but for :meth:`KnowledgeGraph.has_edge`, which counts its probes, :meth:`KnowledgeGraph.stored`, which writes the graph once for all that reads it more than once, and
:meth:`KnowledgeGraph.k_hop`, which cuts its lineage once a hop.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import COLOR_OF, PLAIN
from ..sources.storage import checkpointed


def pair(a: str | Column = "subject", b: str | Column = "object") -> list[Column]:
    """The two ends in order, whichever way an edge points."""
    return [F.least(a, b), F.greatest(a, b)]


def first_edges(triples: DataFrame) -> DataFrame:
    """triples without those whose ends already have an edge of the same label, in either direction; first by ord.

    An aggregate keeps the first row of each key, so map sides combine and no group is sorted. Other columns than (ord,
    subject, label, object) must be kinds, whole numbers under 32: with the direction they make one number, so what is
    kept of a key is fixed in size and hashed in place, where a row of strings would be sorted on both sides of the shuffle.
    """
    kinds = [c for c in triples.columns if c not in ("ord", "subject", "label", "object")]
    lo, hi = pair()
    way = F.when(F.col("subject").isNull(), 2).when(F.col("object").isNull(), 3).when(F.col("subject") == lo, 0).otherwise(1).cast("int")
    for i, c in enumerate(kinds):
        way = way + F.shiftleft(F.col(c).cast("int"), 2 + 5 * i)
    first = triples.select(lo.alias("lo"), hi.alias("hi"), "label", "ord", way.alias("way")).groupBy("lo", "hi", "label").agg(F.min_by("way", "ord").alias("way"), F.min("ord").alias("ord"))
    at = F.col("way").bitwiseAND(3)
    ends = {"subject": F.when(at == 1, F.col("hi")).when(at != 2, F.col("lo")), "object": F.when(at == 1, F.col("lo")).when(at != 3, F.col("hi"))}
    more = {c: F.shiftright("way", 2 + 5 * i).bitwiseAND(31) for i, c in enumerate(kinds)}
    return first.select("ord", "label", *[v.alias(k) for k, v in (ends | more).items()]).select(*triples.columns)


def kind_of(entity_type: Column) -> Column:
    """An entity type as a number: 0 for none, from 1 on for those of the vocabulary, one more than these for any other."""
    numbers = F.create_map(*[F.lit(x) for pair in zip(COLOR_OF, range(1, len(COLOR_OF) + 1), strict=True) for x in pair])
    return F.when(entity_type.isNull(), 0).otherwise(F.coalesce(F.try_element_at(numbers, F.coalesce(entity_type, F.lit(""))), F.lit(len(COLOR_OF) + 1)))


def node_table(edges: DataFrame) -> DataFrame:
    """(id, color) of the ends of the edges: the colour of the last known type, light grey without any.

    ``edges`` carries subject_kind and object_kind (:func:`kind_of`), 0 where a chunk names no type. A node first touched
    with a type outside the vocabulary and never with a known one has no colour.
    """
    side = lambda end, at: F.struct(F.col(end).alias("id"), F.col(f"{end}_kind").alias("kind"), (F.col("ord") * 2 + at).alias("at"))
    touch = edges.select(F.explode(F.array(side("subject", 0), side("object", 1))).alias("t")).select("t.*")
    known, odd = F.col("kind").between(1, len(COLOR_OF)), F.col("kind") > len(COLOR_OF)
    kinds = touch.groupBy("id").agg(F.max_by("kind", F.when(known, F.col("at"))).alias("known"), F.min_by(odd, "at").alias("odd"))
    color = F.try_element_at(F.array(*map(F.lit, COLOR_OF.values())), F.col("known"))
    return kinds.select("id", F.when(F.col("known").isNotNull(), color).when(F.col("odd"), F.lit(None)).otherwise(F.lit(PLAIN)).alias("color"))


#: So many probes are broadcast.
FEW = 10_000


@dataclass(frozen=True)
class KnowledgeGraph:
    nodes: DataFrame
    edges: DataFrame
    typed: DataFrame | None = None
    written: bool = False
    raw: DataFrame | None = None

    @classmethod
    def of(cls, triples: DataFrame) -> KnowledgeGraph:
        """From (ord, subject, label, object, subject_type, object_type)."""
        plain = triples.select("ord", "subject", "label", "object")
        typed = first_edges(triples.select("ord", "subject", "label", "object", kind_of(F.col("subject_type")).alias("subject_kind"), kind_of(F.col("object_type")).alias("object_kind")))
        return cls(node_table(typed), first_edges(plain), typed, raw=plain)

    def stored(self) -> KnowledgeGraph:
        """The same graph with its edges written to shared storage and read back: the triples are read and deduplicated
        once, however often the graph is used; nodes follow from the written edges."""
        if self.typed is None:
            return replace(self, edges=checkpointed(self.edges), written=True)
        typed = checkpointed(self.typed)
        return KnowledgeGraph(node_table(typed), typed.select("ord", "subject", "label", "object"), typed, True)

    @property
    def entities(self) -> DataFrame:
        return self.nodes

    @property
    def adjacency(self) -> DataFrame:
        """(node, neighbor, ord, subject, label, object): each edge from both its ends, a self-loop once."""
        ends = F.when(F.col("subject") == F.col("object"), F.array("subject")).otherwise(F.array("subject", "object"))
        rows = self.edges.withColumn("node", F.explode(ends))
        return rows.select("node", F.when(F.col("node") == F.col("subject"), F.col("object")).otherwise(F.col("subject")).alias("neighbor"), "ord", "subject", "label", "object")

    @property
    def relations(self) -> DataFrame:
        """Distinct (subject, label, object); of equal ones the last."""
        return self.edges.groupBy("subject", "label", "object").agg(F.max("ord").alias("ord"))

    def has_edge(self, probes: DataFrame, labelled: bool = False) -> DataFrame:
        """probes (a, b[, label]) with ``found``.

        An edge is there if any triple says so: nothing is deduplicated but what was asked for and found. The triples pass by
        a hash table of the probes, in each task or, if there are many (they are counted), in that of their key.
        """
        mine = (self.edges if self.raw is None or self.written else self.raw).select(*[c.alias(n) for c, n in zip(pair(), ("lo", "hi"), strict=True)], "label")
        keys = ["lo", "hi", "label"] if labelled else ["lo", "hi"]
        asked = probes.withColumns(dict(zip(("lo", "hi"), pair("a", "b"), strict=True)))
        wanted = asked.select(*keys).distinct().hint("broadcast" if probes.limit(FEW + 1).count() <= FEW else "shuffle_hash")
        mine = mine.join(wanted, keys).select(*keys).distinct().withColumn("hit", F.lit(True))
        return asked.join(mine, keys, "left").select(*probes.columns, F.coalesce("hit", F.lit(False)).alias("found"))

    def degree(self) -> DataFrame:
        """(node, degree): parallel edges count, a self-loop twice."""
        return self.edges.select(F.explode(F.array("subject", "object")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))

    def stats(self) -> DataFrame:
        """One row: numbers of nodes and edges."""
        ends = self.edges.select(F.explode(F.array("subject", "object")).alias("node"))
        return ends.agg(F.countDistinct("node").alias("n_nodes"), (F.count("*") / 2).cast("long").alias("n_edges"))

    def neighbors(self, of: DataFrame | None = None) -> DataFrame:
        adj = self.adjacency
        return adj if of is None else adj.join(of.select("node").distinct(), "node", "left_semi")

    def subject_counts(self) -> DataFrame:
        return self.relations.groupBy("subject").agg(F.count("*").alias("n"))

    def distinct_labels(self) -> DataFrame:
        return self.edges.select("label").distinct()

    def k_hop(self, centers: DataFrame, hops: int = 3) -> DataFrame:
        """(center, node, depth) of the nodes within so many hops of each center.

        A hop joins the frontier to the ends of the edges, from either side, and drops what was seen: a small frontier is
        broadcast, so the edges are read but not shuffled. A center that is no node has no rows.
        """
        ends = self.edges.select("subject", "object")
        ends = ends if self.written else checkpointed(ends)

        def reached(front: DataFrame) -> DataFrame:
            sides = [front.join(ends.select(F.col(a).alias("node"), F.col(b).alias("next")), "node") for a, b in (("subject", "object"), ("object", "subject"))]
            return sides[0].unionByName(sides[1]).select("center", F.col("next").alias("node")).distinct()

        step = checkpointed(reached(centers.select("center", F.col("center").alias("node")).distinct()))
        seen = step.select("center", F.col("center").alias("node"), F.lit(0).alias("depth")).distinct()  # every node has a neighbour
        for depth in range(1, hops + 1):
            front = checkpointed(step.join(seen.select("center", "node"), ["center", "node"], "left_anti"))
            seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
            if depth < hops:
                step = reached(front)
        return seen

    def shared_balls(self, centers: DataFrame, hops: int = 3) -> tuple[DataFrame, DataFrame]:
        """(center, via) and (via, node, depth): the neighbours of each center, and the ball of one hop less around each
        distinct neighbour, once for all centers that have it.

        A center's ball is the center and the balls of its neighbours, one deeper: its depth of a node is the least over
        them, plus one. So nothing is lost, and a hub's surroundings are not repeated for every center beside it.
        """
        kg = self if self.written else self.stored()
        near = kg.k_hop(centers, 1)
        loops = kg.edges.where("subject = object").select(F.col("subject").alias("center")).distinct()
        links = near.where("depth = 1").select("center", F.col("node").alias("via"))
        links = checkpointed(links.unionByName(centers.select("center").distinct().join(loops, "center", "left_semi").select("center", F.col("center").alias("via"))))
        balls = kg.k_hop(links.select(F.col("via").alias("center")).distinct(), hops - 1)
        return links, checkpointed(balls.select(F.col("center").alias("via"), "node", "depth"))

    def shared_ego_edges(self, links: DataFrame, balls: DataFrame, hops: int = 3) -> tuple[DataFrame, DataFrame]:
        """(via, ord, subject, label, object) and (center, ord, subject, label, object): the edges within the ball of each
        neighbour, and those of a center's ball that are within none of its neighbours' balls.

        The latter lead from the rim of one neighbour's ball to the rim of another's, as an edge of any other node of a ball
        stays in the ball one hop wider; so only rims are joined with both ends of the edges.
        """
        inner = checkpointed(self.induced(balls, "via"))
        rim = checkpointed(balls.where(F.col("depth") == hops - 1).select("via", "node"))
        ends = rim.select("node").distinct()
        edges = self.edges.join(ends.withColumnRenamed("node", "subject"), "subject", "left_semi").join(ends.withColumnRenamed("node", "object"), "object", "left_semi")
        crossing = checkpointed(edges).join(rim.select(F.col("node").alias("subject"), F.col("via").alias("a")), "subject").join(rim.select(F.col("node").alias("object"), F.col("via").alias("b")), "object").where("a <> b")
        found = crossing.join(links.select("center", F.col("via").alias("a")), "a").join(links.select("center", F.col("via").alias("b")), ["center", "b"])
        found = checkpointed(found.select("center", "ord", "subject", "label", "object").distinct())
        had = inner.join(found.select("ord").distinct(), "ord", "left_semi").select("via", "ord").join(links, "via").select("center", "ord")
        return inner, found.join(had, ["center", "ord"], "left_anti")

    def folded_balls(self, centers: DataFrame, hops: int = 2, cap: int = 5) -> tuple[DataFrame, DataFrame]:
        """(center, u, v, weight) and (center, via, n): the pairs of each center's ball but for the leaves of a hub that can
        be in no community of at most ``cap`` nodes but their own, and how many these are in the ball of ``via``.

        A leaf has one neighbour in the ball. Leaves of a hub with equal weight are alike, and no more than ``cap - 1`` are
        ever in its community: while one with a gain and room is left outside, moving goes on. So of the ball of a
        center's neighbour, the largest, which all centers beside it share, so many leaves stand in, the first by name,
        besides those that the rest of the center's ball touches. A row with null v is the weight of those left at hub u.
        """
        if hops < 2:
            raise ValueError("balls of two hops or more are folded")
        kg = self if self.written else self.stored()
        links, balls = kg.shared_balls(centers, hops)
        inner, between = kg.shared_ego_edges(links, balls, hops)
        counted = lambda edges, key: edges.groupBy(key, *[c.alias(n) for c, n in zip(pair(), ("u", "v"), strict=True)]).agg(F.count("*").alias("weight"))
        inner = checkpointed(counted(inner, "via"))
        size = balls.groupBy("via").agg(F.count("*").alias("n"))
        main = checkpointed(links.join(size, "via").groupBy("center").agg(F.max_by("via", F.struct("n", "via")).alias("main")))
        mains = main.select(F.col("main").alias("via")).distinct()
        big = inner.join(mains, "via", "left_semi")
        sides = F.when(F.col("u") == F.col("v"), F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("hub")))).otherwise(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("hub")), F.struct(F.col("v").alias("node"), F.col("u").alias("hub"))))
        ends = big.select("via", "weight", F.explode(sides).alias("x")).select("via", "weight", "x.*")
        leaves = ends.groupBy("via", "node").agg(F.count("*").alias("n"), F.max("hub").alias("hub"), F.sum("weight").alias("weight")).where("n = 1 and hub <> node and node <> via").drop("n")
        leaves = checkpointed(leaves)
        is_leaf = leaves.select("via", "node")
        core = big.join(is_leaf.withColumnRenamed("node", "u"), ["via", "u"], "left_anti").join(is_leaf.withColumnRenamed("node", "v"), ["via", "v"], "left_anti")
        others = links.join(main.withColumnRenamed("main", "via"), ["center", "via"], "left_anti")
        between = checkpointed(counted(between, "center"))
        rest = checkpointed(inner.join(others, "via").select("center", "u", "v", "weight").unionByName(between))
        named = links.select("center", F.explode(F.array("center", "via")).alias("node")).unionByName(rest.select("center", F.explode(F.array("u", "v")).alias("node"))).distinct()
        touched = named.join(main.withColumnRenamed("main", "via"), "center").join(leaves, ["via", "node"])
        touched = checkpointed(touched.select("center", "via", "node", "hub", "weight"))
        alike = ["via", "hub", "weight"]
        gone = touched.groupBy("center", *alike).agg(F.count("*").alias("t"))
        most = cap - 1 + (gone.agg(F.max("t")).first()[0] or 0)
        groups = leaves.groupBy(*alike).agg(F.count("*").alias("n"))
        first = leaves.withColumn("rank", F.row_number().over(Window.partitionBy(*alike).orderBy("node"))).where(F.col("rank") <= most)
        asked = checkpointed(main.withColumnRenamed("main", "via").join(groups, "via").join(gone, ["center", *alike], "left").withColumn("t", F.coalesce("t", F.lit(0))))
        shown = asked.join(first, alike).where(F.col("rank") <= cap - 1 + F.col("t")).join(touched.select("center", "via", "node"), ["center", "via", "node"], "left_anti")
        shown = shown.withColumn("rank", F.row_number().over(Window.partitionBy("center", *alike).orderBy("rank"))).where(F.col("rank") < cap)
        own = touched.unionByName(shown.select("center", "via", "node", "hub", "weight"))
        pairs = rest.unionByName(core.join(main.withColumnRenamed("main", "via"), "via").select("center", "u", "v", "weight")).unionByName(own.select("center", *[c.alias(n) for c, n in zip(pair("node", "hub"), ("u", "v"), strict=True)], "weight")).distinct()
        left = asked.withColumn("n", F.col("n") - F.col("t") - F.least(F.lit(cap - 1), F.col("n") - F.col("t"))).where("n > 0")
        pairs = pairs.unionByName(left.select("center", F.col("hub").alias("u"), F.lit(None).cast("string").alias("v"), (F.col("n") * F.col("weight")).alias("weight")))
        return checkpointed(pairs), checkpointed(left.groupBy("center", "via").agg(F.sum("n").alias("n")))

    def induced(self, members: DataFrame, key: str = "center") -> DataFrame:
        """(key, ord, subject, label, object): the edges with both ends among a key's nodes (key, node)."""
        ends = members.select(key, "node").distinct()
        both = self.edges.join(ends.withColumnRenamed("node", "subject"), "subject")
        return both.join(ends.withColumnRenamed("node", "object"), [key, "object"], "left_semi").select(key, "ord", "subject", "label", "object")


def distinct_nodes(spark: SparkSession, edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("subject", "object")).alias("node")).distinct()


def last_edge_colors(edges: DataFrame) -> DataFrame:
    """(ord, color): each edge takes the first colour other than light grey among those between its two ends."""
    lo, hi = pair()
    window = Window.partitionBy(lo, hi)
    other = F.min_by("color", F.when(F.coalesce("color", F.lit(PLAIN)) != PLAIN, F.col("ord"))).over(window)
    return edges.select("ord", F.coalesce(other, F.lit(PLAIN)).alias("color"))


def round_color_index(edges: DataFrame) -> DataFrame:
    """(ord, color_index) of edges with a round: the least round between the same two ends, less one."""
    lo, hi = pair()
    return edges.select("ord", (F.min("round").over(Window.partitionBy(lo, hi)) - 1).alias("color_index"))
