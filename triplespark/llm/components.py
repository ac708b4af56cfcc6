"""Connected components by alternating large and small stars (Kiveris et al., 2014), in rounds of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: A chain of n nodes takes about log2(n) rounds.
MOST_ROUNDS = 100


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    linked = e.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, comp) for every node of an edge; comp is the least node of its component.

    ``edges`` has two long columns a and b; self-loops, repeats and either orientation are fine, no edges give no rows.
    A round writes its stars to shared storage, so a lost executor never sends the job back over earlier rounds. Minima
    are aggregates, partial on the map side, and joined back, so the star of a node that a third of all edges meet is
    split like any skewed join. The number of rounds is logarithmic in the number of edges; RuntimeError if they don't
    settle.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    e, before = scratch.table(e, f"{name}-0"), None
    for k in range(1, rounds + 1):
        after = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if after == before or not after[0]:
            break
        before, e = after, scratch.table(_small(_large(e)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError(f"components haven't settled in {rounds} rounds")
    least = e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(least)
