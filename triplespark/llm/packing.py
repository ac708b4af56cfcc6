"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

The rule of Csirik et al. (2006): put an item where the sum over levels of the squared number of partially filled
windows at that level grows least. Only that array of counts decides, so a step costs one pass over the levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .tables import integer_id, repeated, words

WINDOW, LANE_TOKENS = 2048, 4_000_000


class Packer:
    """The levels of one lane, and for each level a stack of the windows that are filled up to it."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(window, level before) for an item of 1 to ``window`` tokens; ties go to the fullest level.

        Moving a window from level h to h + s changes the sum of squares by 2 (N[h+s] - N[h] + 1), where a new window
        has no term for level 0 and a full one none for its end.
        """
        top = self.window - size
        cost = self.count[size : self.window + 1] - self.count[: top + 1] + 1
        cost[top] -= 1 if top == 0 else 0
        cost = 2 * cost
        cost[0] = 2 * self.count[size] + 1 if top else 0
        if top:
            cost[top] = 1 - 2 * self.count[top]
        live = self.count[: top + 1] > 0
        live[0] = True
        cost[~live] = np.iinfo(np.int64).max
        level = top - int(np.argmin(cost[::-1]))
        if level:
            which = self.open[level].pop()
            self.count[level] -= 1
        else:
            which, self.made = self.made, self.made + 1
        if level + size < self.window:
            self.open[level + size].append(which)
            self.count[level + size] += 1
        return which, level


def pack_lane(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece, window, offset, tokens) for each piece. An item longer than a window fills windows of its own
    first; what remains of it is placed like a short one."""
    packer, out = Packer(window), []
    for i, size in enumerate(sizes.tolist()):
        full, rest = divmod(size, window)
        for k in range(full):
            out.append((i, k, packer.made, 0, window))
            packer.made += 1
        if rest:
            which, level = packer.place(rest)
            out.append((i, full, which, level, rest))
    return tuple(np.array(out, np.int64).reshape(-1, 5).T)


_PLACED = "doc_id long, text_hash long, copy long, piece int, lane int, window long, offset int, tokens int"


def _packer(window: int):
    def run(items: pa.Table) -> pa.Table:
        items = items.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("text_hash", "ascending"), ("copy", "ascending")])
        item, piece, which, offset, tokens = pack_lane(items["tokens"].to_numpy(), window)
        placed = items.take(pa.array(item)).select(["doc_id", "text_hash", "copy"])
        for name, values, kind in (("piece", piece, pa.int32()), ("lane", np.repeat(items["lane"].to_numpy()[:1], len(item)), pa.int32()), ("window", which, pa.int64()), ("offset", offset, pa.int32()), ("tokens", tokens, pa.int32())):
            placed = placed.append_column(name, pa.array(values, kind))
        return placed

    return run


def pack(spark: SparkSession, docs: DataFrame, window: int = WINDOW, lane_tokens: int = LANE_TOKENS, seed: int = 5) -> DataFrame:
    """(doc_id, text_hash, copy, piece, lane, window, offset, tokens): where each piece of each document goes.

    Online packing is sequential, so documents are spread by a hash over lanes of about ``lane_tokens`` tokens, each
    packed by itself in hash order; the number of lanes follows the tokens of the corpus, and a lane's work and memory
    stay the same at any size. Only ids, hashes and token counts are shuffled, never a text. Tokens are runs of
    non-space characters of the whole text; a text longer than a window fills windows of its own and leaves a rest.

    A row is named by its doc_id, ``text_hash``, the xxhash64 of its text, and ``copy``, which numbers rows equal in both
    from 0 (repetitions in a mixture, which are packed like any other document, in lanes of their own choosing); with
    ``piece`` that is unique. doc_id must be a whole number of up to 64 bits and may be null or repeated. Documents
    without tokens, of empty or null text, have no piece; an empty table gives an empty result. Other columns, whatever
    their names, don't count.
    """
    scratch = Scratch(spark, "pack")
    sized = docs.select(integer_id(docs).alias("doc_id"), words(F.col("text")).alias("tokens"), F.xxhash64("text").alias("text_hash")).where("tokens > 0")
    counted = scratch.table(sized.groupBy("doc_id", "tokens", "text_hash").agg(F.count("*").alias("rows")), "counted")
    total = counted.agg(F.sum(F.col("tokens") * F.col("rows"))).first()[0] or 0
    lanes = max(1, -(-total // lane_tokens))
    items = repeated(counted, "rows", "copy", spread=True)
    items = items.withColumn("key", F.xxhash64("doc_id", "tokens", "text_hash", "copy", F.lit(seed)))
    laned = items.withColumn("lane", F.pmod("key", F.lit(lanes)).cast("int"))
    return laned.groupBy("lane").applyInArrow(_packer(window), _PLACED)
