"""Fuzzy and cosine top-n matching, and the assignment of scored labels to targets.

A search takes a stated set of queries against all candidates. Queries of at most ``BROADCAST_BYTES`` are sent to the
tasks, each of which keeps the best of the candidates it reads; more queries meet the candidates in blocks of both. The
result is the same, and no table of pairs is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed

#: The most bytes of queries that are broadcast.
BROADCAST_BYTES = 32 << 20
#: The most cells of a matrix of letters.
CELLS = 1 << 22


class Letters:
    """Strings as a matrix of codes, a column each, zero after the end."""

    def __init__(self, strings: list[str]):
        self.lengths = np.array([len(x) for x in strings], np.int64)
        flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.zeros((len(strings), int(self.lengths.max(initial=0))), np.uint32)
        codes[np.arange(codes.shape[1])[None, :] < self.lengths[:, None]] = flat
        self.letters, inverse = np.unique(codes, return_inverse=True)
        self.inverse = np.ascontiguousarray(inverse.reshape(codes.shape).T)

    def common(self, a: str, rows: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of a and each of the strings of these rows; bit-parallel over
        words of 63 bits of a, and over all rows at once."""
        blocks = [a[i : i + 63] for i in range(0, len(a), 63)]
        state = [np.full(len(rows), (1 << len(x)) - 1, np.uint64) for x in blocks]
        masks = []
        for x in blocks:
            of: dict[int, int] = {}
            for i, c in enumerate(x):
                of[ord(c)] = of.get(ord(c), 0) | 1 << i
            masks.append(np.array([of.get(int(c), 0) if c else 0 for c in self.letters], np.uint64))
        for j in range(int(self.lengths[rows].max(initial=0))):
            carry, letter = np.zeros(len(rows), np.uint64), self.inverse[j][rows]
            for k, x in enumerate(blocks):
                full = np.uint64((1 << len(x)) - 1)
                s = state[k]
                u = s & masks[k][letter]
                added = s + u + carry
                carry = (added >> np.uint64(len(x))) & np.uint64(1)
                state[k] = ((added & full) | (s & ~u)) & full
        return sum((len(x) - np.bitwise_count(s).astype(np.int64) for x, s in zip(blocks, state, strict=True)), np.zeros(len(rows), np.int64))

    def ratios(self, a: str, rows: np.ndarray) -> np.ndarray:
        """Indel similarity, 0 to 100: 200 times the longest common subsequence over the summed lengths. Two empty
        strings are alike."""
        total = len(a) + self.lengths[rows]
        return np.where(total > 0, 200.0 * self.common(a, rows) / np.maximum(1, total), 100.0)

    def bounds(self, a: str) -> np.ndarray:
        """What the lengths alone let a ratio reach, by the same formula, so no rounding puts it under the ratio."""
        total = len(a) + self.lengths
        return np.where(total > 0, 200.0 * np.minimum(len(a), self.lengths) / np.maximum(1, total), 100.0)


def ratios(targets: list[str | None], candidates: list[str | None]) -> np.ndarray:
    """Indel similarity of each pair; a null gives NaN."""
    out = np.full(len(targets), np.nan)
    by: dict[str, list[int]] = {}
    for i, (t, c) in enumerate(zip(targets, candidates, strict=True)):
        if t is not None and c is not None:
            by.setdefault(t, []).append(i)
    for t, at in by.items():
        some = Letters([candidates[i] for i in at])
        out[at] = some.ratios(t, np.arange(len(at)))
    return out


def _ratio_arrays(a: pa.Array, b: pa.Array) -> pa.Array:
    score = ratios(a.to_pylist(), b.to_pylist())
    return pa.array(score, mask=np.isnan(score))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Indel similarity, 0 to 100, in Arrow batches."""
    return F.arrow_udf(_ratio_arrays, "double")(a, b)


def fuzzy_ratio_native(a: Column, b: Column) -> Column:
    """The same by built-in functions alone: a fold over the letters of a that carries one row of the table."""
    letters = F.split(b, "(?!^)")

    def step(row: Column, ch: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            here = F.when(F.get(letters, j) == ch, F.get(row, j) + 1).otherwise(F.greatest(F.get(row, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(here))

        return F.aggregate(F.sequence(F.lit(0), F.length(b) - 1), F.array(F.lit(0)), cell)

    zeros = F.array_repeat(F.lit(0), F.length(b) + 1)
    table = F.aggregate(F.split(a, "(?!^)"), zeros, step)
    total = F.length(a) + F.length(b)
    common = F.when((F.length(a) > 0) & (F.length(b) > 0), F.element_at(table, -1)).otherwise(F.lit(0))
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * common / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _best(found: pa.Table, top_n: int) -> pa.Table:
    """The best rows of each ``i`` by score, ties by ord; in order of i and rank."""
    found = found.sort_by([("i", "ascending"), ("score", "descending"), ("ord", "ascending")])
    i = found["i"].to_numpy()
    return found.filter(pa.array(np.arange(len(i)) - np.searchsorted(i, i) < top_n))


#: A searcher takes queries (query, value) and returns a function of candidates (candidate, ord, value) and, for each
#: query, the least score that is of use; that gives (i, candidate, ord, score) of the best ones, i being a query's number.
Searcher = Callable[[pa.Table, float, int], Callable[[pa.Table, np.ndarray], pa.Table]]


def _floors(best: pa.Table | None, queries: int, threshold: float, top_n: int) -> np.ndarray:
    """The score of the last of each query's best, where it has that many already."""
    floors = np.full(queries, threshold)
    if best is not None:
        i, score = best["i"].to_numpy(), best["score"].to_numpy()
        last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == top_n - 1)
        floors[i[last]] = np.maximum(threshold, score[last])
    return floors


def _together(batches: Iterator[pa.RecordBatch], rows: int, size: int = 16 << 20) -> Iterator[pa.Table]:
    """The batches as tables of at least so many rows or bytes, but for the last."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _search(queries: DataFrame, candidates: DataFrame, searcher: Searcher, threshold: float, top_n: int, block: int, value_bytes: Column, at_once: int = 1) -> DataFrame:
    """(query, candidate, score, rank) for queries (query, value) and candidates (candidate, ord, value), of which a searcher
    is given at least ``at_once``, where there are as many."""
    queries = checkpointed(queries)
    kinds = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for df, n in ((queries, "query"), (candidates, "candidate"), (candidates, "ord")))
    size, rows = queries.agg(F.sum(value_bytes + 64), F.count("*")).first()

    def best_of(tables: Iterator[pa.Table], asked: pa.Table) -> pa.Table | None:
        find, best = searcher(asked, threshold, top_n), None
        for table in tables:
            found = find(table, _floors(best, asked.num_rows, threshold, top_n))
            best = _best(found if best is None else pa.concat_tables([best, found]), top_n)
        return best

    def named(best: pa.Table, asked: pa.Table) -> pa.Table:
        return best.select(["candidate", "ord", "score"]).add_column(0, "query", asked["query"].take(best["i"]).combine_chunks())

    if (size or 0) <= BROADCAST_BYTES:
        sent = queries.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            best = best_of(_together(batches, at_once), asked)
            if best is not None:
                yield from named(best, asked).to_batches()

        found = candidates.select("candidate", "ord", "value").mapInArrow(run, f"{kinds}, score double")
    else:
        candidates = checkpointed(candidates.select("candidate", "ord", "value"))
        nq, nv = (max(1, -(-n // block)) for n in (rows, candidates.count()))
        spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = queries.withColumn("qb", spread("query", nq)).withColumn("vb", every(nv))
        right = candidates.withColumn("vb", spread("ord", nv)).withColumn("qb", every(nq))

        def pair(asked: pa.Table, rest: pa.Table) -> pa.Table:
            empty = pa.table({"i": pa.array([], pa.int64()), "candidate": rest["candidate"].slice(0, 0), "ord": rest["ord"].slice(0, 0), "score": pa.array([], pa.float64())})
            best = best_of(iter([rest]), asked) if asked.num_rows and rest.num_rows else None
            return named(empty if best is None else best, asked)

        found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(pair, f"{kinds}, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "ord")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).select("query", "candidate", "score", "rank")


def _matrix(column: pa.ChunkedArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of these rows, all of one length, and which rows they are; zero vectors are left out."""
    x = column.take(pa.array(at)).combine_chunks()
    m = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    n = np.sqrt((m * m).sum(1))
    some = np.flatnonzero(n > 0)
    return m[some] / n[some, None], at[some]


def _cosine(asked: pa.Table, threshold: float, top_n: int, rows: int = 512):
    sizes = pc.list_value_length(asked["value"]).to_numpy(zero_copy_only=False)
    by = {int(d): _matrix(asked["value"], np.flatnonzero(sizes == d)) for d in np.unique(sizes[sizes > 0])}

    def find(candidates: pa.Table, floors: np.ndarray) -> pa.Table:
        at, js, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        dims = pc.list_value_length(candidates["value"]).to_numpy(zero_copy_only=False)
        order = pc.sort_indices(candidates["ord"]).to_numpy().astype(np.int64)  # so of equal scores the first by ord stay
        for d, (q, of_query) in by.items():
            v, of_candidate = _matrix(candidates["value"], order[dims[order] == d])
            for lo in range(0, len(q) if len(v) else 0, rows):
                s = np.round(q[lo : lo + rows] @ v.T, 9)
                n = min(top_n, s.shape[1])
                least = np.maximum(np.partition(s, -n, 1)[:, -n], floors[of_query[lo : lo + rows]])
                i, j = np.nonzero(s >= least[:, None])
                best = np.lexsort((j, -s[i, j], i))
                i, j = i[best], j[best]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < top_n
                at.append(of_query[i[keep] + lo])
                js.append(of_candidate[j[keep]])
                scores.append(s[i[keep], j[keep]])
        rest = candidates.take(pa.array(np.concatenate(js)))
        return pa.table({"i": pa.array(np.concatenate(at)), "candidate": rest["candidate"], "ord": rest["ord"], "score": pa.array(np.concatenate(scores))})

    return find


def cosine_top(queries: DataFrame, vectors: DataFrame, threshold: float = 0.0, top_n: int = 1, block: int = 8192) -> DataFrame:
    """(query, candidate, score, rank) from (query, q_emb) and (candidate, emb, ord): the ``top_n`` vectors of the highest
    cosine, of at least ``threshold``. Cosines are rounded to 9 decimals, so equal ones tie, and ties go by ord.

    Null and zero vectors match nothing, nor do vectors of different lengths.
    """
    left = queries.where("q_emb is not null").select("query", F.col("q_emb").alias("value"))
    right = vectors.where("emb is not null").select("candidate", "ord", F.col("emb").alias("value"))
    return _search(left, right, _cosine, threshold, top_n, block, F.size("value") * 8)


def cosine_top_alike(queries: DataFrame, vectors: DataFrame, threshold: float = 0.0, top_n: int = 1) -> DataFrame:
    """As :func:`cosine_top`, for vectors many of which are equal: equal queries are searched once, and of equal vectors
    only the first ``top_n`` by ord are candidates, as no later one can be among the best."""
    first = vectors.withColumn("__k", F.row_number().over(Window.partitionBy("emb").orderBy("ord"))).where(F.col("__k") <= top_n).drop("__k")
    queries = checkpointed(queries.where("q_emb is not null"))
    named = queries.groupBy("q_emb").agg(F.min("query").alias("__named"))
    best = cosine_top(named.select(F.col("__named").alias("query"), "q_emb"), first, threshold, top_n).withColumnRenamed("query", "__named")
    return queries.join(named, "q_emb").select("query", "__named").join(best, "__named").select("query", "candidate", "score", "rank")


class Trie:
    """Sorted distinct strings as levels of their distinct prefixes: what strings begin with alike is worked on once.

    ``levels`` has, for each length of a prefix from 1 on, the place of each prefix's parent, its last letter's code, the
    least and greatest length of a string that begins with it, and the string that it is, or -1.
    """

    def __init__(self, strings: list[str]):
        of = Letters(strings)
        self.lengths, self.letters, codes = of.lengths, of.letters, of.inverse
        n = len(strings)
        above, open_ = np.zeros(n, np.int64), np.arange(n)
        self.levels: list[tuple[np.ndarray, ...]] = []
        for j in range(len(codes)):
            open_ = open_[self.lengths[open_] > j]
            parent, letter = above[open_], codes[j][open_]
            new = np.ones(len(open_), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
            first = np.flatnonzero(new)
            above[open_] = np.cumsum(new) - 1
            size = self.lengths[open_]
            ends = np.full(len(first), -1)
            done = size == j + 1
            ends[above[open_[done]]] = open_[done]
            self.levels.append((parent[first], letter[first], np.minimum.reduceat(size, first), np.maximum.reduceat(size, first), ends))

    def found(self, a: str, floor: float, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(strings, ratios) of those whose ratio to a is at least the floor. Prefixes that no string of such a ratio begins
        with are left; with a ``width`` only that many of the most promising of a level are followed, for a first look."""
        blocks = [a[i : i + 63] for i in range(0, len(a), 63)]
        masks = []
        for x in blocks:
            of: dict[int, int] = {}
            for i, c in enumerate(x):
                of[ord(c)] = of.get(ord(c), 0) | 1 << i
            masks.append(np.array([of.get(int(c), 0) if c else 0 for c in self.letters], np.uint64))
        state = [np.full(1, (1 << len(x)) - 1, np.uint64) for x in blocks]
        at, out, scores = np.zeros(1, np.int64), [np.zeros(0, np.int64)], [np.zeros(0)]
        for j, (parent, letter, least, most, ends) in enumerate(self.levels):
            lo, hi = np.searchsorted(parent, at), np.searchsorted(parent, at, "right")
            count = hi - lo
            here = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            if not len(here):
                break
            up, code = np.repeat(np.arange(len(at)), count), letter[here]
            carry, common, after = np.zeros(len(here), np.uint64), np.zeros(len(here), np.int64), []
            for k, x in enumerate(blocks):
                full, s = np.uint64((1 << len(x)) - 1), state[k][up]
                u = s & masks[k][code]
                added = s + u + carry
                carry = (added >> np.uint64(len(x))) & np.uint64(1)
                after.append(((added & full) | (s & ~u)) & full)
                common += len(x) - np.bitwise_count(after[k]).astype(np.int64)
            whole = ends[here] >= 0
            score = 200.0 * common[whole] / (len(a) + j + 1)
            good = score >= floor
            out.append(ends[here[whole]][good])
            scores.append(score[good])
            # the ratio that the rest of the letters could reach: it grows with the length until all of a is met
            bound = np.minimum(200.0 * (common + most[here] - j - 1) / (len(a) + most[here]), 200.0 * len(a) / (len(a) + least[here]))
            keep = np.flatnonzero((bound >= floor - 1e-9) & (most[here] > j + 1))
            if width is not None and len(keep) > width:
                keep = np.sort(keep[np.argpartition(-bound[keep], width)[:width]])
            at, state = here[keep], [s[keep] for s in after]
        return np.concatenate(out), np.concatenate(scores)


def _fuzzy(asked: pa.Table, threshold: float, top_n: int):
    targets = [t.lower() for t in asked["value"].to_pylist()]

    def find(candidates: pa.Table, floors: np.ndarray) -> pa.Table:
        names = candidates["value"].to_pylist()
        order = pc.sort_indices(candidates["ord"]).to_numpy().astype(np.int64)
        by: dict[str, list[int]] = {}
        for k in order.tolist():
            if len(same := by.setdefault(names[k], [])) < top_n:  # of the same name no more than the first by ord are of use
                same.append(k)
        empty = by.pop("", [])
        distinct = sorted(by)
        tries, lo = [], 0
        while lo < len(distinct):  # in matrices of a bounded size
            hi, longest = lo, 0
            while hi < len(distinct) and (hi == lo or (hi - lo + 1) * max(longest, len(distinct[hi])) <= CELLS):
                longest = max(longest, len(distinct[hi]))
                hi += 1
            tries.append((Trie(distinct[lo:hi]), distinct[lo:hi]))
            lo = hi
        at, js, scores = [], [], []
        for i, t in enumerate(targets):
            mine: list[tuple[float, int]] = [(s, k) for k in empty if (s := 0.0 if t else 100.0) >= floors[i]]
            for trie, some in tries:
                floor = max(floors[i], sorted((s for s, _ in mine), reverse=True)[top_n - 1] if len(mine) >= top_n else -np.inf)
                if floor <= threshold:  # nothing to measure by yet
                    first = np.sort(trie.found(t, floor, 4 * top_n)[1])[::-1]
                    floor = max(floor, first[top_n - 1]) if len(first) >= top_n else floor
                rows, s = trie.found(t, floor)
                if len(rows) > top_n:
                    last = np.partition(s, -top_n)[-top_n]
                    rows, s = rows[s >= last], s[s >= last]
                mine += [(x, k) for r, x in zip(rows.tolist(), s.tolist(), strict=True) for k in by[some[r]]]
            at += [i] * len(mine)
            js += [k for _, k in mine]
            scores += [x for x, _ in mine]
        rest = candidates.take(pa.array(js, pa.int64()))
        return pa.table({"i": pa.array(at, pa.int64()), "candidate": rest["candidate"], "ord": rest["ord"], "score": pa.array(scores, pa.float64())})

    return find


def fuzzy_top(targets: DataFrame, candidates: DataFrame, threshold: float = 0.0, top_n: int = 1, block: int = 8192) -> DataFrame:
    """(target, candidate, score, rank): the best candidates (candidate, ord) of each target, ties by ord.

    The target is lower-cased, the candidate isn't. Candidates are spread in order of their names, so those of a task
    begin alike: a common beginning is compared once, and left where no rest could reach the threshold or the best so far.
    """
    left = targets.select("target").where("target is not null").distinct().select(F.col("target").alias("query"), F.col("target").alias("value"))
    right = candidates.where("candidate is not null").select("candidate", "ord", F.col("candidate").alias("value"))
    right = right.repartitionByRange("value").sortWithinPartitions("value")
    return _search(left, right, _fuzzy, threshold, top_n, block, F.octet_length("value"), 1 << 17).withColumnRenamed("query", "target")


def _exact(results: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(qid, label, score): the last score of each label that is a name."""
    lasts = results.groupBy("qid", "label").agg(F.max_by("score", "ord").alias("score"))
    return lasts.join(names, keys, "left_semi")


def _rest(results: DataFrame, exact: DataFrame, compat: bool) -> DataFrame:
    hit = exact.select("qid", F.col("label").alias("__hit"))
    by = F.lower("label") if compat else F.col("label")
    return results.withColumn("__hit", by).join(hit, ["qid", "__hit"], "left_anti").select("qid", "label", "score", F.col("ord").alias("r_ord"))


def match_entities(results: DataFrame, nodes: DataFrame, spent: DataFrame | None = None, threshold: float = 0.0, compat: bool = False) -> DataFrame:
    """(qid, target, score) for scored labels (qid, label, score, ord) against all nodes (id) but a query's ``spent`` ones
    (qid, node); the rules are those of :func:`match_scores`.

    Labels that are nodes are found by an equi-join. The others, each once, are searched among all nodes for as many of
    the most alike as the query with the most spent nodes may have to skip, so no query meets the table of nodes.
    """
    names, depth = nodes.select(F.col("id").alias("label")), 1
    results = checkpointed(results.select("qid", "label", "score", "ord"))
    exact = _exact(results, names, ["label"])
    if spent is not None:
        spent = checkpointed(spent.select("qid", "node"))
        exact = exact.join(spent.withColumnRenamed("node", "label"), ["qid", "label"], "left_anti")
        depth += spent.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    exact = checkpointed(exact)
    rest = checkpointed(_rest(results, exact, compat))
    out = exact.select("qid", F.col("label").alias("target"), "score")
    if not rest.isEmpty():
        candidates = nodes.select(F.col("id").alias("candidate"), F.col("id").alias("ord"))
        like = fuzzy_top(rest.select(F.col("label").alias("target")), candidates, threshold, depth)
        near = rest.join(like.select(F.col("target").alias("label"), F.col("candidate").alias("node"), "rank"), "label")
        if spent is not None:
            near = near.join(spent, ["qid", "node"], "left_anti")
        out = out.unionByName(near.groupBy("qid", "label", "r_ord", "score").agg(F.min_by("node", "rank").alias("target")).select("qid", "target", "score"))
    return out.groupBy("qid", "target").agg(F.sum("score").alias("score"))


def match_scores(results: DataFrame, targets: DataFrame, threshold: float = 0.0, compat: bool = False) -> DataFrame:
    """(qid, target, score) for scored labels (qid, label, score, ord) and each query's own few targets (qid, target, ord).

    A label that is a target has its last score. Any other goes to the target most like it, on top of what that one
    has. A mixed-case exact label counts in the first way only; with ``compat`` it counts in both.
    """
    exact = _exact(results, targets.select("qid", F.col("target").alias("label")), ["qid", "label"])
    pairs = _rest(results, exact, compat).join(targets, "qid")
    scored = pairs.withColumn("like", fuzzy_ratio(F.lower("label"), F.col("target"))).where(F.col("like") >= threshold)
    best = scored.groupBy("qid", "label", "r_ord", "score").agg(F.min_by("target", F.struct(-F.col("like"), "ord")).alias("target"))
    return exact.select("qid", F.col("label").alias("target"), "score").unionByName(best.select("qid", "target", "score")).groupBy("qid", "target").agg(F.sum("score").alias("score"))
