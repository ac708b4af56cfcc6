import hashlib
from collections import Counter

import numpy as np
import pytest

from triplespark.llm import mixing, packing

from . import cases


def tokens(t):
    return len([w for w in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])


def brute_mix(rows, weights, default, seed):
    per = Counter()
    for _, t, _, s, _ in rows:
        per[s] += tokens(t)
    w = {s: float(weights.get(s, default)) for s, n in per.items() if n}
    rate = {s: w[s] / sum(w.values()) * sum(per.values()) / per[s] if per[s] else 1.0 for s in per}
    out = Counter()
    for i, _, _, s, _ in rows:
        u = int(hashlib.md5(f"{seed}|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        for k in range(int(rate[s]) + (u < rate[s] - int(rate[s]))):
            out[(i, s, k)] += 1
    return out


def test_mixture_equals_brute_force(spark):
    got = Counter(tuple(r) for r in mixing.mixture(spark, cases.table(spark, clashing=True)).collect())
    assert got == brute_mix(cases.rows(), mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, mixing.SEED)


def test_stage_keeps_columns_and_target_shares(spark):
    docs = cases.table(spark, [(i, cases.words(50, i), "en", "big" if i % 4 else "small", 1) for i in range(2000)], clashing=True)
    out = mixing.mix(docs, {"big": 1.0, "small": 1.0})
    assert out.columns == docs.columns
    share = {r[0]: r[1] for r in out.groupBy("source").count().collect()}
    assert abs(share["big"] / sum(share.values()) - 0.5) < 0.03
    assert mixing.mix(cases.table(spark, [])).count() == 0
    assert mixing.mix(docs, {}).count() > 0


def slow_pack(sizes, window):
    """The rule as stated: try each level and recount the sum of squares."""
    count, bins, where = Counter(), [], []
    for size in sizes:
        full, rest = divmod(size, window)
        where += [window] * full
        bins += [window] * full
        if rest:
            best = None
            for h in [0, *[x for x in range(1, window) if count[x]]]:
                if h + rest > window:
                    continue
                after = Counter(count)
                after[h] -= h > 0
                after[h + rest] += h + rest < window
                key = (sum(v * v for v in after.values()), -h)
                best = min(best, (key, h)) if best else (key, h)
            h = best[1]
            count[h] -= h > 0
            count[h + rest] += h + rest < window
            where.append(h)
    return where


@pytest.mark.parametrize("window,seed", [(7, 0), (16, 1), (50, 2)])
def test_levels_equal_the_rule(window, seed):
    sizes = np.random.default_rng(seed).integers(1, 2 * window + 2, 300)
    item, piece, which, offset, size = packing.pack_lane(sizes, window)
    want = slow_pack(sizes.tolist(), window)  # a level for each piece: ``window`` for one that fills a window of its own
    rest = sizes[item] % window
    last = (piece == sizes[item] // window) & (rest > 0)
    assert [o if x else window for o, x in zip(offset.tolist(), last)] == want
    assert size.tolist() == np.where(last, rest, window).tolist() and not offset[~last].any()
    assert [(i, p) for i, s in enumerate(sizes.tolist()) for p in range(-(-s // window))] == list(zip(item.tolist(), piece.tolist()))
    fill = Counter()
    for b, o, n in zip(which, offset, size):
        assert fill[b] == o
        fill[b] += n
        assert fill[b] <= window
    assert (np.bincount(item, size, len(sizes)) == sizes).all()


def brute_pack(rows, window, lane_tokens):
    """Every row placed by the slow rule, in lanes and in the order that the hashes give."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    many = Counter((i, t, tokens(t)) for i, t, *_ in rows if tokens(t))
    lanes = max(1, -(-sum(n * k for (_, _, n), k in many.items()) // lane_tokens))
    flat = [(i, t, n, k) for (i, t, n), c in many.items() for k in range(c)]
    df = spark.createDataFrame(flat, "doc_id long, text string, tokens long, copy long").withColumn("th", F.xxhash64("text"))
    keyed = df.withColumn("key", F.xxhash64("doc_id", "tokens", "th", "copy", F.lit(5))).collect()
    out, per = set(), {}
    for r in keyed:
        per.setdefault(r["key"] % lanes, []).append(r)
    for lane, items in per.items():
        items.sort(key=lambda r: (r["key"], r["doc_id"] is None, r["doc_id"] or 0, r["th"], r["copy"]))
        levels = iter(slow_pack([r["tokens"] for r in items], window))
        for r in items:
            full, rest = divmod(r["tokens"], window)
            for p in range(full + (rest > 0)):
                level = next(levels)
                out.add((r["doc_id"], r["th"], r["copy"], p, lane, 0 if p < full else level, window if p < full else rest))
    return out


def test_pack_of_a_table(spark):
    docs = cases.table(spark, clashing=True)
    rows = packing.pack(spark, docs, window=64, lane_tokens=500).collect()
    got = {(r["doc_id"], r["text_hash"], r["copy"], r["piece"], r["lane"], r["offset"], r["tokens"]) for r in rows}
    assert len(got) == len(rows) and got == brute_pack(cases.rows(), 64, 500)
    assert len({(r["doc_id"], r["text_hash"], r["copy"], r["piece"]) for r in rows}) == len(rows)
    spans = {}
    for r in rows:
        spans.setdefault((r["lane"], r["window"]), []).append((r["offset"], r["offset"] + r["tokens"]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:])) and s[-1][1] <= 64
    assert packing.pack(spark, cases.table(spark, [])).count() == 0
    assert packing.pack(spark, cases.table(spark, [(1, "", "en", "s", 0), (2, None, None, None, None)])).count() == 0


def test_large_ids_beside_a_null_and_versions_of_one_length(spark):
    big = (1 << 53) + 1
    rows = [(big, "a b", "en", "s", 1), (None, "a b", "en", "s", 1), (-(1 << 63), "c", "en", "s", 1), (1, "x y", "en", "s", 1), (1, "y x", "en", "s", 1), (1, "x", "en", "s", 1), (1, "x", "en", "s", 1)]
    got = packing.pack(spark, cases.table(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got) == {big: 1, None: 1, -(1 << 63): 1, 1: 4}
    assert len({(r["doc_id"], r["text_hash"], r["copy"]) for r in got}) == 7 and {r["copy"] for r in got} == {0, 1}
    with pytest.raises(TypeError):
        packing.pack(spark, cases.table(spark, rows).selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_many_copies_of_one_row(spark):
    from triplespark.llm import tables

    df = spark.createDataFrame([(1, 25), (2, 3), (3, 0), (4, 10)], "a long, n long")
    for spread in (False, True):
        got = [tuple(r) for r in tables.repeated(df, "n", "k", spread, chunk=10).collect()]
        assert sorted(got) == [(1, k) for k in range(25)] + [(2, k) for k in range(3)] + [(4, k) for k in range(10)]
    tiny = cases.table(spark, [(0, "w", "en", "tiny", 1)] + [(i, cases.words(900, i), "en", "big", 1) for i in range(1, 300)])
    out = mixing.mix(tiny, {"tiny": 1.0, "big": 1.0}, copy="k")  # a rate of about 135,000, over the chunk
    n = out.where("source = 'tiny'")
    assert n.count() == n.select("k").distinct().count() == n.agg({"k": "max"}).first()[0] + 1 > tables.CHUNK_COPIES
