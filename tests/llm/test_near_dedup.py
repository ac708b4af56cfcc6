import random
import re

import numpy as np
import pyarrow as pa
import pytest

from triplespark.llm import components, near_dedup, scratch, textvec

from . import cases


def shingles(text):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", low)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows, threshold=0.7):
    sets = {}
    for i, t, *_ in rows:
        if i is not None and t is not None and shingles(t):
            sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a in sets for b in sets if a < b and any(len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b])]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return pairs, {(i, find(i)) for i in sets if find(i) != i}


def families(n=40, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(n):
        w = cases.words(80, 1000 + k).split()
        for _ in range(rng.randint(1, 6)):
            rows.append((len(rows), " ".join(w), "en", "s", 1))
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = cases.words(1, rng.random())
    return rows


def test_groups_against_brute_force(spark):
    rows = families()
    pairs, want = brute(rows)
    got = {tuple(r) for r in near_dedup.groups(spark, cases.table(spark, rows)).collect()}
    keep = dict(got)
    found = sum(keep.get(a, a) == keep.get(b, b) for a, b in pairs)
    assert found >= 0.97 * len(pairs)
    loose = brute(rows, 0.5)[1]  # the threshold in use: what is found is true, and nearly all of it is found
    root = dict(loose)
    assert all(a > b and root.get(a, a) == root.get(b, b) for a, b in got) and len(got) >= 0.99 * len(loose) and len(want) <= len(loose)


def test_near_copies_with_scattered_words_replaced(spark):
    rows = []
    for k in range(40):
        w = cases.words(100, 5000 + k).split()
        copy = list(w)
        for j in range(10, 90, 10 + k % 4):  # 6 to 8 words: an index of 0.60 to 0.65
            copy[j] = f"other{j}"
        rows += [(2 * k, " ".join(w), "en", "s", 1), (2 * k + 1, " ".join(copy), "en", "s", 1)]
    assert brute(rows)[1] == set()
    want = brute(rows, 0.5)[1]
    got = {tuple(r) for r in near_dedup.groups(spark, cases.table(spark, rows)).collect()}
    assert len(want) == 40 and got <= want and len(got) >= 38


def test_odd_rows(spark):
    docs = cases.table(spark, clashing=True)
    got = {tuple(r) for r in near_dedup.groups(spark, docs).collect()}
    assert got == brute(cases.rows())[1] == {(100, 0), (101, 0), (102, 1)}
    kept = near_dedup.near_dedup(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(cases.rows()) - 3
    empty = cases.table(spark, [])
    assert near_dedup.groups(spark, empty).count() == 0 and near_dedup.near_dedup(spark, empty).count() == 0


def test_posterior_bound():
    assert near_dedup.least_matches(24, 0.7, 0.01) <= 24 * 0.7
    for n in (24, 120):
        m = near_dedup.least_matches(n, 0.7, 0.01)
        grid = np.linspace(0, 1, 20001)
        def tail(k):
            p = grid**k * (1 - grid) ** (n - k)
            return p[grid >= 0.7].sum() / p.sum()
        assert tail(m) >= 0.009 and (m == 0 or tail(m - 1) < 0.011)


def test_word_hashes_follow_words():
    texts = ["The cat, the CAT", "", "…", "the", "a" * 70 + " the", None, "x1 the"]
    lut = textvec.byte_lut()
    for size in (4, 1 << 20):
        out = []
        for lo, hi, raw, offs in textvec.chunks(pa.array(texts), size):
            h, wo = textvec.words(raw, offs, lut)
            out += [h[wo[i] : wo[i + 1]].tolist() for i in range(hi - lo)]
        assert [len(x) for x in out] == [4, 0, 1, 1, 2, 0, 2]
        the = out[3][0]
        assert out[0][0] == out[0][2] == the == out[4][1] == out[6][1] and out[0][1] == out[0][3] != the


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame(edges, "a long, b long")
    got = {tuple(r) for r in components.components(df, scratch.Scratch(spark, "t"), "c").collect()}
    assert got == {(x, find(x)) for x in list(root)}
    assert components.components(df.limit(0), scratch.Scratch(spark, "t"), "c").count() == 0


def test_large_buckets_in_blocks_give_the_same_groups(spark):
    """Documents that share a passage but little else fill a few buckets; near copies of some of them are among them."""
    shared, rows = cases.words(60, 1), []
    for k in range(120):
        w = f"{shared} {cases.words(60, 100 + k)}".split()
        rows.append((2 * k, " ".join(w), "en", "s", 1))
        if k % 10 == 0:
            w[90] = "changed"
            rows.append((2 * k + 1, " ".join(w), "en", "s", 1))
    want = brute(rows, 0.5)[1]
    assert want == {(2 * k + 1, 2 * k) for k in range(0, 120, 10)}
    for listed, block in ((64, 1024), (2, 1024), (2, 8)):
        got = {tuple(r) for r in near_dedup.groups(spark, cases.table(spark, rows), listed=listed, block=block).collect()}
        assert got == want


def test_copies_of_the_same_words_need_no_pairs(spark):
    text = cases.words(40, 9)
    rows = [(i, text if i % 2 else text.upper(), "en", "s", 1) for i in range(3, 400)] + [(900, cases.words(40, 10), "en", "s", 1), (7, cases.words(40, 10), "en", "s", 1)]
    got = {tuple(r) for r in near_dedup.groups(spark, cases.table(spark, rows)).collect()}
    assert got == {(i, 3) for i in range(4, 400)} | {(900, 3)}  # document 7 has two versions, which join the two groups


def test_rounds_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(chain, scratch.Scratch(spark, "t"), "c", rounds=2)
    star = spark.createDataFrame([(0, i) for i in range(1, 500)] + [(i, i + 500) for i in range(1, 500)], "a long, b long")
    assert {r["comp"] for r in components.components(star, scratch.Scratch(spark, "t"), "c").collect()} == {0}
