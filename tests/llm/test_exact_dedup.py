import numpy as np
import pytest

from triplespark.llm import exact_dedup as e

from . import cases


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter_has_no_false_negative_and_few_false_positives(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, 2 * n + 2, np.uint64))
    inside, outside = keys[:n], rng.integers(1 << 63, (1 << 64) - 1, 20_000, np.uint64)
    made = e.build_filter(inside)
    assert e.may_contain(inside, *made).all()
    assert e.may_contain(outside, *made).mean() < 0.02
    if n >= 50_000:
        assert len(made[3]) < 1.4 * n


def brute(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None and t is not None:
            first[t] = min(first.get(t, i), i)
    return {(i, first[t]) for i, t, *_ in rows if i is not None and t is not None and first[t] != i}


@pytest.mark.parametrize("batches,shard", [(1, 1 << 17), (4, 8), (7, 3)])
def test_duplicates_equal_brute_force(spark, batches, shard):
    got = e.duplicates(spark, cases.table(spark, clashing=True), batches, shard).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(cases.rows())


def test_stage_keeps_one_row_a_text_and_all_columns(spark):
    docs = cases.table(spark, clashing=True)
    kept = e.exact_dedup(spark, docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [r["text"] for r in rows if r["text"] is not None and r["doc_id"] is not None]
    assert len(texts) == len(set(texts)) and set(texts) == {r[1] for r in cases.rows() if r[1] is not None and r[0] is not None}
    assert sum(r["text"] is None for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2
    assert all(r[c] == i for r in rows for i, c in enumerate(cases.CLASHING))


def test_empty(spark):
    docs = cases.table(spark, [])
    assert e.duplicates(spark, docs).count() == 0 and e.exact_dedup(spark, docs).count() == 0


def test_ids_over_all_64_bits_and_outliers(spark):
    rng = np.random.default_rng(1)
    ids = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 60)] + [-(1 << 63), (1 << 63) - 1]
    rows = [(i, f"text {k % 40}", "en", "s", 1) for k, i in enumerate(ids)]
    assert {tuple(r) for r in e.duplicates(spark, cases.table(spark, rows), 4, 8).collect()} == brute(rows)
    with pytest.raises(TypeError):
        e.duplicates(spark, cases.table(spark, rows).selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_a_later_batch_reads_the_stored_filters(spark, tmp_path):
    store = e.Snapshots(spark, f"file://{tmp_path}/store", 8)
    first = cases.table(spark, [(i, f"text {i % 25}", "en", "s", 1) for i in range(10, 40)])
    assert {tuple(r) for r in e.arrivals(spark, store, first).collect()} == {(i, i - 25) for i in range(35, 40)}
    (name,) = store.names()
    made = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / name).rglob("*.parquet")}
    again = e.Snapshots(spark, f"file://{tmp_path}/store", 1)  # opened anew: its shards are those of the filters
    rows = [(1, "text 3", "en", "s", 1), (2, "new", "en", "s", 1), (3, "new", "en", "s", 1), (4, None, "en", "s", 1), (5, "alone", "en", "s", 1), (None, "text 3", "en", "s", 1)]
    with pytest.raises(ValueError):
        e.arrivals(spark, again, cases.table(spark, rows))
    assert {tuple(r) for r in e.arrivals(spark, again, cases.table(spark, rows), first).collect()} == {(1, 28), (3, 2)}
    assert len(again.names()) == 2 and all(p.stat().st_mtime_ns == t for p, t in made.items())
    assert e.arrivals(spark, again, cases.table(spark, []), first).count() == 0


def test_texts_of_shared_digests_are_compared(spark):
    from triplespark.llm.scratch import Scratch

    scratch = Scratch(spark, "collide")
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "doc_id long, text string")
    keys = e.keys_of(docs)
    apart = e.verified(docs, keys, keys.select("digest").distinct(), scratch)
    assert {(r["doc_id"], r["keep_id"]) for r in apart.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
