from collections import Counter

import pytest

import corpus_pipeline
from triplespark.llm import exact_dedup, mixing, near_dedup, packing, queries

from . import cases
from .test_classifiers import BAD, labelled
from .test_mixing_packing import brute_mix, brute_pack
from .test_near_dedup import brute as brute_near


@pytest.fixture()
def folder(spark, tmp_path):
    docs, labels = labelled(300)
    rows = docs + [(1000 + i, *r[1:]) for i, r in enumerate(cases.rows())] + [(2000, docs[1][1], "en", "s", 1), (2001, "you idiot moron scum you idiot moron scum", "en", "s", 1)]
    cases.table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def plain(r, columns):
    return tuple(r[c] for c in columns)


def test_run_equals_brute_force(spark, folder):
    """Truth is what was planted: toxic documents hold two of three words, copies and near copies are known pairs."""
    path, rows = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    clean = {r for r in rows if not any(f" {w} " in f" {r[1] or ''} " for w in BAD)}
    assert len(set(rows) - clean) == 75 + 1  # a quarter of the labelled ones, and one of the others
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [tuple(r) for r in corpus_pipeline.drop_toxic(spark, docs, path).collect()]
    assert len(clean ^ set(kept)) <= 0.02 * len(rows)  # a classifier errs; all that follows is held to the letter
    first = {}
    for r in sorted((r for r in kept if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        first.setdefault(r[1], r)
    kept = [r for r in kept if r[1] is None or r[0] is None] + list(first.values())
    gone = {i for i, _ in brute_near(kept, 0.5)[1]}
    kept = [r for r in kept if r[0] not in gone]
    mixed = Counter()
    for (i, source, _), n in brute_mix(kept, mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, mixing.SEED).items():
        mixed[i] += n
    texts = {}
    for r in kept:
        texts.setdefault(r[0], Counter())[r[1]] += 1
    final = []
    for i, of in texts.items():
        times, rest = divmod(mixed[i], sum(of.values()))
        assert not rest or i is None
        final += [(i, t, None, None, None) for t, n in of.items() for _ in range(n * times)]
    got = corpus_pipeline.run(spark, path).collect()
    shown = {(r["doc_id"], r["text_hash"], r["copy"], r["piece"], r["lane"], r["offset"], r["tokens"]) for r in got}
    assert len(shown) == len(got) and shown == brute_pack(final, packing.WINDOW, packing.LANE_TOKENS)


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    more = cases.table(spark, rows, clashing=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
        out = stage(spark, more, path)
        assert out.columns == more.columns
        known = Counter(plain(r, docs.columns) for r in more.collect())
        for r in out.collect():
            assert all(r[c] == i for i, c in enumerate(cases.CLASHING)) and known[plain(r, docs.columns)], name


def test_run_on_an_empty_table(spark, tmp_path):
    cases.table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "doc_id" in out.columns


def test_every_operator_is_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")}) == list(range(1, 11))
    assert "pipeline" in queries.QUERIES and set(queries.ORACLE) <= set(queries.QUERIES)
    assert exact_dedup and near_dedup and packing
