import math
import random

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from triplespark.llm import importance, langid, quality_rules, textvec, toxicity

from . import cases

BAD = ["idiot", "moron", "scum"]


def labelled(n, seed=0):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        w = cases.words(rng.randint(20, 200), (seed, i).__hash__()).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(600)
    model = toxicity.train(spark, cases.table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held, truth = labelled(300, 1)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(spark, cases.table(spark, held, clashing=True), model).collect()}
    assert np.mean([got[i] == bool(t) for i, _, t in truth]) > 0.97


def test_toxicity_of_odd_rows_and_labels(spark):
    docs = cases.table(spark, clashing=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(spark, docs, none)
    assert out.columns == ["doc_id", "toxic_score", "toxic"] and out.count() == len(cases.rows()) and out.where("toxic").count() == 0
    odd = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, None, 0), (None, 1, 1), (2, 1, None), (3, 1, 7)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(spark, docs, odd).count() == len(cases.rows())
    assert toxicity.toxicity(spark, cases.table(spark, []), odd).count() == 0


def test_toxic_stage(spark, tmp_path):
    docs, labels = labelled(400)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = cases.table(spark, docs + [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "you idiot scum moron", "en", "s", 0)], clashing=True)
    kept = toxicity.non_toxic(spark, table, str(tmp_path))
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {9000, 9001} <= ids and None not in ids
    clean = {i for i, _, t in labels if not t}
    assert len(clean & ids) >= 0.98 * len(clean) and len(ids - clean) <= 6


def test_long_text_is_scored_whole():
    weights = np.zeros(1 << 20, np.float32)
    lut = textvec.byte_lut(keep_digits=False)
    raw, offs = textvec.buffers(pa.array([" idiot "]))
    h, _ = textvec.char_ngrams(raw, offs, 5, 20, lut)
    weights[h] = 1
    long = " " + cases.words(400_000, 5) + " idiot "
    assert len(long) > 1 << 20
    a, b = toxicity.score_texts(pa.array([long, " fine "]), weights, 0.0, 20, (5,))
    assert a >= len(set(h.tolist())) and b == 0


def test_codewords():
    for k in (2, 3, 4, 5, 6, 9, 20):
        code = langid.codewords(k)
        assert len(code) == k and min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= (2 ** (k - 2) if k <= 6 else 8)
        assert all(abs(c.sum()) < k for c in code.T)


LETTERS = {"en": "etaoinshrd", "de": "enirstadhu", "fr": "esaitnruéà", "es": "eaosrnidñó"}


def spoken(n, seed):
    return [(i, cases.words(40, (seed, i).__hash__(), LETTERS[lang]), lang, "s", 1) for i in range(n) for lang in [list(LETTERS)[i % 4]]]


def test_language_of_held_out_texts(spark):
    rows = spoken(400, 1) + [(1000 + i, t, None, s, n) for i, t, _, s, n in spoken(100, 2)]
    got = {r["doc_id"]: r for r in langid.language_id(spark, cases.table(spark, rows, clashing=True)).collect()}
    right = [got[1000 + i]["predicted"] == lang for i, _, lang, _, _ in spoken(100, 2)]
    assert np.mean(right) > 0.95
    assert np.mean([got[i]["ambiguous"] for i in got]) < 0.3


def test_language_of_odd_rows(spark):
    out = langid.language_id(spark, cases.table(spark, clashing=True)).collect()
    assert len(out) == len(cases.rows())
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["predicted"] is None and by[i]["ambiguous"] for i in (103, 105, 109))
    one = langid.language_id(spark, cases.table(spark, [(1, "abc def", "en", "s", 1), (2, "ghi", None, "s", 1), (3, "", "en", "s", 0)])).collect()
    assert {r["doc_id"]: r["predicted"] for r in one} == {1: "en", 2: "en", 3: None}
    assert langid.language_id(spark, cases.table(spark, [(1, "abc", None, "s", 1)])).first()["predicted"] is None
    assert langid.language_id(spark, cases.table(spark, [])).count() == 0


def test_nearest_codeword_and_gap():
    code = langid.codewords(4)
    weights = np.full(code.shape, 1 / code.shape[1])
    d = langid.distances(code.astype(float) * 5, code, weights)
    assert (d.argmin(1) == np.arange(4)).all()
    flipped = code.astype(float) * 5
    flipped[:, 0] *= -1
    assert (langid.distances(flipped, code, weights).argmin(1) == np.arange(4)).all()


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(40_000) < 0.7
    right, wrong, speaks = np.array([0.9, 0.8, 0.7, 0.85, 0.95]), np.array([0.8, 0.9, 0.75, 0.7, 0.6]), np.array([0.9, 0.5, 0.8, 0.6, 0.7])
    votes = np.where(good[:, None], np.where(rng.random((40_000, 5)) < right, 1, -1), np.where(rng.random((40_000, 5)) < wrong, -1, 1))
    votes = np.where(rng.random(votes.shape) < speaks, votes, 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, r, w = quality_rules.fit(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.03 and np.abs(r - right).max() < 0.05 and np.abs(w - wrong).max() < 0.06
    assert np.mean((quality_rules.posterior(votes, prior, r, w) > 0.5) == good) > 0.85


def brute_votes(t):
    import re

    t = t or ""
    n, solid = len(re.findall(r"[^ \t\n\r]+", t)), len(re.sub(r"[ \t\r\n]+", "", t))
    letters, upper = sum(c.isalpha() for c in t), sum(c.isupper() for c in t)
    symbols, lines = sum(c in "#$%&*|!<>{}[]~^=+@\\" for c in t), t.split("\n")
    vote = lambda bad, ok: -1 if bad else 1 if ok else 0
    mean, again = solid / max(n, 1), 1 - len(set(lines)) / len(lines)
    stop = len(re.findall(rf"(?<![^\W\d_])(?:{quality_rules.STOP})(?![^\W\d_])", t.lower())) / max(n, 1)
    return (
        vote(n < 5, n >= 20), vote(mean > 12 or mean < 2, 3 <= mean <= 9), vote(symbols / max(solid, 1) > 0.05, n > 0 and symbols / max(solid, 1) < 0.01),
        vote(upper / max(letters, 1) > 0.4, n > 0 and upper / max(letters, 1) < 0.15), vote(len(lines) >= 3 and again > 0.3, len(lines) >= 3 and again < 0.05),
        vote(n >= 20 and stop < 0.02, n >= 5 and stop > 0.08), vote(letters / max(solid, 1) < 0.7, letters / max(solid, 1) > 0.9),
    )


def test_quality_against_brute_force(spark):
    rows = cases.rows() + [(200, "The end of the line is near\n" * 9, "en", "s", 1), (201, "ALL IN CAPS!! AND!! MORE!!", "en", "s", 1), (202, "a | b | c | d | e", "en", "s", 1)]
    got = quality_rules.quality(spark, cases.table(spark, rows, clashing=True)).collect()
    names = [f"vote_{k}" for k in quality_rules.rules()]
    assert sorted(str((r["doc_id"], *[r[n] for n in names])) for r in got) == sorted(str((r[0], *brute_votes(r[1]))) for r in rows)
    votes = np.array([brute_votes(r[1]) for r in rows])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    want = quality_rules.posterior(np.array([[r[n] for n in names] for r in got]), *quality_rules.fit(patterns, counts.astype(float)))
    assert np.allclose([r["posterior"] for r in got], want, atol=1e-6)
    assert quality_rules.quality(spark, cases.table(spark, [])).count() == 0


def test_importance_against_brute_force(spark):
    rows = cases.rows()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 20)] + [(20, 0, 0), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.resample(spark, cases.table(spark, clashing=True), labels, fraction=0.5).collect()
    lut, table = textvec.byte_lut(), np.zeros((2, 1 << importance.BITS))
    grams = []
    for r in rows:
        raw, offs = textvec.buffers(pa.array([r[1]], pa.string()))
        bucket, _ = importance.ngram_buckets(raw, offs, importance.BITS, lut)
        grams.append(bucket)
        np.add.at(table[0], bucket, 1)
        if r[0] is not None and r[0] < 20:
            np.add.at(table[1], bucket, 1)
    ratio = importance.log_ratio(table[0], table[1])
    want = sorted((str(r[0]), round(float(ratio[b].sum()), 6) + 0.0) for r, b in zip(rows, grams, strict=True))
    assert sorted((str(r["doc_id"]), round(r["log_weight"], 6) + 0.0) for r in got) == want
    chosen = [r for r in got if r["selected"]]
    assert len(chosen) == -(-len(rows) // 2)
    assert min(r["score"] for r in chosen) >= max(r["score"] for r in got if not r["selected"])


def test_importance_samples_in_proportion(spark):
    docs = cases.table(spark, [(i, "good text here" if i % 2 else "bad words there", "en", "s", 1) for i in range(3000)])
    labels = spark.createDataFrame([(i, int(i % 20 == 0 or i % 2 == 1), 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    got = importance.resample(spark, docs, labels, fraction=0.2).collect()
    good = [r for r in got if r["selected"] and r["doc_id"] % 2]
    assert len(good) > 0.8 * 600
    none = importance.resample(spark, docs, labels.limit(0), fraction=0.2)
    assert none.where("log_weight = 0").count() == 3000 and none.where("selected").count() == 600
    assert importance.resample(spark, cases.table(spark, []), labels).count() == 0


def bucket(gram, bits):
    """The bucket of an n-gram, a byte at a time."""
    h = len(gram) * 0x9E3779B1 % 2**32
    for c in gram:
        h = (h ^ c) * 0x01000193 % 2**32
    h ^= h >> 15
    return h * 0x2C1B3C6D % 2**32 >> (32 - bits)


def grams(text, n):
    """Byte n-grams of letters with a space at either end of the text, those that have a space only at their own ends."""
    b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {text or ''} ".encode())
    for i in range(len(b) - n + 1):
        g = b[i : i + n]
        inner = 32 not in g[1:-1] if n > 2 else g != b"  "
        if inner and (n == 2 or g != b" " * n):
            yield g


def test_toxicity_against_brute_force(spark):
    docs, labels = labelled(80)
    rows = docs + [(1000 + i, *r[1:]) if r[0] is not None else r for i, r in enumerate(cases.rows()) if len(r[1] or "") < 5000]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(spark, cases.table(spark, rows), table, sizes=(4, 5), bits=16, features=500)
    count = {i: Counter(bucket(g, 16) for n in (4, 5) for g in grams(t, n)) for i, t, *_ in docs}
    toxic = {i: t for i, _, t in labels}
    p, n = Counter(), Counter()
    for i, c in count.items():
        n.update(c.keys())
        if toxic[i]:
            p.update(c.keys())
    npos, nneg = sum(toxic.values()), len(toxic) - sum(toxic.values())
    known = [k for k in n if p[k] >= 2 or n[k] >= 20]
    chosen = sorted(sorted(known, key=lambda k: (-abs(p[k] / npos - (n[k] - p[k]) / nneg), k))[:500])
    ratio = {k: math.log((p[k] + 1) / (npos + 2)) - math.log((n[k] - p[k] + 1) / (nneg + 2)) for k in chosen}
    assert set(np.flatnonzero(model.weights).tolist()) <= set(chosen)
    beta = {k: model.weights[k] / ratio[k] for k in chosen if ratio[k]}
    z = {i: model.intercept + sum(model.weights[k] * math.log2(1 + m) for k, m in c.items() if k in ratio) for i, c in count.items()}
    share = {i: 0.5 / (npos if toxic[i] else nneg) for i in z}
    slope = {i: share[i] * (1 / (1 + math.exp(-z[i])) - toxic[i]) for i in z}  # of the loss, which is least where its gradient is 0
    assert abs(sum(slope.values())) < 2e-3
    for k in beta:
        assert abs(sum(slope[i] * ratio[k] * math.log2(1 + count[i][k]) for i in z) + 1e-5 * beta[k]) < 5e-3
    got = {str((r["doc_id"], r["toxic"])): r["toxic_score"] for r in toxicity.score(spark, cases.table(spark, rows), model).collect()}
    for i, t, *_ in rows:
        want = model.intercept + sum(model.weights[k] * math.log2(1 + m) for k, m in Counter(bucket(g, 16) for n in (4, 5) for g in grams(t, n)).items())
        assert abs(got[str((i, bool(want > 0 and t)))] - want) < 1e-4


def test_language_against_brute_force(spark):
    rows = spoken(120, 1) + [(1000 + i, *r[1:]) if r[0] is not None else r for i, r in enumerate(cases.rows()) if len(r[1] or "") < 5000]
    docs = cases.table(spark, rows, clashing=True)
    languages, code, weights, w, b = langid.train(spark, docs)
    assert languages == sorted({r[2] for r in rows if r[2]}) and np.allclose(weights.sum(1), 1) and (code != np.roll(code, 1, 0)).any(1).all()
    got = {}
    for r in langid.language_id(spark, docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t, *_ in rows:
        c = Counter(bucket(g, 12) for n in (2, 3) for g in grams(t, n))
        c.update(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode() if chr(x).isalpha() or x >= 128)
        total, margin = sum(c.values()), [float(v) for v in b]
        for k, m in c.items():
            for s in range(len(b)):
                margin[s] += float(w[k, s]) * math.sqrt(m / total)
        d = [sum(weights[r][s] * math.log1p(math.exp(-code[r][s] * margin[s])) for s in range(len(b))) for r in range(len(languages))]
        best = sorted(d)
        mine = got[i].pop()
        if not total:
            assert mine["predicted"] is None and mine["ambiguous"] and mine["distance"] is None
            continue
        assert abs(mine["distance"] - best[0]) < 1e-3 and abs(mine["gap"] - (best[1] - best[0])) < 1e-3
        assert d[languages.index(mine["predicted"])] < best[0] + 1e-3 and (mine["ambiguous"] == (mine["gap"] < langid.GAP))


def test_many_values_of_lang(spark):
    rows = [(i, cases.words(20, i), f"l{i % 60}", "s", 1) for i in range(240)]
    model = langid.train(spark, cases.table(spark, rows), rows=120)
    assert len(model[0]) == 60 and model[1].shape[0] == 60  # two rows of each
    with pytest.raises(ValueError):
        langid.train(spark, cases.table(spark, rows), rows=59)
    far = langid.codewords(300)
    assert min((far[i] != far[j]).sum() for i in range(300) for j in range(i)) >= 12


def test_equal_distances_are_ambiguous():
    code = langid.codewords(3)
    d = langid.classify_texts(pa.array([" abc ", "  "]), ["a", "b", "c"], code, np.full(code.shape, 1 / code.shape[1]), np.zeros((4096, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), (1, 2, 3), 12, 0.25)
    assert d.to_pylist()[0] == {"predicted": "a", "distance": d[0]["distance"].as_py(), "gap": 0.0, "ambiguous": True} and d[1]["predicted"].as_py() is None


def slow_em(rows, rounds=500):
    """A document at a time: posteriors from accuracies, accuracies from posteriors."""
    k = len(rows[0])
    good = [(v.count(1) + 0.5) / (v.count(1) + v.count(-1) + 1) for v in rows]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(rows) + 2)
        right, wrong = [], []
        for j in range(k):
            yes, no = [g for g, v in zip(good, rows) if v[j] == 1], [g for g, v in zip(good, rows) if v[j] == -1]
            right.append(min(0.999, max(0.5, (sum(yes) + 0.8) / (sum(yes) + sum(no) + 1))))
            wrong.append(min(0.999, max(0.5, (sum(1 - g for g in no) + 0.8) / (sum(1 - g for g in yes + no) + 1))))
        last, good = good, []
        for v in rows:
            a = prior * math.prod(right[j] if v[j] == 1 else 1 - right[j] for j in range(k) if v[j])
            b = (1 - prior) * math.prod(wrong[j] if v[j] == -1 else 1 - wrong[j] for j in range(k) if v[j])
            good.append(a / (a + b))
        if max(abs(x - y) for x, y in zip(good, last)) < 1e-10:
            break
    return good


def test_posteriors_equal_an_em_by_hand(spark):
    rows = cases.rows() + [(300 + i, "THE END!! ### " * (i % 7), "en", "s", 1) for i in range(40)]
    got = {}
    for r in quality_rules.quality(spark, cases.table(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["posterior"], r["keep"]))
    for (i, *_), p in zip(rows, slow_em([brute_votes(r[1]) for r in rows]), strict=True):
        q, keep = min(got[i], key=lambda x: abs(x[0] - p))
        assert abs(p - q) < 1e-5 and keep == (q >= quality_rules.THRESHOLD)


def test_gumbel_scores_equal_those_by_hand(spark):
    import hashlib

    rows = [r for r in cases.rows() if r[0] is not None]
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = importance.resample(spark, cases.table(spark, rows, clashing=True), labels, fraction=0.3).collect()
    for r in got:
        u = int(hashlib.md5(f"{importance.SEED}|{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52 + 0.5 / 2**52
        assert abs(r["score"] - (r["log_weight"] - math.log(-math.log(u)))) < 1e-9
    order = sorted(got, key=lambda r: (-r["score"], r["doc_id"]))
    assert sorted(r["doc_id"] for r in got if r["selected"]) == sorted(r["doc_id"] for r in order[: math.ceil(0.3 * len(rows))])
    # word by word: the ratio of two tables of counts, by a hash of our own that has no collisions to share
    words = lambda t: [x for x in "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "")).split() if x]
    assert all(r["log_weight"] == 0 for r in got if not words(dict((i, t) for i, t, *_ in rows)[r["doc_id"]]))
