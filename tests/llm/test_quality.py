import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loam.llm import quality

SCHEMA = "doc_id long, text string, quality string, toxic string, _bad string"


def test_label_model_recovers_rates():
    r = np.random.default_rng(1)
    n, truth = 20000, r.random(20000) < 0.2
    right = [(0.95, 0.6), (0.9, 0.8), (0.8, 0.9), (0.97, 0.4)]
    votes = np.stack([np.where(r.random(n) < 0.3, -1, np.where(truth, r.random(n) < b, r.random(n) > a).astype(int)) for a, b in right], axis=1)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, rates, post = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - 0.2) < 0.03
    for j, (good, bad) in enumerate(right):
        assert abs(rates[j, 0, 0] / rates[j, 0, :2].sum() - good) < 0.04
        assert abs(rates[j, 1, 1] / rates[j, 1, :2].sum() - bad) < 0.06
    assert ((post[which] > 0.5) == truth).mean() > 0.9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    rows = quality.classify(docs.join(labels, "doc_id").drop("quality", "toxic"), labels.where(part > 0)).join(labels.where(part == 0), "doc_id").select("quality", "toxic", "_bad", "_toxic", "_kept").collect()
    assert len(rows) > 800
    assert np.mean([(r._bad >= 0.6) == (r.quality == 0) for r in rows]) > 0.97
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic and r.quality]
    assert np.mean([not r._kept for r in toxic]) > 0.85
    assert np.mean([r._kept for r in clean]) > 0.98


def test_odd_rows(spark):
    good = "It was a fine day. We went out to see the sea, and came home late in the evening."
    rows = [(1, good, "a", "b", "c"), (1, good, "a", "b", "c"), (2, None, None, None, None), (3, "", "a", "b", "c"), (4, " \n", "a", "b", "c"), (None, good, "a", "b", "c"), (5, "word " * 300_000, "a", "b", "c")]
    df, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(df.withColumnsRenamed({"_bad": "bad"}), labels).collect()
    assert len(got) == len(rows) == quality.classify(df, labels).count()
    assert [r._kept for r in got if not (r.text or "").strip()] == [False] * 3
    assert all(r._bad is None for r in got if not (r.text or "").strip())
    assert quality.classify(df.drop("_bad").limit(0), labels).collect() == []


def test_labels_are_noisy_votes_and_votes_tell_elsewhere():
    patterns = np.array([[1, 1, 1], [0, 0, 0], [0, 0, 0], [1, 1, 1], [0, -1, 0]])
    gold = np.array([-1, -1, 0, 1, 1])
    _, rates, post = quality.expectation_maximisation(patterns, np.array([500.0, 3000.0, 300.0, 50.0, 2.0]), gold)
    assert len(rates) == 4 and np.allclose(rates[-1, :, 1], [quality.WRONG, 1 - quality.WRONG])
    assert post[0] > 0.9 and post[1] < 0.1
    assert ((0 < post) & (post < 1)).all() and post[2] < 0.01 and post[3] > 0.99


def test_scorers_learn_from_votes_on_unlabelled_rows(spark, monkeypatch):
    fits, real = [], quality.fit_linear
    monkeypatch.setattr(quality, "fit_linear", lambda rows, p, **k: fits.append((len(rows), p)) or real(rows, p, **k))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").join(docs, "doc_id").select("doc_id", "quality", "toxic")
    n = labels.count()
    quality.fit(docs, labels)
    assert len(fits) == 2 and all(rows > n and len(p) == rows for rows, p in fits)
    quality.fit(docs, labels, sample=20)
    assert [rows for rows, _ in fits[2:]] == [30, 30]
    before = [p.copy() for _, p in fits[:2]]
    real_votes = quality.quality_votes
    monkeypatch.setattr(quality, "quality_votes", lambda s, k: [-v if v == 0 else v for v in real_votes(s, k)][:2] + [-1] * 5)
    quality.fit(docs, labels)
    assert np.abs(fits[4][1] - before[0]).max() > 1e-3


def _naive_em(patterns, rounds=200):
    """{pattern: posterior}, the label last in each; loops, one pattern and labeller at a time."""
    wrong, light, labelled = quality.WRONG, quality.LIGHT, any(p[-1] >= 0 for p in patterns)
    size = len(next(iter(patterns))) - 1
    post = {}
    for p in patterns:
        given = [v for v in p[:-1] if v >= 0]
        post[p] = p[-1] if p[-1] >= 0 else (sum(given) + 0.02) / (len(given) + 0.2) if given else 0.1
    weight = {p: n * (light if labelled and p[-1] < 0 else 1) for p, n in patterns.items()}
    for _ in range(rounds):
        prior = (sum(weight[p] * post[p] for p in patterns) + 1) / (sum(weight.values()) + 10)
        rate = [[{v: x for v, x in zip((0, 1, -1), start)} for start in ((2, 0.5, 1), (0.5, 2, 1))] for _ in range(size)]
        for p in patterns:
            for j in range(size):
                rate[j][0][p[j]] += weight[p] * (1 - post[p])
                rate[j][1][p[j]] += weight[p] * post[p]
        new = {}
        for p in patterns:
            like = [1 - prior, prior]
            for c in (0, 1):
                for j in range(size):
                    like[c] *= rate[j][c][p[j]] / sum(rate[j][c].values())
                if p[-1] >= 0:
                    like[c] *= 1 - wrong if p[-1] == c else wrong
            new[p] = like[1] / sum(like)
        if max(abs(new[p] - post[p]) for p in patterns) < 1e-9:
            return new
        post = new
    return post


def _naive_scorer(rows, p, weights, epochs=4, rate=0.3, lasso=0.0015, ridge=0.1):
    """{feature: weight} and the intercept, one feature at a time."""
    z, n, w = {}, {}, {}
    share = min(max(sum(a * b for a, b in zip(p, weights)) / sum(weights), 1e-3), 1 - 1e-3)
    order, lasso = np.random.default_rng(0), max(1.0, lasso * sum(weights))
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            every = [*rows[k].tolist(), "bias"]
            guess = 1 / (1 + np.exp(-sum(w.get(i, 0) for i in every)))
            g = weights[k] * (guess - p[k]) * (p[k] / 2 / share + (1 - p[k]) / 2 / (1 - share))
            for i in every:
                z[i] = z.get(i, 0) + g - ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / rate * w.get(i, 0)
                n[i] = n.get(i, 0) + g * g
                off = 0 if i == "bias" else lasso
                w[i] = 0 if abs(z[i]) <= off else -(z[i] - np.sign(z[i]) * off) / ((1 + n[i] ** 0.5) / rate + ridge)
    return w


def test_equals_brute_force(spark):
    """The registered method on a small table against loops over patterns, labellers and features."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("doc_id % 3 > 0")
    docs = docs.unionByName(spark.createDataFrame([(None, "It was fine. We went home."), (10**6, None), (10**6 + 1, " ")], docs.schema)).repartition(3)
    rows, gold = [tuple(r) for r in docs.collect()], {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    features = quality.Features()
    sampled = []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (t or "").split()
        sampled.append((i, words, quality.shares(t or "", words), features(words, quality.shares(t or "", words))))
    starts, toxic = [sorted(quality.stems(w)) for _, w, _, _ in sampled], [gold.get(i, (-1, -1))[1] for i, *_ in sampled]
    of = lambda t, x: sum(x in s for s, y in zip(starts, toxic) if y == t)
    marks = {x for s in starts for x in s if x and of(1, x) >= 8 and of(0, x) <= 0.004 * of(1, x)}
    assert quality.mine(pa.array(starts), np.array(toxic))[0] == marks

    def pattern(task, i, words, s):
        q, x = gold.get(i, (-1, -1))
        return (*quality.quality_votes(s, len(words)), -1 if q < 0 else 1 - q) if task == "quality" else (*quality.toxic_votes(words, quality.stems(words), marks), x)

    want = {}
    for task in ("quality", "toxic"):
        counts = {}
        for i, t in rows:
            if words := (t or "").split():
                p = pattern(task, i, words, quality.shares(t, words))
                counts[p] = counts.get(p, 0) + 1
        post = _naive_em(counts)
        given = [pattern(task, i, words, s) for i, words, s, _ in sampled]
        prior = sum((quality.LIGHT if p[-1] < 0 else 1) * n * post[p] for p, n in counts.items()) + 1
        prior /= sum((quality.LIGHT if p[-1] < 0 else 1) * n for p, n in counts.items()) + 10
        w = _naive_scorer([f for *_, f in sampled], [post.get(p, prior) for p in given], [1 if p[-1] >= 0 else quality.LIGHT for p in given])
        for i, words, _, f in sampled:
            want.setdefault(i, []).append(None if not words else 1 / (1 + np.exp(-sum(w.get(x, 0) for x in [*f.tolist(), "bias"]))))
    got = {r.doc_id: (r._bad, r._toxic) for r in quality.classify(docs, labels).collect() if r.doc_id is not None}
    assert set(got) == set(want)
    for i, pair in got.items():
        for a, b in zip(pair, want[i]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-4), (i, pair, want[i])
