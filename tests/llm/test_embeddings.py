import numpy as np
import pytest

from loam.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node long, dim string"


def brute(rows, cosine=0.93):
    fit = []
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, "f4").astype("f8")
            fit.append((k, label, x / np.linalg.norm(x)))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (k, lk, x) in enumerate(fit):
        for m, lm, y in fit[:a]:
            if lk == lm and len(x) == len(y) and x @ y >= cosine:
                links[k] += 1
                links[m] += 1
                root[find(k)] = find(m)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, links[k], least[find(k)], i == least[find(k)]) for k, (i, _, _) in enumerate(rows))


def clustered(seed, n, dim=64):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        center = r.normal(size=dim)
        for _ in range(r.integers(1, 8)):
            rows.append(center + r.normal(size=dim) * r.choice([0, 0.05, 0.2, 0.27]))
    return [(int(i), [float(x) for x in np.array(v, "f4")], int(i % 2)) for i, v in zip(r.permutation(len(rows)), rows)]


@pytest.mark.parametrize("block", [512, 8])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = clustered(1, 150)
    one = [1.0] + [0.0] * 63
    rows += [(9000 + k, one, 1) for k in range(30)] + [(9100, [x * 3 for x in one], 1), (9101, one, 0), (9102, one, None), (9103, None, 1), (9104, [], 1), (9105, [0.0] * 64, 1), (9106, [None] + one[1:], 1), (9107, [float("nan")] + one[1:], 1), (9108, [float("inf")] + one[1:], 1), (9109, [1.0, 2.0], 1), (9109, [1.0, 2.0], 1), (9110, [2.0], 1), (9111, [3.0], 1), (9112, [-3.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df).collect())
    assert got == brute(rows)


def test_recall_at_the_threshold(spark):
    r = np.random.default_rng(7)
    rows = []
    for k in range(400):
        v, u = r.normal(size=(2, 64))
        v /= np.linalg.norm(v)
        u -= u @ v * v
        u /= np.linalg.norm(u)
        rows += [(2 * k, v.tolist(), 0), (2 * k + 1, (0.931 * v + np.sqrt(1 - 0.931**2) * u).tolist(), 0)]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA)
    found = sum(x.n_links for x in embeddings.near_duplicates(df).collect()) / 2
    assert found >= 0.99 * 400


def test_a_row_without_an_id_links_others(spark):
    x, y = [1.0] + [0.0] * 63, [0.95] + [0.0] * 62 + [0.2]
    df = spark.createDataFrame([(4, x, 1, 1, "x"), (None, y, 1, 1, "x"), (7, y, 1, 1, "x"), (None, None, 1, 1, "x")], SCHEMA)
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect()), key=str) == [(4, 2, 4, True), (7, 2, 4, False), (None, 0, None, True), (None, 2, 4, False)]


def test_registered_query_links(spark, tmp_path):
    rows = clustered(3, 60)
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = embeddings.op2_embeddings(spark, str(tmp_path))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(map(tuple, found.collect()))
    assert got == brute(rows) and sum(n for _, n, _, _ in got) > 50


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
