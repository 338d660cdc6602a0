import random

import numpy as np
import pytest
import xxhash

from loam.llm import common, simhash

SCHEMA = "doc_id long, text string, component string, fp string, rep long"


def plain(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(keys, linked):
    root = list(range(len(keys)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(keys):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(keys))]


def test_fingerprint(monkeypatch):
    texts = [None, "", " \n\t", "One", "one two", "Ünï ÄB a\xa0b c", "A b C d\x0be f\x0cg\rh  i\n\nj", "word " * 500]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) % (1 << 64) == plain(t)
    r = random.Random(1)
    long = " ".join(f"W{r.randrange(50)}" for _ in range(3000))
    monkeypatch.setattr(simhash, "BLOCK", 40)
    for t in [*texts, long]:
        assert simhash.fingerprint(None if t is None else t.encode()) % (1 << 64) == plain(t)


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(2)
    rows = []
    for i in range(150):
        rows.append((i * 3 % 151, " ".join(r.choice(["ab", "Cd", "ef", "gh"]) for _ in range(r.randrange(0, 5)))))
    base = [f"word{k}" for k in range(400)]
    for i in range(20):
        w = list(base)
        w[r.randrange(400)] = "other"
        rows.append((1000 + i, " ".join(w)))
    rows += [(None, "xx yy zz"), (2003, "p q"), (2003, "r s"), (2004, "R S")]
    rows += [(2000, None), (2001, ""), (None, "ab Cd ef"), (None, "quite alone here now"), (2002, " ".join(base)), (2002, " ".join(base))]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(3)
    got = {(x.id, x.fp % (1 << 64), x.component) for x in simhash.near_duplicates(df).collect()}
    fps = [plain(t) for _, t in rows]
    want = least_reachable([i for i, _ in rows], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == {(i, f, c) for (i, _), f, c in zip(rows, fps, want)}
    assert len({c for _, _, c in got}) < len(rows)


def test_many_meet_in_one_value(spark, monkeypatch):
    fps = [0] + [1 << b for b in range(64)] + [(1 << 20) | (1 << 21) | (1 << 22) | (1 << 23)]
    df = spark.createDataFrame([(i + 1, 0, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, x long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: df)
    got = {r.id: r.component for r in simhash.near_duplicates(df).collect()}
    want = least_reachable(list(range(1, len(fps) + 1)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert [got[k + 1] for k in range(len(fps))] == want


def test_a_row_without_an_id_links_others(spark, monkeypatch):
    df = spark.createDataFrame([(7, 0, 0), (None, 0, 1), (9, 0, 7)], "id long, x long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: df)
    assert {(r.fp, r.component) for r in simhash.near_duplicates(df).collect()} == {(0, 7), (1, 7), (7, 7)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    got = {x.id: x.component for x in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    linked = {frozenset(p) for p in pairs}
    assert got == dict(zip(nodes, least_reachable(nodes, lambda a, b: frozenset((nodes[a], nodes[b])) in linked)))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
