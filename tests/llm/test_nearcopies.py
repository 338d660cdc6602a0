import random

import corpus_pipeline
from loam.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def changed(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


def brute(rows, threshold=0.8):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def texts(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(25):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(30, 300))]
        rows += [" ".join(changed(r, base, r.randrange(len(base) // 20 + 1))) for _ in range(r.randrange(1, 7))]
    chain = [f"c{k}" for k in range(200)]
    for _ in range(30):
        rows.append(" ".join(chain))
        chain = changed(r, chain, 2)
    r.shuffle(rows)
    return list(enumerate(rows, 1))


def test_stage_equals_brute_force_jaccard(spark, monkeypatch):
    for seed, block in ((1, 500), (2, 4)):
        monkeypatch.setattr(nearcopies, "BLOCK", block)
        rows = texts(seed)
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(3)
        want = brute(rows)
        assert len(set(want.values())) < len(rows) - 40
        got = corpus_pipeline.distinct_documents(spark, docs, None).collect()
        assert sorted(r.doc_id for r in got) == sorted(set(want.values()))


def test_connect_finds_every_component():
    r = random.Random(3)
    for _ in range(50):
        rows = texts(r.random())[:60]
        one = nearcopies.Shingles(5)
        root = {i: i for i, _ in rows}
        for a, b in nearcopies.connect([one(t.encode()) for _, t in rows], 0.8):
            x, y = sorted((root[rows[a][0]], root[rows[b][0]]))
            root = {i: x if c == y else c for i, c in root.items()}
        assert root == brute(rows)


def test_odd_rows(spark):
    near = " ".join(f"w{k}" for k in range(100))
    rows = [(7, near), (3, near.upper()), (7, "another text of one and the same id"), (None, near), (4, None), (5, ""), (9, "two words"), (8, "two  words"), (6, near + " end")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    label = {}
    for r in nearcopies.classes(docs).collect():
        label.setdefault(r.label, []).append(r.id)
    assert sorted(map(sorted, label.values())) == [[3, 6, 7], [7], [8, 9]]
    assert nearcopies.classes(docs.limit(0)).collect() == []
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.distinct_documents(spark, docs, None).where("doc_id is not null").collect() if r.text)
    assert got == [(3, near.upper()), (7, "another text of one and the same id"), (8, "two  words")]
