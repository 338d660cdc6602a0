import hashlib
import random

import pytest

from loam.llm import substrings

SCHEMA = "doc_id long, text string, lang string, x long, anchors string"


def brute(rows, width):
    """(id, n_words, n_removed, sha) for each row, straight from the definition."""
    words = [(t or "").encode().split() for _, t in rows]
    starts = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if i is not None:
                starts[g] = min(starts.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and starts[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [r.choice(words) for _ in range(40)]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randrange(0, 60))]
        if i % 3 == 0:
            a = r.randrange(len(passage) - 15)
            w[r.randrange(len(w) + 1) : 0] = passage[a : a + r.randrange(5, 16)]
        if i % 7 == 0:
            w += ["same"] * r.randrange(5, 30)
        if i % 10 == 4:
            w = rows[r.randrange(len(rows))][1].split() + w[:3]
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 1, rows[3][1]), (n + 2, ""), (n + 3, None), (None, rows[6][1]), (n + 4, " ".join(passage)), (n + 4, " ".join(passage[3:]))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot,width", [(1, 512, 12), (2, 3, 12), (3, 0, 20), (4, 6, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, width):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "GROUP", 40)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "en", 1, "a") for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in substrings.dedup(df, width=width).collect()), key=str)
    assert got == brute(rows, width)
    assert any(r[2] for r in got)


def test_empty_table(spark):
    assert substrings.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text(spark):
    r = random.Random(5)
    long = " ".join(str(r.randrange(10**6)) for _ in range(150_000))
    rows = [(1, long[: len(long) // 2]), (2, long)]
    df = spark.createDataFrame([(i, t, "en", 1, "a") for i, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in substrings.dedup(df).collect())
    n = len(rows[0][1].split())
    assert got[0][2] == 0 and abs(got[1][2] - n) <= 1
