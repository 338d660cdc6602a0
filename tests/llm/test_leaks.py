import random
import re

import pytest

from loam.llm import leaks

SCHEMA = "doc_id long, text string, item_id long, id string"
ITEMS = "item_id long, text string, doc_id long"


def best(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@pytest.mark.parametrize("block", [8_000_000, 150])
def test_equals_brute_force(spark, block):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(200)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    items = [(k, " ".join(prose(r.randrange(8, 20)))) for k in range(25)] + [(90, None), (91, ""), (92, "Short"), (93, "ab é"), (94, "not, so; long"), (None, "a null id " * 5), (95, "Größe und Maß der ähnlichen Dinge, übrigens " * 3), (95, "Größe und Maß der ähnlichen Dinge, übrigens " * 3)]
    docs = []
    for i in range(60):
        w = prose(30)
        for _ in range(r.randrange(3)):
            passage = list(r.choice(items[:25])[1])
            for _ in range(r.randrange(9)):
                k = r.randrange(len(passage))
                passage[k : k + r.randrange(2)] = r.choice(["x", "", "yz"])
            text = "".join(passage)
            w.insert(r.randrange(len(w)), text.upper().replace(" ", "\n") if r.random() < 0.3 else text)
        docs.append((i, " ".join(w)))
    docs += [(800, "so short, it is not, so;\nlong"), (801, "shorts ab éab"), (802, "ab é"), (803, "xx a null id a nill id a null id a null id a null id"), (804, "größ und " + items[-1][1].upper().replace("MASS", "maß").replace("Ü", "uü"))]
    docs += [(805, "word " * 300_000 + items[3][1])]
    docs += [(700, None), (701, ""), (702, docs[0][1]), (702, docs[0][1]), (None, docs[1][1])]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA)
    bench = spark.createDataFrame([(*x, 1) for x in items], ITEMS)
    got = sorted(((x.id, x.item_id, x.distance) for x in leaks.matches(df, bench, block=block).collect()), key=str)
    want = []
    for i, text in docs:
        for k, item in dict.fromkeys(items):
            item, text = leaks.plain(item), leaks.plain(text)
            if 0 < len(item) < 24:
                if re.search(rf"(?<!\w){re.escape(item)}(?!\w)", text):
                    want.append((i, k, 0))
            elif item and len(text) < 10_000 and (d := best(item, text)) <= leaks.budget(len(item), 0.08):
                want.append((i, k, d))
            elif item and len(text) >= 10_000 and item in text:
                want.append((i, k, 0))
    assert got == sorted(want, key=str) and len(got) > 20
    assert {(800, 92), (800, 94), (802, 93), (803, None), (804, 95)} <= {x[:2] for x in got}
    kept = leaks.without_leaks(df, bench, block=block)
    leaking = {t for i, t in docs for x in got if x[0] == i and i not in (702, None)} | {t for i, t in docs if i in (702, None) and any(x[0] == i for x in got)}
    assert kept.columns == df.columns and sorted((str(r.doc_id), r.text) for r in kept.where("text is not null").collect()) == sorted((str(i), t) for i, t in docs if t is not None and t not in leaking)


def test_groups_cover_the_item():
    for n in range(1, 9):
        cuts = leaks.pieces("x" * 100, n - 1)
        groups = list(leaks.grouped(cuts))
        assert len(groups) == n and all(a <= start and start + len(p) <= z for (start, p), (a, z, _) in zip(cuts, groups))
        # fewer errors than pieces in each, so that the errors of the item can't exceed all of them
        assert sum(e + 1 for _, _, e in set(groups)) == n


def test_empty_tables(spark):
    empty, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a passage of some length, it is", 1)], ITEMS)
    assert leaks.matches(empty, bench).collect() == []
    assert leaks.matches(spark.createDataFrame([(1, "text", 1, "x")], SCHEMA), bench.limit(0)).collect() == []
