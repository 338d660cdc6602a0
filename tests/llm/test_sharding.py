import heapq
import random
import zlib
from collections import defaultdict

from loam.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot long, size string"


def test_deal_equals_the_heap():
    r = random.Random(1)
    for _ in range(300):
        loads = [r.randrange(0, 200) for _ in range(r.randrange(1, 9))]
        size, count = r.randrange(1, 40), r.randrange(0, 120)
        heap = [(x, i) for i, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            x, i = heap[0]
            heapq.heapreplace(heap, (x + size, i))
        mine = list(loads)
        got = sharding.deal(mine, size, count)
        assert sum(got) == count and sorted(mine) == sorted(x for x, _ in heap)
        assert [a + size * n for a, n in zip(loads, got)] == mine


def check(rows, got, shards):
    want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.id, r.size, r.crc) for r in got) == want
    text = {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())): t for i, t in rows}
    slots, of, load = defaultdict(list), defaultdict(set), [0] * shards
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        if (t := text[r.id, r.size, r.crc]) is not None:
            of[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of.values())
    return load


def test_balance_and_groups(spark):
    r = random.Random(3)
    rows = [(i, "x" * r.randrange(0, 400) + str(r.randrange(30))) for i in range(600)]
    rows += [(1000 + i, "the same text") for i in range(100)] + [(2000 + i, None) for i in range(5)] + [(3000, ""), (3000, ""), (3001, "é" * 50)]
    df = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], SCHEMA).repartition(4)
    load = check(rows, sharding.shard(df, 7).collect(), 7)
    groups = defaultdict(int)
    for k, (i, t) in enumerate(rows):
        groups[t if t is not None else k] += len((t or "").encode()) + 16
    heap = [0] * 7
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert sorted(load) == sorted(heap)


def test_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []
