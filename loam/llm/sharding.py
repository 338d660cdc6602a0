"""Sharding by longest-processing-time scheduling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, released, salted_rank, shuffle_width, table


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one ``size`` each shard gets from the least-loaded-first heap; updates ``loads``.

    Long runs are dealt in closed form up to the last whole level, which is what the heap would do, and by the heap from there.
    """
    got = [0] * len(loads)
    if count > 2 * len(loads):
        fill = lambda level: [max(0, -((x - level) // size)) for x in loads]
        low, high = min(loads), max(loads) + size * (count + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(fill(mid)) <= count else (low, mid)
        got = fill(low)
        for i, n in enumerate(got):
            loads[i] += n * size
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        x, i = heap[0]
        heapq.heapreplace(heap, (x + size, i))
        got[i] += 1
        loads[i] += size
    return got


def schedule(sizes: DataFrame, shards: int) -> DataFrame:
    """(size, shards, ends): from (size, n), the shards that the n groups of each size go to, largest size first.

    The groups of ranks below ends[0] go to shards[0], those below ends[1] to shards[1], and so on. One task does it: d
    distinct sizes add up to at least d * d / 2 bytes, so there are at most the square root of twice the bytes of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        rows = pa.Table.from_batches(got)
        size, n = rows["size"].to_numpy(), rows["n"].to_numpy()
        order, loads, out = np.argsort(-size, kind="stable"), [0] * shards, []
        for s, c in zip(size[order].tolist(), n[order].tolist()):
            dealt = [(i, k) for i, k in enumerate(deal(loads, s, c)) if k]
            out.append((s, [i for i, _ in dealt], np.cumsum([k for _, k in dealt]).tolist()))
            if len(out) == 5000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["size", "shards", "ends"])

    return sizes.coalesce(1).mapInArrow(released(run), "size long, shards array<int>, ends array<long>")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, crc, shard, slot): documents over ``shards`` shards of nearly equal bytes; rows of equal texts stay together.

    Size is the UTF-8 length (a null text: 0) plus ``overhead``. Groups of equal texts, the largest first, go to the least
    loaded shard. Groups of one size are interchangeable, so the heap runs over the histogram of group sizes, and a rank
    within its size tells each group its place: the heap's own result, with no task that sees every group.

    Each row with a null text is a group of its own, with crc 0. Repeated rows are equal texts. A group larger than
    a fair share still stays whole. An empty table gives none.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    own = F.concat_ws(":", F.lit("null"), F.col(id_col).cast("string"), F.monotonically_increasing_id().cast("string"))
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"), F.unhex(F.sha2(F.coalesce(text, own), 256)).alias("key"), text.isNull().alias("none")))
    salts = 4 * shuffle_width(spark)
    groups = cut(rows.groupBy("key", "none").agg(F.sum("size").alias("group_size")))
    sizes = groups.groupBy(F.col("group_size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    plan = cut(schedule(sizes, shards)).withColumnRenamed("size", "group_size")
    ranked = salted_rank(groups, ["group_size"], [F.col("key"), F.col("none")], F.xxhash64("key"), salts, "rank")
    place = F.element_at("shards", F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1)
    placed = ranked.join(plan, "group_size").select("key", "none", place.alias("shard"))
    dealt = cut(rows.join(placed, ["key", "none"]).select("id", "size", "crc", "shard"))
    order = [F.col("id"), F.col("crc"), F.col("size")]
    return salted_rank(dealt, ["shard"], order, F.xxhash64("id", "crc"), salts, "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard(table(spark, sf_dir, "documents"))
    return dealt.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
