"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows an Arrow batch holds on its way to a Python worker; with whole texts the default of 10,000 is too much memory.
ARROW_ROWS, ARROW_BYTES = 1000, 8_000_000
#: Share of all rows that makes a key frequent, there being fewer than its inverse of such keys, and the least rows that do.
FREQUENT, FLOOR = 1 / 2000, 1000
#: Edges that one task takes in a round of ``components``.
EDGES = 200_000


def bound(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; Arrow batches are kept small because texts can be long."""
    bound(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: the lineage ends and lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loam-"))
    return df.checkpoint(eager=True)


def released(run: Callable) -> Callable:
    """``run``, over Arrow batches or one group, handing freed memory back to the system at its end: Python workers are kept for later tasks."""

    def release() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    @functools.wraps(run)
    def batches(rows):
        try:
            yield from run(rows)
        finally:
            release()

    @functools.wraps(run)
    def group(rows):
        try:
            return run(rows)
        finally:
            release()

    return batches if inspect.isgeneratorfunction(run) else group


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, salts: int, name: str) -> DataFrame:
    """Gapless rank from 0 within ``keys``, without bringing a whole key into one task.

    Rows are ranked within (key, salt); counts of the salts, at most ``salts`` a key, give each salt its offset.
    ``df`` is read twice and should be cheap to read (a checkpoint).
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_within", F.row_number().over(within) - 1)
    return ranked.join(offsets, [*keys, "_salt"]).withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_salt", "_within", "_before")


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``facts`` on ``keys``; column ``n`` of ``facts``, one row a key, says how many rows have it.

    A key that makes up more than ``FREQUENT`` of all rows would be one task's in a shuffle; those are broadcast, being few.
    """
    facts = cut(facts)
    total = facts.agg(F.sum(n)).first()[0] or 0
    many = F.col(n) > max(FLOOR, int(total * FREQUENT))
    hot = rows.join(F.broadcast(facts.where(many)), keys)
    cold = rows.join(F.broadcast(facts.where(many).select(*keys)), keys, "left_anti").join(facts.where(~many), keys)
    return hot.unionByName(cold).drop(n)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u long, v long)`` as (id, component), component being the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each node hands its neighbours its least
    neighbour, so the edge set never grows and ends as stars around the least ids, after about log(n) rounds. All state
    stays distributed; the driver sees one count and one checksum a round, and the count sets the tasks of the next one, so that
    few edges aren't spread over many small files. Ids without an edge are not returned.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        tasks = -(-mark[0] // EDGES)
        ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        both = edges.coalesce(tasks).select(ends.alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(small_least, F.col("u") == F.col("w"))
        star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct()
        edges = cut(star)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
    return row.n, int(row.x or 0)
