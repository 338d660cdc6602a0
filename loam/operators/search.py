"""Vector similarity search, ranking and merging of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import scalars as S

COLUMNS = ["system_id", "conversation_id", "content", "timestamp", "metadata", "similarity"]


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def present(df: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in df.columns and c != "similarity"]


def of_system(df: DataFrame, system_id: str | None, shards: int | None = None) -> DataFrame:
    """Rows of one system, or all; with ``shards``, the partition filter goes beside the system filter so that other shards aren't read."""
    if system_id is None:
        return df
    df = df.where(F.col("system_id") == system_id)
    return df.where(F.col("shard_id") == S.shard_id(F.lit(system_id), shards)) if shards else df


def search_similar(df: DataFrame, query: list[float], system_id: str | None = None, limit: int = 10, threshold: float = 0.7, shards: int | None = None) -> DataFrame:
    """The ``limit`` most similar rows by cosine, of those the ones at ``threshold`` or above.

    For a zero query the latest rows, similarity null, whatever the threshold. Zero and null vectors take no part otherwise.
    Ties go to the smaller conversation_id. Top-k is taken in each partition before rows move.
    """
    rows = of_system(df, system_id, shards)
    if all(abs(x) < 1e-10 for x in query):
        return rows.select(*present(df), F.lit(None).cast("double").alias("similarity")).orderBy(F.col("timestamp").desc(), "conversation_id").limit(limit)
    scored = rows.withColumn("similarity", S.cosine(F.col("embedding"), vector(query))).where("similarity is not null")
    top = scored.select(*present(df), "similarity").orderBy(F.col("similarity").desc(), "conversation_id").limit(limit)
    return top.where(F.col("similarity") >= threshold)


def search_distance(df: DataFrame, query: list[float], system_id: str | None = None, limit: int = 10, threshold: float | None = None) -> DataFrame:
    """The same by cosine distance, ``score``: smaller is nearer, and ``threshold`` bounds it by 1 - threshold."""
    scored = of_system(df, system_id).withColumn("score", 1 - S.cosine(F.col("embedding"), vector(query))).where("score is not null")
    top = scored.select(*present(df), "score").orderBy("score", "conversation_id").limit(limit)
    return top if threshold is None else top.where(F.col("score") <= 1 - threshold)


def search_shards(df: DataFrame, query: list[float], system_id: str | None = None, limit: int = 10, threshold: float = 0.7, shards: int = 256) -> DataFrame:
    """Per-shard top ``limit`` at ``threshold``, merged, the best of each conversation.

    Shards are partitions, and one query covers them all; the rank within a shard is a window group limit, so each task
    keeps at most ``limit`` rows of a shard.
    """
    rows = of_system(df, system_id)
    scored = rows.withColumn("shard", S.shard_id(F.col("system_id"), shards)).withColumn("similarity", S.cosine(F.col("embedding"), vector(query))).where("similarity is not null")
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.col("similarity").desc(), "conversation_id"))
    local = scored.withColumn("rank", rank).where((F.col("rank") <= limit) & (F.col("similarity") >= threshold)).select(*present(df), "shard", "similarity")
    return merge_results(local, limit, [F.col("shard")])


def merge_results(results: DataFrame, limit: int = 10, order: list[Column] | None = None) -> DataFrame:
    """The best row of each conversation over all result sets, the ``limit`` most similar of those.

    ``order`` decides between equal similarities (arrival order). Rows without an id or, among several, a similarity of null come last; without an id
    they are dropped.
    """
    order = order or []
    best = Window.partitionBy("conversation_id").orderBy(F.col("similarity").desc_nulls_last(), *order)
    kept = results.where("conversation_id is not null").withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")
    return kept.orderBy(F.col("similarity").desc_nulls_last(), *order, "conversation_id").limit(limit)


def rank_by_similarity(candidates: DataFrame, query: list[float], limit: int = 10, index: str = "index", vector_col: str = "embedding") -> DataFrame:
    """(index, score): candidates by inner product, not normalised, largest first; ties by index."""
    return candidates.select(F.col(index).alias("index"), S.dot(F.col(vector_col), vector(query)).alias("score")).orderBy(F.col("score").desc_nulls_last(), "index").limit(limit)


def get_by_id(df: DataFrame, conversation_id: str) -> DataFrame:
    return df.where(F.col("conversation_id") == conversation_id)
