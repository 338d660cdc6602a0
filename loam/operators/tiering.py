"""Hot, warm and cold tiers: what moves when, and in which form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions import scalars as S

#: Bytes that a migrated row is taken to free.
ROW_BYTES = 2500


def older_than(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows from before the cutoff, oldest first."""
    cutoff = F.lit(as_of).cast(df.schema["timestamp"].dataType) - F.make_dt_interval(F.lit(days))
    return df.where(F.col("timestamp") < cutoff).orderBy("timestamp")


def to_warm(hot: DataFrame, plain: bool = False) -> DataFrame:
    """Embeddings as signed bytes (``plain``: times 127, neither scaled nor capped), contents as three sentences."""
    v = F.col("embedding")
    return hot.select("system_id", "conversation_id", (S.quantise_plain(v) if plain else S.quantise(v)).alias("embedding"), S.summary(F.col("content")).alias("summary"), "timestamp", "metadata")


def to_cold(warm: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """A hash, one sentence and the day's metrics as JSON; ``metrics`` are (system_id, day, name, value)."""
    base = warm.select("system_id", "conversation_id", S.fingerprint(F.col("summary")).alias("fingerprint"), S.summary(F.col("summary"), 1).alias("ultra_summary"), "timestamp", F.to_date("timestamp").alias("day"))
    if metrics is None:
        return base.withColumn("daily_metrics", F.lit("{}")).drop("day")
    daily = metrics.groupBy("system_id", "day").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("daily_metrics"))
    return base.join(daily, ["system_id", "day"], "left").withColumn("daily_metrics", F.coalesce("daily_metrics", F.lit("{}"))).drop("day")


def cold_partitions(cold: DataFrame) -> DataFrame:
    """With the columns that the cold layout is partitioned by."""
    return cold.withColumns({"year": F.date_format("timestamp", "yyyy"), "month": F.date_format("timestamp", "MM"), "day": F.date_format("timestamp", "dd")})


def export_cold(cold: DataFrame, path: str) -> None:
    """Append Parquet under system/year/month/day; an empty batch is an error."""
    if cold.isEmpty():
        raise ValueError("nothing to export")
    cold_partitions(cold).write.mode("append").option("compression", "snappy").partitionBy("system_id", "year", "month", "day").parquet(path)


def migrate(hot: DataFrame, as_of: str, days: int = 7, warm: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining hot rows, rows for warm, statistics).

    Rows that warm already has, from a run that broke off between the two writes, aren't written again; a row without a key or time is an error row and stays.
    """
    cutoff = F.lit(as_of).cast(hot.schema["timestamp"].dataType) - F.make_dt_interval(F.lit(days))
    old = F.coalesce(F.col("timestamp") < cutoff, F.lit(False))
    moving = hot.where(old & F.col("conversation_id").isNotNull())
    stays = hot.where(~(old & F.col("conversation_id").isNotNull()))
    new = moving if warm is None else moving.join(warm.select("conversation_id"), "conversation_id", "left_anti")
    return stays, to_warm(new), migration_statistics(hot, as_of, days)


def migration_statistics(hot: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    cutoff = F.lit(as_of).cast(hot.schema["timestamp"].dataType) - F.make_dt_interval(F.lit(days))
    old = F.col("timestamp") < cutoff
    keyed = F.col("conversation_id").isNotNull()
    return hot.agg(F.count_if(old & keyed).alias("records_migrated"), F.count_if(old & ~keyed).alias("errors"), (F.count_if(old & keyed) * ROW_BYTES).alias("bytes_freed"), F.min(F.when(old & keyed, F.col("timestamp"))).alias("oldest"), F.max(F.when(old & keyed, F.col("timestamp"))).alias("newest"))


def without(df: DataFrame, keys: DataFrame, key: str = "conversation_id") -> DataFrame:
    """What remains after deleting ``keys``; Parquet has no delete, so the remainder is written anew."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def tier_counts(hot: DataFrame | None, warm: DataFrame | None, cold: DataFrame | None = None) -> DataFrame:
    """(tier, n), 0 for a tier that isn't there."""
    tiers = {"hot": hot, "warm": warm, "cold": cold}
    there = [t.select(F.lit(name).alias("tier")) for name, t in tiers.items() if t is not None]
    every = there[0]
    for t in there[1:]:
        every = every.unionByName(t)
    counts = every.agg(*[F.count_if(F.col("tier") == name).alias(name) for name in tiers])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("tier"), F.col(name).alias("n")) for name in tiers])).alias("t")).select("t.*")
