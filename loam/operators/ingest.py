"""Inserting memories: validation, hashing, keys, and what is reported back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import scalars as S

BATCH_LIMIT = 1000


def memory_metadata(metadata: Column) -> Column:
    """Normalised metadata as JSON: source, original_id, type, ingestion_method and, if given, correlation_id."""
    return F.to_json(F.struct(F.coalesce(metadata["source"], F.lit("unknown")).alias("source"), metadata["original_id"].alias("original_id"), F.coalesce(metadata["type"], F.lit("session_memory")).alias("type"), F.lit("http_push").alias("ingestion_method"), F.nullif(metadata["correlation_id"], F.lit("")).alias("correlation_id")), {"ignoreNullFields": "true"})


def prepare(memories: DataFrame, now: str, dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """(hot rows, rejects) of (memory_id, text, embedding, metadata).

    An id, a text and an embedding are required; a wrong length of the embedding is only marked. The system is the source in the
    metadata, the time its created_at or ``now``.
    """
    missing = F.array_compact(F.array(F.when(F.coalesce("memory_id", F.lit("")) == "", F.lit("memory_id")), F.when(F.coalesce("text", F.lit("")) == "", F.lit("text")), F.when(F.coalesce(F.size("embedding"), F.lit(0)) <= 0, F.lit("embedding"))))
    marked = memories.withColumn("errors", missing)
    meta = F.col("metadata")
    good = marked.where(F.size("errors") == 0).select(F.coalesce(meta["source"], F.lit("unknown")).alias("system_id"), F.col("memory_id").alias("conversation_id"), F.col("text").alias("content"), "embedding", F.coalesce(F.try_to_timestamp(meta["created_at"]), F.lit(now).cast("timestamp")).alias("timestamp"), memory_metadata(meta).alias("metadata"), S.content_hash(F.col("text")).alias("content_hash"), F.lit(now).cast("timestamp").alias("uploaded_at"), (F.size("embedding") != dim).alias("odd_dimension"))
    return good, marked.where(F.size("errors") > 0)


def insertable(new: DataFrame, existing: DataFrame, key: str = "conversation_id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows in conflict): keys that exist, or that come a second time among ``new``, are in conflict."""
    # rows of one key are told apart by their contents, so that both results see the same order
    ranked = new.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.to_json(F.struct(*new.columns)))))
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    marked = ranked.join(known, key, "left")
    clash = F.col("_known").isNotNull() | (F.col("_rank") > 1)
    return marked.where(~clash).drop("_rank", "_known"), marked.where(clash).drop("_rank", "_known")


def batch_status(stored: DataFrame, failed: DataFrame) -> DataFrame:
    """(status, stored_count, failed_count): completed without failures, failed without successes, else partial."""
    counts = stored.select(F.lit(1).alias("ok")).unionByName(failed.select(F.lit(0).alias("ok"))).agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("stored_count"), (F.count(F.lit(1)) - F.coalesce(F.sum("ok"), F.lit(0))).alias("failed_count"))
    return counts.select(F.when(F.col("failed_count") == 0, "completed").when(F.col("stored_count") == 0, "failed").otherwise("partial").alias("status"), "stored_count", "failed_count")


def from_uploads(conversations: DataFrame, now: str, dim: int = 384) -> DataFrame:
    """Hot rows of uploaded conversations (system_id, upload_id, position, id, content, embedding, timestamp, source, metadata).

    Empty contents are skipped; a missing id is upload_id and the number of the conversation among those kept, a missing embedding
    zeros; given metadata win over what the upload adds. Contents that occurred before in the batch are skipped, too.
    """
    kept = conversations.where(F.coalesce("content", F.lit("")) != "").withColumn("content_hash", S.content_hash(F.col("content")))
    each = Window.partitionBy("upload_id").orderBy("position")
    first = Window.partitionBy("content_hash").orderBy("upload_id", "position")
    fresh = kept.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").withColumn("_n", F.row_number().over(each) - 1)
    added = F.create_map(F.lit("upload_id"), F.col("upload_id"), F.lit("source"), F.coalesce("source", F.lit("unknown")), F.lit("content_hash"), F.col("content_hash"))
    zeros = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda _: F.lit(0.0).cast("float"))
    return fresh.select("system_id", F.coalesce("id", F.concat_ws("_", "upload_id", F.col("_n").cast("string"))).alias("conversation_id"), "content", F.coalesce("embedding", zeros).alias("embedding"), F.coalesce(F.try_to_timestamp("timestamp"), F.lit(now).cast("timestamp")).alias("timestamp"), F.to_json(S.merged(added, F.col("metadata"))).alias("metadata"), "content_hash", F.lit(now).cast("timestamp").alias("uploaded_at"))


#: The topics of events and the fields of their payloads.
TOPICS = {
    "pattern.detected": ("pattern_id", "pattern_type", "description", "confidence"),
    "anomaly.detected": ("anomaly_id", "anomaly_type", "severity", "description", "metrics"),
    "insight.generated": ("insight_id", "insight_type", "title", "description", "data"),
    "aggregation.completed": ("aggregation_id", "aggregation_type", "record_count", "summary"),
}
EVENT_VERSION = "1.0.0"


def events(rows: DataFrame, topic: str, source: str, now: str) -> DataFrame:
    """(topic, payload, headers) of rows that have the topic's fields; the id of an event is a hash of its payload."""
    payload = F.to_json(F.struct(*TOPICS[topic]))
    headers = F.create_map(F.lit("source"), F.lit(source), F.lit("event_id"), F.substring(F.sha2(payload, 256), 1, 32), F.lit("timestamp"), F.lit(now), F.lit("version"), F.lit(EVENT_VERSION))
    return rows.select(F.lit(topic).alias("topic"), payload.alias("payload"), headers.alias("headers"))
