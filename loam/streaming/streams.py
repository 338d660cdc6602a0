"""Structured Streaming forms of the polling services.

Sources track what was read in their checkpoints, so polling, known ids and retries need no state of their own. Event time has a
watermark of ten minutes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loam.functions.scalars import upload_ids
from loam.schemas import SCHEMAS

WATERMARK = "10 minutes"


def upload_stream(spark: SparkSession, root: str, files: int = 100) -> DataFrame:
    """Conversations of uploads as they arrive under ``root``/<system>/<upload>/memories.json."""
    rows = spark.readStream.schema(SCHEMAS["memories"]).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "memories.json").option("maxFilesPerTrigger", files).json(root)
    return rows.select(upload_ids(F.col("_metadata.file_path")).alias("ids"), F.posexplode("conversations").alias("position", "c")).select("ids.*", "position", "c.*")


def code_graph_stream(spark: SparkSession, root: str) -> DataFrame:
    """Code graphs that land as JSON; each (repo_path, commit_hash) once within the watermark."""
    rows = spark.readStream.schema(SCHEMAS["code_graphs"]).json(root)
    return rows.withWatermark("ingested_at", WATERMARK).dropDuplicatesWithinWatermark(["repo_path", "commit_hash"])


def fitness_stream(traces: DataFrame, length: str = "60 minutes", slide: str = "1 minute") -> DataFrame:
    """Failure rate, score and samples of each task class and selector over the last hour, every minute; p99 is approximate on a stream."""
    failed = F.avg((F.coalesce("outcome", F.lit("")) == "error").cast("double"))
    grouped = traces.withWatermark("ts", WATERMARK).groupBy(F.window("ts", length, slide), "task_class", F.coalesce("selector", F.lit("unknown")).alias("selector"))
    return grouped.agg(failed.alias("failure_rate"), (1 - failed).alias("score"), F.percentile_approx("duration_ms", 0.99).alias("p99_ms"), F.count(F.lit(1)).alias("samples"))


def rollup_stream(points: DataFrame, bucket: str = "5 minutes") -> DataFrame:
    """avg, min, max and count of each bucket, metric and system, as buckets close."""
    grouped = points.withWatermark("timestamp", WATERMARK).groupBy(F.window("timestamp", bucket).alias("w"), "metric_name", "system_id")
    return grouped.agg(F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), "metric_name", "system_id", "avg_value", "min_value", "max_value", "n")


def alert_stream(alerts: DataFrame, minutes: int = 5) -> DataFrame:
    """Alerts that are sent: of equal (alert_type, pattern_data), none within ``minutes`` of event time after the last one sent.

    The state of a key is the time of its last sent alert; it goes when the watermark is twice the window past it.
    """
    gap = minutes * 60_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("timestamp", kind="stable")
        last = state.get[0] if state.exists else None
        sent = []
        for at in rows["timestamp"]:
            ms = int(at.timestamp() * 1000)
            sent.append(last is None or ms - last >= gap)
            last = ms if sent[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last + 2 * gap, state.getCurrentWatermarkMs() + 1))
        yield rows[sent][["alert_type", "severity", "message", "pattern_data", "timestamp"]]

    rows = alerts.withWatermark("timestamp", WATERMARK).select("alert_type", "severity", "message", "pattern_data", "timestamp")
    schema = "alert_type string, severity string, message string, pattern_data string, timestamp timestamp"
    return rows.groupBy("alert_type", "pattern_data").applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def deliver(stream: DataFrame, checkpoint: str, send: Callable[[DataFrame, int], None], failures: Callable[[DataFrame, int], None] | None = None, attempts: int = 3, every: str | None = "60 seconds") -> StreamingQuery:
    """Hand each micro-batch to ``send``; after ``attempts`` failures it goes to ``failures`` (a dead-letter sink), or the query fails."""

    def batch(df: DataFrame, epoch: int) -> None:
        for left in reversed(range(attempts)):
            try:
                return send(df, epoch)
            except Exception:
                if left:
                    continue
                if failures is None:
                    raise
                failures(df, epoch)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def aging_stream(hot: DataFrame, warm_path: str, checkpoint: str, as_of: str, days: int = 7) -> StreamingQuery:
    """Rows past the cutoff, in warm form, appended once; available data is taken and the query ends."""
    from loam.operators.tiering import to_warm

    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return to_warm(hot.where(F.col("timestamp") < cutoff)).writeStream.format("parquet").option("path", warm_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
