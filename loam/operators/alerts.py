"""Threshold alerts, and their suppression within a window."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alert type -> (threshold, whether a value below it alerts, severity, message format, factor of the values shown).
RULES = {
    "high_latency": (1000.0, False, "warning", "High latency detected: %.2fms (threshold: %.2fms)", 1.0),
    "low_hit_rate": (0.5, True, "warning", "Low cache hit rate: %.1f%% (threshold: %.1f%%)", 100.0),
    "spike_in_errors": (10.0, False, "error", "Error rate spike: %.1fx (threshold: %.1fx)", 1.0),
    "anomaly_detected": (2.0, False, "warning", "Anomaly detected: %.2fσ (threshold: %.2fσ)", 1.0),
}


def _by_type(kind: Column, pick: int) -> Column:
    out = F.lit(None)
    for name, rule in RULES.items():
        out = F.when(kind == name, F.lit(rule[pick])).otherwise(out)
    return out


def check_thresholds(values: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Alerts of (alert_type, value, ...): over the threshold of their type, or under it for low hit rates; unknown types have none."""
    kind = F.col("alert_type")
    limit = _by_type(kind, 0)
    for name, x in (thresholds or {}).items():
        limit = F.when(kind == name, F.lit(float(x))).otherwise(limit)
    rows = values.withColumn("threshold", limit.cast("double")).withColumn("below", _by_type(kind, 1).cast("boolean"))
    hit = F.when(F.col("below"), F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    message = F.lit(None).cast("string")
    for name, rule in RULES.items():
        message = F.when(kind == name, F.format_string(rule[3], F.col("value") * rule[4], F.col("threshold") * rule[4])).otherwise(message)
    return rows.where(hit).withColumns({"severity": _by_type(kind, 2).cast("string"), "message": message}).drop("below")


def pattern_key(alert_type: Column, pattern: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", alert_type, pattern), 256)


def suppress(alerts: DataFrame, minutes: int = 5) -> DataFrame:
    """Alerts that are sent: the first of each (alert_type, pattern_data), and then each that comes ``minutes`` or more after the last one sent.

    Suppressed ones don't prolong the wait, so it is a fold over a key's alerts in order of event time: one pass over sorted rows,
    which holds the time last sent and nothing else. Alerts without a time aren't sent.
    """
    gap, keys = minutes * 60_000_000, ["alert_type", "pattern_data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sent = None, None
        for b in batches:
            *names, times = (b.column(c).to_pylist() for c in (*keys, "_t"))
            keep = []
            for name, t in zip(zip(*names), times):
                if name != at:
                    at, sent = name, None
                new = t is not None and (sent is None or t - sent >= gap)
                keep.append(new)
                sent = t if new else sent
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = alerts.withColumn("_t", F.unix_micros(F.col("timestamp").cast("timestamp"))).repartition(*keys).sortWithinPartitions(*keys, "_t", "seq")
    return rows.mapInArrow(run, rows.schema).drop("_t")
