"""Reliability signals from traces, and success rates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import scalars as S

#: The classes of tasks that a run analyses.
TASK_CLASSES = ("code_generation", "reasoning", "swarm", "quick", "documentation")


def union_traces(parts: list[DataFrame]) -> DataFrame:
    """Traces of all components; a component that lacks a column has nulls there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def signals(traces: DataFrame, by: tuple[str, ...] = ("task_class", "selector"), classes: tuple[str, ...] | None = None) -> DataFrame:
    """Failure rate, score, p99 latency, samples and components of each task class and selector.

    A missing selector is ``unknown``. p99 is element int(0.99 * n) of the sorted latencies (missing ones count as 0), as ``p99_of_many`` has it.
    """
    rows = traces.withColumn("selector", F.coalesce("selector", F.lit("unknown"))) if "selector" in by else traces
    rows = rows.where(F.col("task_class").isin(*classes)) if classes else rows
    failed = F.avg((F.coalesce("outcome", F.lit("")) == "error").cast("double"))
    found = rows.groupBy(*by).agg(failed.alias("failure_rate"), (1 - failed).alias("score"), F.count(F.lit(1)).alias("samples"), F.countDistinct(F.coalesce("component_name", F.lit(""))).alias("components"))
    late = _ranked(rows, by, 0.99).withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return found.join(late, same).select(*by, "failure_rate", "score", "p99_ms", "samples", "components")


def p99_of_many(traces: DataFrame, by: tuple[str, ...] = ("task_class", "selector"), q: float = 0.99) -> DataFrame:
    """The same p99 without gathering a group: counts by distinct latency, a running sum over those, and the first that passes the rank."""
    return _ranked(traces.withColumn("selector", F.coalesce("selector", F.lit("unknown"))) if "selector" in by else traces, by, q)


def _ranked(traces: DataFrame, by: tuple[str, ...], q: float) -> DataFrame:
    counts = traces.groupBy(*by, F.coalesce("duration_ms", F.lit(0.0)).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    each = Window.partitionBy(*by)
    ranked = counts.withColumns({"upto": F.sum("c").over(each.orderBy("d")), "n": F.sum("c").over(each)})
    rank = F.least((F.col("n") * F.lit(q)).cast("long"), F.col("n") - 1)
    return ranked.where(F.col("upto") > rank).groupBy(*by).agg(F.min("d").alias("p99_ms"))


def summary(found: DataFrame) -> DataFrame:
    """Selectors of each task class."""
    return found.groupBy("task_class").agg(F.countDistinct("selector").alias("selectors"), F.sum("samples").alias("samples"))


def signal_keys(found: DataFrame) -> DataFrame:
    """With the key that a signal is stored under."""
    return found.withColumn("key", F.concat_ws("/", F.lit("routing_fitness"), S.key_part(F.col("task_class")), S.key_part(F.col("selector"))))


def success_rate(calls: DataFrame, by: str, ok: str = "ok") -> DataFrame:
    """Successes over calls, 0 without calls."""
    good = F.count_if(F.col(ok))
    return calls.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), good.alias("successes"), F.coalesce(F.try_divide(good, F.count(F.lit(1))), F.lit(0.0)).alias("success_rate"))


def query_traces(hot: DataFrame, system_id: str | None = None, start: str | None = None, end: str | None = None, task_class: str | None = None, limit: int = 100) -> DataFrame:
    """The newest rows of a system within a time range, both ends included, whose metadata has the task class, at its root or under attributes."""
    rows = hot if system_id is None else hot.where(F.col("system_id") == system_id)
    kind = hot.schema["timestamp"].dataType
    rows = rows if start is None else rows.where(F.col("timestamp") >= F.lit(start).cast(kind))
    rows = rows if end is None else rows.where(F.col("timestamp") <= F.lit(end).cast(kind))
    if task_class is not None:
        rows = rows.where((F.get_json_object("metadata", "$.task_class") == task_class) | (F.get_json_object("metadata", "$.attributes.task_class") == task_class))
    return rows.orderBy(F.col("timestamp").desc(), "conversation_id").limit(limit)
