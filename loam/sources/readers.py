"""Readers of uploads, tables and metric texts, and writers of the tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.scalars import upload_ids
from loam.schemas import SCHEMAS


def upload_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """(system_id, upload_id, path) of every manifest below ``root``/systems, by a listing that reads no file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").load(f"{root}/systems").select("path")
    return files.select(upload_ids(F.col("path")).alias("ids"), "path").select("ids.*", "path").where("upload_id is not null")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests with their system_id and upload_id; those that aren't JSON have nulls."""
    rows = spark.read.schema(SCHEMAS["manifest"]).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(f"{root}/systems")
    return rows.withColumn("ids", upload_ids(F.col("_metadata.file_path"))).select("ids.*", *rows.columns)


def memories(spark: SparkSession, root: str) -> DataFrame:
    """One row for each conversation of every memories.json, with system_id, upload_id and position; a file that isn't JSON has none."""
    rows = spark.read.schema(SCHEMAS["memories"]).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "memories.json").json(f"{root}/systems")
    return rows.select(upload_ids(F.col("_metadata.file_path")).alias("ids"), F.posexplode("conversations").alias("position", "c")).select("ids.*", "position", "c.*")


def hot_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["hot"]).parquet(path)


def series(spark: SparkSession, path: str, metric: str, entity: str, start: str) -> DataFrame:
    """Points of one series from ``start`` on; all three filters reach the scan."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("metric_name") == metric) & (F.col("entity_id") == entity) & (F.col("ts") >= start))


def traces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Traces of several components, whose files are lists, or objects that hold the list under traces, items or result."""
    kind = "array<struct<task_class: string, selector: string, outcome: string, duration_ms: double, component_name: string>>"
    out = None
    for path in paths:
        text = spark.read.option("wholetext", "true").text(path)
        listed = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), kind) for k in ("traces", "items", "result")], F.from_json("value", kind))
        rows = text.select(F.explode(listed).alias("t")).select("t.*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def metric_text(lines: DataFrame) -> DataFrame:
    """(name, labels, value) of lines of the Prometheus text format (column value); comments, empty and unreadable lines have none."""
    rows = lines.select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    labelled = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)\{(.*)\}\s*(\S+)"
    bare = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)\s+(\S+)"
    has = F.col("line").rlike(labelled)
    name = F.when(has, F.regexp_extract("line", labelled, 1)).otherwise(F.regexp_extract("line", bare, 1))
    number = F.when(has, F.regexp_extract("line", labelled, 3)).otherwise(F.regexp_extract("line", bare, 2))
    number = F.when(number == "+Inf", F.lit("Infinity")).when(number == "-Inf", F.lit("-Infinity")).otherwise(number)
    found = rows.select(name.alias("name"), F.when(has, F.regexp_extract("line", labelled, 2)).otherwise("").alias("labels"), number.try_cast("double").alias("value"))
    return found.where("name <> '' and value is not null")


def services(listed: DataFrame, fallback: DataFrame) -> DataFrame:
    """Known services, those of the listing first; one row for each name and url."""
    return listed.unionByName(fallback).dropDuplicates(["name", "url"])


def write_hot(df: DataFrame, path: str) -> None:
    """Append, by shard, ordered within files so that their statistics prune systems and times; a large shard is split by its bytes."""
    df.hint("rebalance", F.col("shard_id")).sortWithinPartitions("system_id", "timestamp").write.mode("append").partitionBy("shard_id").parquet(path)


def write_warm(df: DataFrame, path: str) -> None:
    """Append, by day, a large day being split by its bytes; an empty batch writes nothing."""
    if df.isEmpty():
        return
    df.withColumn("day", F.to_date("timestamp")).hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)
