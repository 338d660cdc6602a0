"""The canonical tables, made from the given ones, as DataFrames and as SQL of the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("metric_name"), F.concat(F.lit("system-"), (F.col("user_id") % 10).cast("string")).alias("system_id"), F.col("ts").alias("timestamp"), "value", F.col("event_id").alias("seq"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*[F.lit(x) for x in ("code_generation", "reasoning", "swarm", "quick", "documentation", "other")])
    return e.select(F.element_at(names, (k % 6 + 1).cast("int")).alias("task_class"), F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string"))).alias("selector"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"), F.col("value").alias("duration_ms"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("component_name"), "ts", F.col("event_id").alias("seq"))


def hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("doc_id").cast("int") % 60, F.lit(0), F.col("doc_id").cast("int") % 1440)
    root = F.to_json(F.struct(F.col("lang").alias("task_class")))
    nested = F.to_json(F.struct(F.struct(F.col("lang").alias("task_class")).alias("attributes")))
    return d.select(F.col("source").alias("system_id"), F.col("doc_id").alias("conversation_id"), F.col("text").alias("content"), at.alias("timestamp"), F.when(F.col("doc_id") % 2 == 0, root).otherwise(nested).alias("metadata"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("vec_id").cast("int"))
    return e.select(F.concat(F.lit("system-"), F.col("label").cast("string")).alias("system_id"), F.col("vec_id").alias("conversation_id"), "embedding", at.alias("timestamp"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the least id."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations for entity extraction; some have an empty user or no project."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("system_id"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang")).alias("user_id"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("p"), (F.col("doc_id") % 20).cast("string"))).alias("project"), F.col("doc_id").alias("seq"))


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): customers and suppliers in nations in regions."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    e = lambda df, a, ak, b, bk, kind, base: df.select(name(a, ak).alias("source_id"), name(b, bk).alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"), (F.col(ak) + base).cast("long").alias("seq"))
    edges = e(customer, "customer", "c_custkey", "nation", "c_nationkey", "lives_in", 0).unionByName(e(supplier, "supplier", "s_suppkey", "nation", "s_nationkey", "based_in", 10**9)).unionByName(e(nation, "nation", "n_nationkey", "region", "n_regionkey", "part_of", 2 * 10**9))
    v = lambda df, kind, key: df.select(name(kind, key).alias("entity_id"), F.lit(kind).alias("entity_type"))
    entities = v(customer, "customer", "c_custkey").unionByName(v(supplier, "supplier", "s_suppkey")).unionByName(v(nation, "nation", "n_nationkey")).unionByName(v(table(spark, sf_dir, "region"), "region", "r_regionkey"))
    return entities, edges


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    types = F.array(F.lit("import"), F.lit("call"), F.lit("function"), F.lit("class"), F.lit(None).cast("string"))
    return p.select(F.col("p_brand").alias("repo_path"), F.concat(F.lit("c"), (key % 2).cast("string")).alias("commit_hash"), F.lpad(key.cast("string"), 12, "0").alias("node_id"), F.element_at(types, (key % 5 + 1).cast("int")).alias("type"), F.regexp_replace("p_name", " ", ".").alias("name"), F.when(F.col("p_size") <= 40, F.concat(F.lit("src/"), F.col("p_size").cast("string"), F.lit(".py"))).alias("file_path"), F.concat(F.lit("def "), F.col("p_name"), F.lit("(): pass")).alias("source"), F.col("p_size").alias("start_line"), F.array(F.struct(F.element_at(F.array(F.lit("ERROR"), F.lit("WARNING"), F.lit("INFO"), F.lit(None).cast("string")), (key % 4 + 1).cast("int")).alias("severity"), F.col("p_name").alias("message"), F.lit(None).cast("string").alias("category"))).alias("problems"))


def code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("repo_path"), F.concat(F.lit("c"), (F.col("p_partkey") % 2).cast("string")).alias("commit_hash"), F.lit("imports").alias("type"), F.concat(F.lit("m"), (F.col("p_partkey") % 12).cast("string")).alias("source"), F.concat(F.lit("m"), (F.col("p_size") % 12).cast("string")).alias("target"))


def code_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.substring("commit_hash", 2, 1).cast("int"))
    return code_nodes(spark, sf_dir).groupBy("repo_path", "commit_hash").agg(F.count(F.lit(1)).alias("nodes_count")).withColumn("ingested_at", at)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter of each event type: its running total of values, at the times of events; it starts anew every thousand events."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("era", F.floor(F.col("event_id") / 1000))
    total = F.sum(F.round("value", 2).cast("decimal(18,2)")).over(Window.partitionBy("event_type", "era").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.select(F.col("event_type").alias("name"), F.col("ts"), total.cast("double").alias("value"), F.col("event_id").alias("seq"))


SQL = {
    "metrics": "SELECT event_type AS metric_name, 'system-' || (user_id % 10) AS system_id, ts AS \"timestamp\", value, event_id AS seq FROM events",
    "traces": "SELECT CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 WHEN 0 THEN 'code_generation' WHEN 1 THEN 'reasoning' WHEN 2 THEN 'swarm' WHEN 3 THEN 'quick' WHEN 4 THEN 'documentation' ELSE 'other' END AS task_class, CASE WHEN user_id % 5 > 0 THEN 's' || (user_id % 5) END AS selector, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, value AS duration_ms, 'c' || (user_id % 3) AS component_name, ts, event_id AS seq FROM events",
    "hot": "SELECT source AS system_id, doc_id AS conversation_id, text AS content, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) + to_minutes(doc_id % 1440) AS \"timestamp\", lang FROM documents",
    "vectors": "SELECT 'system-' || label AS system_id, vec_id AS conversation_id, embedding::DOUBLE[] AS embedding, TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS \"timestamp\" FROM embeddings",
    "q": "SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1",
    "talks": "SELECT source AS system_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS user_id, CASE WHEN doc_id % 5 > 0 THEN 'p' || (doc_id % 20) END AS project, doc_id AS seq FROM documents",
    "vertices": "SELECT 'customer:' || c_custkey AS entity_id, 'customer' AS entity_type FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region' FROM region",
    "edges": "SELECT 'customer:' || c_custkey AS source_id, 'nation:' || c_nationkey AS target_id, 'lives_in' AS edge_type, CAST(c_custkey AS BIGINT) AS seq FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in', s_suppkey + 1000000000 FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of', n_nationkey + 2000000000 FROM nation",
    "nodes": "SELECT p_brand AS repo_path, 'c' || (p_partkey % 2) AS commit_hash, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS node_id, CASE p_partkey % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'call' WHEN 2 THEN 'function' WHEN 3 THEN 'class' END AS type, replace(p_name, ' ', '.') AS name, CASE WHEN p_size <= 40 THEN 'src/' || p_size || '.py' END AS file_path, 'def ' || p_name || '(): pass' AS source, p_size AS start_line, CASE p_partkey % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity, p_name AS message FROM part",
    "links": "SELECT p_brand AS repo_path, 'c' || (p_partkey % 2) AS commit_hash, 'm' || (p_partkey % 12) AS source, 'm' || (p_size % 12) AS target FROM part",
    "graphs": "SELECT p_brand AS repo_path, 'c' || (p_partkey % 2) AS commit_hash, count(*) AS nodes_count, TIMESTAMP '2024-01-01' + to_days(CAST(min(p_partkey % 2) AS INTEGER)) AS ingested_at FROM part GROUP BY ALL",
    "samples": "SELECT event_type AS name, ts, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) OVER (PARTITION BY event_type, event_id // 1000 ORDER BY event_id) AS DOUBLE) AS value, event_id AS seq FROM events",
}


def sql(tables: str, body: str) -> str:
    """``body`` over the named canonical tables; nodes' severities that are missing are INFO there."""
    given = [f"{t} AS ({SQL[t]})" for t in tables.split()]
    return f"WITH {', '.join(given)} {body}" if not body.startswith("WITH ") else f"WITH {', '.join([*given, body[5:]])}"
