"""Queries by operator id, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import scalars as S
from loam.operators import alerts, codegraph, dedup, fitness, graph, ingest, monitoring, search, tiering, timeseries
from loam.operators.embedding import embed
from loam.plans import canonical as C
from loam.plans.canonical import AS_OF, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
START = "TIMESTAMP '2024-01-31' - INTERVAL 30 DAY"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def us(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# time series


@query(sql("metrics", f"WITH w AS (SELECT *, count(*) OVER s AS n, avg(value) OVER s AS m, stddev_pop(value) OVER s AS sd FROM metrics WHERE \"timestamp\" >= {START} WINDOW s AS (PARTITION BY metric_name, system_id)) SELECT metric_name, system_id, seq, value, round(abs((value - m) / sd), 6) AS z_score, round(value - m, 6) AS deviation FROM w WHERE n >= 10 AND sd > 0 AND abs((value - m) / sd) > 3"))
def a3_anomalies(spark, sf):
    found = timeseries.anomalies(C.metrics(spark, sf), AS_OF, 30)
    return six(found.select("metric_name", "system_id", "seq", "value", "z_score", "deviation"), "z_score", "deviation")


@query(sql("metrics", f"WITH w AS (SELECT *, count(*) OVER s AS n, avg(value) OVER s AS m, stddev_pop(value) OVER s AS sd FROM metrics WHERE \"timestamp\" >= {START} WINDOW s AS (PARTITION BY metric_name)), z AS (SELECT *, sd > 0 AND abs((value - m) / sd) > 2.5 AS hit FROM w WHERE n >= 10), r AS (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY metric_name ORDER BY seq) AS k FROM z) SELECT metric_name, count(*) AS total_points, count(*) FILTER (hit) AS anomaly_count, round(avg(CAST(hit AS DOUBLE)), 6) AS anomaly_rate, coalesce(string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (hit AND k <= 10), '') AS first_seqs FROM r GROUP BY 1"))
def a3_o8_anomaly_summary(spark, sf):
    found = six(timeseries.anomaly_summary(C.metrics(spark, sf), AS_OF, 30, 2.5), "anomaly_rate")
    return found.withColumn("first_seqs", F.array_join("first_seqs", ","))


@query(sql("metrics", f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY metric_name, system_id ORDER BY \"timestamp\", seq) - 1 AS x FROM metrics WHERE \"timestamp\" >= {START}), g AS (SELECT metric_name, system_id, count(*) AS n, regr_slope(value, x) AS slope, CASE WHEN var_pop(value) = 0 THEN 0 ELSE regr_r2(value, x) END AS r2, arg_min(value, x) AS a, arg_max(value, x) AS b FROM o GROUP BY 1, 2) SELECT metric_name, system_id, CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend_direction, round(r2, 6) AS trend_strength, round(CASE WHEN a = 0 THEN 0 ELSE (b - a) / a * 100 END, 4) AS percent_change, round(least(1.0, n / 100.0), 6) AS confidence, round(slope, 6) AS slope, n AS points FROM g WHERE n >= 2"))
def a2_trends(spark, sf):
    found = timeseries.trends(C.metrics(spark, sf), AS_OF, 30)
    return six(found, "trend_strength", "confidence", "slope").withColumn("percent_change", F.round("percent_change", 4)).drop("range_start", "range_end")


@query(sql("metrics", f"WITH w AS (SELECT *, count(*) OVER (PARTITION BY metric_name) AS total FROM metrics WHERE \"timestamp\" >= {START}), r AS (SELECT *, row_number() OVER (PARTITION BY metric_name, system_id ORDER BY seq DESC) AS p FROM w WHERE total >= 10), t AS (SELECT *, count(*) OVER (PARTITION BY metric_name, system_id) AS n FROM r WHERE p <= 100) SELECT a.metric_name, a.system_id AS system_1, b.system_id AS system_2, count(*) AS points, round(CASE WHEN count(*) < 5 OR stddev_pop(a.value) * stddev_pop(b.value) = 0 THEN 0 ELSE covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) END, 6) AS correlation FROM t a JOIN t b ON a.metric_name = b.metric_name AND a.p = b.p AND a.system_id < b.system_id WHERE a.n >= 5 AND b.n >= 5 GROUP BY 1, 2, 3"))
def a4_correlations(spark, sf):
    return six(timeseries.correlations(C.metrics(spark, sf), AS_OF, 30).drop("strength"), "correlation")


@query(sql("metrics", f"WITH h AS (SELECT metric_name, system_id, date_trunc('hour', \"timestamp\") AS p, avg(value) AS value FROM metrics WHERE \"timestamp\" >= {START} GROUP BY ALL), t AS (SELECT *, count(*) OVER (PARTITION BY metric_name, system_id) AS n FROM h) SELECT a.metric_name, a.system_id AS system_1, b.system_id AS system_2, count(*) AS points, round(CASE WHEN count(*) < 5 OR stddev_pop(a.value) * stddev_pop(b.value) = 0 THEN 0 ELSE covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) END, 6) AS correlation FROM t a JOIN t b ON a.metric_name = b.metric_name AND a.p = b.p AND a.system_id < b.system_id WHERE a.n >= 5 AND b.n >= 5 GROUP BY 1, 2, 3"))
def a4_hourly_correlations(spark, sf):
    return six(timeseries.correlations(C.metrics(spark, sf), AS_OF, 30, align="hour").drop("strength"), "correlation")


@query()
def a5_change_points(spark, sf):
    daily = C.metrics(spark, sf).groupBy("metric_name", F.col("system_id").alias("entity_id"), F.to_date("timestamp").cast("string").alias("ts")).agg(F.avg("value").alias("value"))
    return timeseries.change_points(daily, AS_OF, 31)


@query(sql("metrics", "SELECT metric_name, count(*) AS points, count(DISTINCT system_id) AS systems, epoch_us(min(\"timestamp\")) AS first_us, epoch_us(max(\"timestamp\")) AS last_us FROM metrics GROUP BY 1"))
def a6_g9_g11_catalog(spark, sf):
    return timeseries.catalog(C.metrics(spark, sf)).select("metric_name", "points", "systems", us("range_start").alias("first_us"), us("range_end").alias("last_us"))


@query("SELECT DISTINCT event_type AS metric_name FROM events")
def g10_metric_names(spark, sf):
    return timeseries.metric_names(C.metrics(spark, sf))


@query(sql("metrics", "SELECT metric_name, system_id, arg_min(value, seq) AS first_value, arg_max(value, seq) AS last_value FROM metrics GROUP BY 1, 2"))
def w2_first_last(spark, sf):
    return timeseries.first_last(C.metrics(spark, sf))


@query(sql("metrics", "WITH f AS (SELECT metric_name, system_id, arg_max(value, seq) - arg_min(value, seq) AS d FROM metrics GROUP BY 1, 2) SELECT metric_name, system_id, row_number() OVER (PARTITION BY metric_name ORDER BY abs(d) DESC, system_id) AS change_rank FROM f"))
def w4_change_rank(spark, sf):
    moved = timeseries.first_last(C.metrics(spark, sf)).withColumn("d", F.col("last_value") - F.col("first_value"))
    return timeseries.change_rank(moved, ("metric_name",), F.col("d"), ("system_id",)).select("metric_name", "system_id", "change_rank")


def _rollup_sql(bucket: str) -> str:
    return sql("metrics", f"SELECT epoch_us(time_bucket(INTERVAL {bucket}, \"timestamp\")) AS bucket_us, metric_name, system_id, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM metrics GROUP BY 1, 2, 3")


@query(_rollup_sql("'5 minutes'"))
def g18_rollup_5m(spark, sf):
    return six(timeseries.rollup(C.metrics(spark, sf)).withColumn("bucket_us", us("bucket")).drop("bucket"), "avg_value")


@query(_rollup_sql("'1 hour'"))
def g18_rollup_1h(spark, sf):
    return six(timeseries.rollup(C.metrics(spark, sf), "1 hour").withColumn("bucket_us", us("bucket")).drop("bucket"), "avg_value")


# vector search

COS = "list_cosine_similarity(embedding, q.v)"


@query(sql("vectors q", f"SELECT system_id, conversation_id, round({COS}, 6) AS similarity FROM vectors, q ORDER BY {COS} DESC, conversation_id LIMIT 10"))
def v2_search(spark, sf):
    found = search.search_similar(C.vectors(spark, sf), C.query_vector(spark, sf), threshold=-1.0)
    return six(found.select("system_id", "conversation_id", "similarity"), "similarity")


@query(sql("vectors q", f"SELECT * FROM (SELECT system_id, conversation_id, round({COS}, 6) AS similarity FROM vectors, q WHERE system_id = 'system-3' ORDER BY {COS} DESC, conversation_id LIMIT 50) WHERE similarity >= 0.2"))
def v2_search_of_system(spark, sf):
    found = search.search_similar(C.vectors(spark, sf), C.query_vector(spark, sf), "system-3", 50, 0.2)
    return six(found.select("system_id", "conversation_id", "similarity"), "similarity")


@query(sql("vectors", "SELECT conversation_id, system_id, CAST(NULL AS DOUBLE) AS similarity FROM vectors ORDER BY \"timestamp\" DESC, conversation_id LIMIT 10"))
def v3_zero_vector(spark, sf):
    return search.search_similar(C.vectors(spark, sf), [0.0] * 64).select("conversation_id", "system_id", "similarity")


@query(sql("vectors q", f"SELECT conversation_id, round(1 - {COS}, 6) AS score FROM vectors, q WHERE 1 - {COS} <= 0.75 ORDER BY 2, 1 LIMIT 20"))
def p4_s11_distance(spark, sf):
    return six(search.search_distance(C.vectors(spark, sf), C.query_vector(spark, sf), None, 20, 0.25).select("conversation_id", "score"), "score")


@query(sql("vectors q", f"WITH s AS (SELECT *, CAST('0x' || substr(sha256(system_id), 1, 8) AS BIGINT) % 16 AS shard, {COS} AS c FROM vectors, q), r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY c DESC, conversation_id) AS k FROM s) SELECT system_id, conversation_id, CAST(shard AS INTEGER) AS shard, round(c, 6) AS similarity FROM r WHERE k <= 10 AND c >= 0.1 ORDER BY c DESC, shard LIMIT 10"))
def v4_sharded_search(spark, sf):
    found = search.search_shards(C.vectors(spark, sf), C.query_vector(spark, sf), limit=10, threshold=0.1, shards=16)
    return six(found.select("system_id", "conversation_id", "shard", "similarity"), "similarity")


@query(sql("vectors q", "SELECT conversation_id AS \"index\", round(list_inner_product(embedding, q.v), 6) AS score FROM vectors, q ORDER BY list_inner_product(embedding, q.v) DESC, 1 LIMIT 25"))
def v5_o3_rank(spark, sf):
    return six(search.rank_by_similarity(C.vectors(spark, sf), C.query_vector(spark, sf), 25, "conversation_id"), "score")


@query(sql("vectors q", f"WITH sets AS (SELECT conversation_id % 100 AS conversation_id, {COS} AS s, conversation_id AS arrival FROM vectors, q), r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY s DESC, arrival) AS k FROM sets) SELECT conversation_id, round(s, 6) AS similarity, arrival FROM r WHERE k = 1 ORDER BY s DESC, arrival LIMIT 30"))
def g12_o4_u1_merge(spark, sf):
    rows = C.vectors(spark, sf).select((F.col("conversation_id") % 100).alias("conversation_id"), S.cosine(F.col("embedding"), search.vector(C.query_vector(spark, sf))).alias("similarity"), F.col("conversation_id").alias("arrival"))
    halves = rows.where("arrival % 2 = 0").unionByName(rows.where("arrival % 2 = 1"))
    return six(search.merge_results(halves, 30, [F.col("arrival")]), "similarity")


@query("SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x: CAST(trunc(greatest(least(x * (127.0::DOUBLE / list_max(list_transform(embedding::DOUBLE[], lambda y: abs(y)))), 126.0), -127.0)) AS INTEGER)))::BIGINT AS total, CAST(trunc(greatest(least(embedding[1]::DOUBLE * (127.0::DOUBLE / list_max(list_transform(embedding::DOUBLE[], lambda y: abs(y)))), 126.0), -127.0)) AS INTEGER) AS head FROM embeddings")
def v8_quantise(spark, sf):
    q = S.quantise(F.col("embedding"))
    return C.table(spark, sf, "embeddings").select("vec_id", q.alias("q")).select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.col("q")[0].cast("int").alias("head"))


@query("SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x: CAST(trunc(x * 127) AS INTEGER)))::BIGINT AS total FROM embeddings")
def v9_quantise_plain(spark, sf):
    return C.table(spark, sf, "embeddings").select("vec_id", F.aggregate(S.quantise_plain(F.col("embedding")), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: (x * 2) * (x * 2)))), 4) AS before, CAST(1.0 AS DOUBLE) AS after FROM embeddings")
def v11_normalise(spark, sf):
    e = C.table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x * 2))
    return e.select("vec_id", F.round(S.norm(F.col("v")), 4).alias("before"), F.round(S.norm(S.normalise(F.col("v"))), 4).alias("after"))


@query()
def v7_text_embedding(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", embed(F.col("text"), 64).alias("embedding"))


# scalar functions, validation, dedup


@query("SELECT doc_id, sha256(text) AS content_hash, lower(hex(unhex(sha256(text)))) AS fingerprint, CAST(CAST('0x' || substr(sha256(source), 1, 8) AS BIGINT) % 256 AS INTEGER) AS shard, printf('shard_%03d/%s.parquet', CAST('0x' || substr(sha256(source), 1, 8) AS BIGINT) % 256, source) AS shard_path FROM documents")
def f1_f4_hashes_and_shards(spark, sf):
    d = C.table(spark, sf, "documents")
    return d.select("doc_id", S.content_hash(F.col("text")).alias("content_hash"), F.lower(F.hex(S.fingerprint(F.col("text")))).alias("fingerprint"), S.shard_id(F.col("source")).alias("shard"), S.shard_path(F.col("source")).alias("shard_path"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:3], '. ') AS summary FROM documents")
def f6_summary(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", S.summary(F.col("text")).alias("summary"))


@query("SELECT p_partkey, coalesce(nullif(substr(regexp_replace(p_name || '/' || p_type, '[^a-zA-Z0-9_]', '_', 'g'), 1, 50), ''), 'unknown') AS key_part, string_split(replace(p_name, ' ', '.'), '.')[-1] AS last_part, greatest(0.0, least(1.0, p_retailprice / 1000.0)) AS clamped FROM part")
def f8_f12_f16_names(spark, sf):
    p = C.table(spark, sf, "part")
    return p.select("p_partkey", S.key_part(F.concat_ws("/", "p_name", "p_type")).alias("key_part"), S.last_part(F.regexp_replace("p_name", " ", ".")).alias("last_part"), S.clamp(F.col("p_retailprice") / 1000.0).alias("clamped"))


@query("SELECT event_id, epoch_us(date_trunc('hour', ts)) AS hour_us, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def f9_f10_truncate(spark, sf):
    return C.table(spark, sf, "events").select("event_id", us_of(F.date_trunc("hour", "ts")).alias("hour_us"), F.to_date("ts").cast("string").alias("day"))


def us_of(c):
    return F.unix_micros(c.cast("timestamp"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def j6_duplicate_groups(spark, sf):
    return dedup.groups(C.table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def j6_known_contents(spark, sf):
    d = C.table(spark, sf, "documents")
    return dedup.duplicates(d.where("doc_id % 2 = 1"), dedup.with_hash(d.where("doc_id % 2 = 0"), "text"), "text").select("doc_id")


@query()
def f19_find_similar(spark, sf):
    return dedup.find_similar(C.table(spark, sf, "documents"), "doc_id", "text")


@query(sql("hot", "WITH i AS (SELECT conversation_id, content, conversation_id % 10 > 2 AS fresh FROM hot) SELECT conversation_id, sha256(content) AS content_hash FROM i WHERE fresh"))
def k1_insert(spark, sf):
    hot = C.hot(spark, sf)
    good, _ = ingest.insertable(dedup.with_hash(hot), hot.where("conversation_id % 10 <= 2"))
    return good.select("conversation_id", "content_hash")


def _memories(spark, sf):
    d = C.table(spark, sf, "documents")
    meta = F.create_map(F.lit("source"), F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.lit("original_id"), F.col("doc_id").cast("string"))
    return d.select(F.when(F.col("doc_id") % 11 > 0, F.col("doc_id").cast("string")).alias("memory_id"), F.when(F.col("doc_id") % 13 > 0, F.col("text")).alias("text"), F.array(F.lit(0.5).cast("float")).alias("embedding"), meta.alias("metadata"))


@query("SELECT CASE WHEN doc_id % 3 > 0 THEN source ELSE 'unknown' END AS system_id, CAST(doc_id AS VARCHAR) AS conversation_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 11 > 0 AND doc_id % 13 > 0")
def k2_push(spark, sf):
    return ingest.prepare(_memories(spark, sf), AS_OF, 1)[0].select("system_id", "conversation_id", "content_hash")


@query("SELECT 'partial' AS status, count(*) FILTER (doc_id % 11 > 0 AND doc_id % 13 > 0) AS stored_count, count(*) FILTER (NOT (doc_id % 11 > 0 AND doc_id % 13 > 0)) AS failed_count FROM documents")
def k3_g14_batch_status(spark, sf):
    return ingest.batch_status(*ingest.prepare(_memories(spark, sf), AS_OF, 1))


@query("SELECT 'insight.generated' AS topic, count(*) AS n, count(DISTINCT doc_id) AS payloads FROM documents")
def k11_events(spark, sf):
    d = C.table(spark, sf, "documents").select(F.col("doc_id").alias("insight_id"), F.lit("text").alias("insight_type"), F.col("source").alias("title"), F.col("lang").alias("description"), F.col("n_chars").alias("data"))
    return ingest.events(d, "insight.generated", "loam", AS_OF).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("payload").alias("payloads"))


# tiers


@query(sql("hot", "SELECT conversation_id, system_id, epoch_us(\"timestamp\") AS at_us FROM hot WHERE \"timestamp\" < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"))
def s4_age_scan(spark, sf):
    return tiering.older_than(C.hot(spark, sf), AS_OF, 7).select("conversation_id", "system_id", us("timestamp").alias("at_us"))


@query(sql("hot", "SELECT count(*) AS records_migrated, CAST(0 AS BIGINT) AS errors, count(*) * 2500 AS bytes_freed FROM hot WHERE \"timestamp\" < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"))
def g13_st8_migration(spark, sf):
    return tiering.migration_statistics(C.hot(spark, sf), AS_OF).drop("oldest", "newest")


@query(sql("hot", "SELECT conversation_id FROM hot WHERE \"timestamp\" >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY"))
def k6_delete_migrated(spark, sf):
    hot = C.hot(spark, sf)
    return tiering.without(hot, tiering.older_than(hot, AS_OF, 7)).select("conversation_id")


@query(sql("hot", "SELECT system_id, strftime(\"timestamp\", '%Y') AS year, strftime(\"timestamp\", '%m') AS month, strftime(\"timestamp\", '%d') AS day, count(*) AS n FROM hot GROUP BY ALL"))
def k7_cold_partitions(spark, sf):
    return tiering.cold_partitions(C.hot(spark, sf)).groupBy("system_id", "year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


@query(sql("hot", "WITH s AS (SELECT *, array_to_string(list_filter(list_transform(string_split(content, '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:3], '. ') AS summary FROM hot) SELECT conversation_id, sha256(summary) AS fingerprint, coalesce(list_filter(list_transform(string_split(summary, '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], '') AS ultra_summary FROM s"))
def st9_warm_to_cold(spark, sf):
    warm = tiering.to_warm(C.hot(spark, sf).withColumn("embedding", F.array(F.lit(0.5).cast("float"))))
    return tiering.to_cold(warm).select("conversation_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "ultra_summary")


@query(sql("hot", "SELECT 'hot' AS tier, count(*) FILTER (\"timestamp\" >= TIMESTAMP '2024-01-24') AS n FROM hot UNION ALL SELECT 'warm', count(*) FILTER (\"timestamp\" < TIMESTAMP '2024-01-24') FROM hot UNION ALL SELECT 'cold', 0"))
def s12_m8_tier_counts(spark, sf):
    stays, warm, _ = tiering.migrate(C.hot(spark, sf).withColumn("embedding", F.array(F.lit(0.5).cast("float"))), AS_OF)
    return tiering.tier_counts(stays, warm)


# traces and reliability


@query(sql("hot", "SELECT conversation_id, epoch_us(\"timestamp\") AS at_us FROM hot WHERE system_id = 'src3' AND \"timestamp\" >= TIMESTAMP '2024-01-05' AND \"timestamp\" <= TIMESTAMP '2024-02-20' AND lang = 'en' ORDER BY \"timestamp\" DESC, conversation_id LIMIT 100"))
def s5_p5_query_traces(spark, sf):
    return fitness.query_traces(C.hot(spark, sf), "src3", "2024-01-05", "2024-02-20", "en").select("conversation_id", us("timestamp").alias("at_us"))


SIGNALS = "WITH g AS (SELECT task_class, coalesce(selector, 'unknown') AS selector, avg(CASE WHEN outcome = 'error' THEN 1.0 ELSE 0.0 END) AS f, list_sort(list(duration_ms)) AS d, count(*) AS n, count(DISTINCT component_name) AS c FROM traces GROUP BY 1, 2) "


@query(sql("traces", SIGNALS + "SELECT task_class, selector, round(f, 6) AS failure_rate, round(1 - f, 6) AS score, d[least(CAST(floor(n * 0.99) AS INTEGER), n - 1) + 1] AS p99_ms, n AS samples, c AS components FROM g"))
def g5_g8_signals(spark, sf):
    return six(fitness.signals(C.traces(spark, sf)), "failure_rate", "score")


@query(sql("traces", SIGNALS + "SELECT task_class, selector, d[least(CAST(floor(n * 0.99) AS INTEGER), n - 1) + 1] AS p99_ms FROM g"))
def g6_p99_of_many(spark, sf):
    return fitness.p99_of_many(C.traces(spark, sf))


@query(sql("traces", SIGNALS + "SELECT task_class, count(*) AS selectors, CAST(sum(n) AS BIGINT) AS samples FROM g WHERE task_class <> 'other' GROUP BY 1"))
def g15_fitness_summary(spark, sf):
    return fitness.summary(fitness.signals(C.traces(spark, sf), classes=fitness.TASK_CLASSES))


@query(sql("traces", SIGNALS + "SELECT 'routing_fitness/' || task_class || '/' || selector AS key, round(1 - f, 6) AS score FROM g"))
def k10_signal_keys(spark, sf):
    return six(fitness.signal_keys(fitness.signals(C.traces(spark, sf))).select("key", "score"), "score")


@query(sql("traces", "SELECT component_name, count(*) AS calls, count(*) FILTER (outcome = 'ok') AS successes, round(count(*) FILTER (outcome = 'ok') / count(*), 6) AS success_rate FROM traces GROUP BY 1"))
def g16_success_rate(spark, sf):
    calls = C.traces(spark, sf).withColumn("ok", F.col("outcome") == "ok")
    return six(fitness.success_rate(calls, "component_name"), "success_rate")


@query(sql("traces", "SELECT task_class, count(*) AS n FROM traces GROUP BY 1"))
def u2_union_traces(spark, sf):
    t = C.traces(spark, sf)
    parts = [t.where(F.col("component_name") == f"c{k}").drop(*(["selector"] if k else [])) for k in range(3)]
    return fitness.union_traces(parts).groupBy("task_class").agg(F.count(F.lit(1)).alias("n"))


# alerts


@query(sql("metrics", "WITH a AS (SELECT seq, value, CASE seq % 3 WHEN 0 THEN 'high_latency' WHEN 1 THEN 'low_hit_rate' ELSE 'anomaly_detected' END AS t FROM metrics) SELECT seq, t AS alert_type, 'warning' AS severity, CASE t WHEN 'high_latency' THEN printf('High latency detected: %.2fms (threshold: %.2fms)', value, 20.0) WHEN 'low_hit_rate' THEN printf('Low cache hit rate: %.1f%% (threshold: %.1f%%)', value * 100, 50.0) ELSE printf('Anomaly detected: %.2fσ (threshold: %.2fσ)', value, 2.0) END AS message FROM a WHERE CASE t WHEN 'high_latency' THEN value > 20 WHEN 'low_hit_rate' THEN value < 0.5 ELSE value > 2 END"))
def a7_f17_thresholds(spark, sf):
    kind = F.element_at(F.array(F.lit("high_latency"), F.lit("low_hit_rate"), F.lit("anomaly_detected")), (F.col("seq") % 3 + 1).cast("int"))
    rows = C.metrics(spark, sf).select("seq", "value", kind.alias("alert_type"))
    return alerts.check_thresholds(rows, {"high_latency": 20.0}).select("seq", "alert_type", "severity", "message")


@query("WITH RECURSIVE a AS (SELECT event_id AS seq, event_type AS t, CAST(user_id % 4 AS VARCHAR) AS p, ts, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) AS k FROM events), s AS (SELECT t, p, k, seq, ts, ts AS sent, true AS out FROM a WHERE k = 1 UNION ALL SELECT a.t, a.p, a.k, a.seq, a.ts, CASE WHEN a.ts - s.sent >= INTERVAL 60 MINUTE THEN a.ts ELSE s.sent END, a.ts - s.sent >= INTERVAL 60 MINUTE FROM s JOIN a ON a.t = s.t AND a.p = s.p AND a.k = s.k + 1) SELECT t AS alert_type, p AS pattern_data, seq FROM s WHERE out")
def st4_suppress(spark, sf):
    e = C.table(spark, sf, "events").select(F.col("event_type").alias("alert_type"), (F.col("user_id") % 4).cast("string").alias("pattern_data"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"))
    return alerts.suppress(e, 60).select("alert_type", "pattern_data", "seq")


# knowledge graph


@query(sql("talks", "SELECT DISTINCT 'system:' || system_id AS entity_id, 'system' AS entity_type FROM talks WHERE system_id <> '' UNION SELECT 'user:' || user_id, 'user' FROM talks WHERE user_id <> '' UNION SELECT 'project:' || project, 'project' FROM talks WHERE project <> ''"))
def r1_k9_entities(spark, sf):
    return graph.extract_entities(C.talks(spark, sf)).select("entity_id", "entity_type")


@query(sql("talks", "SELECT 'user:' || user_id AS source_id, 'project:' || project AS target_id, 'worked_on' AS edge_type, seq * 2 AS seq FROM talks WHERE user_id <> '' AND project <> '' UNION ALL SELECT 'system:' || system_id, 'project:' || project, 'contains', seq * 2 + 1 FROM talks WHERE project <> ''"))
def r2_j3_relationships(spark, sf):
    return graph.extract_relationships(C.talks(spark, sf)).select("source_id", "target_id", "edge_type", "seq")


@query(sql("vertices edges", "SELECT e.target_id AS of_id, e.source_id AS entity_id, 'incoming' AS direction, e.edge_type FROM edges e WHERE e.target_id = 'nation:3' UNION ALL SELECT source_id, target_id, 'outgoing', edge_type FROM edges WHERE source_id = 'nation:3'"))
def r3_j1_neighbours(spark, sf):
    entities, edges = C.places(spark, sf)
    return graph.neighbours(edges, entities, "nation:3", limit=None).select("of_id", "entity_id", "direction", "edge_type")


@query(sql("edges", "WITH b AS (SELECT source_id AS of_id, target_id AS entity_id, seq, 0 AS turn FROM edges UNION ALL SELECT target_id, source_id, seq, 1 FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY of_id ORDER BY seq, turn) AS k FROM b) SELECT of_id, entity_id FROM r WHERE k <= 5"))
def o7_first_neighbours(spark, sf):
    entities, edges = C.places(spark, sf)
    return graph.neighbours(edges, entities, limit=5).select("of_id", "entity_id")


@query("WITH RECURSIVE edges AS (" + C.SQL["edges"] + "), b AS (SELECT source_id AS a, target_id AS z FROM edges UNION ALL SELECT target_id, source_id FROM edges), w AS (SELECT 'customer:1' AS entity_id, 1 AS nodes UNION SELECT b.z, w.nodes + 1 FROM w JOIN b ON b.a = w.entity_id WHERE w.nodes < 4) SELECT entity_id, CAST(min(nodes) AS INTEGER) AS nodes FROM w GROUP BY 1")
def r4_j2_shortest_paths(spark, sf):
    entities, edges = C.places(spark, sf)
    return graph.shortest_paths(edges, entities, "customer:1", 4).select("entity_id", "nodes")


@query(sql("vertices edges", "SELECT 'entity' AS kind, entity_type AS type, count(*) AS n FROM vertices GROUP BY ROLLUP (entity_type) UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY ROLLUP (edge_type)"))
def r5_g1_g2_statistics(spark, sf):
    return graph.statistics(*C.places(spark, sf))


@query(sql("edges", "WITH t AS (SELECT 'region:' || n_regionkey AS region, 'nation:' || n_nationkey AS nation FROM nation), m AS (SELECT region, least(min(nation), min(region), min(e.source_id)) AS low FROM t LEFT JOIN edges e ON e.target_id = t.nation GROUP BY 1), all_nodes AS (SELECT region AS entity_id, region FROM t UNION SELECT nation, region FROM t UNION SELECT e.source_id, t.region FROM edges e JOIN t ON e.target_id = t.nation) SELECT entity_id, low AS community FROM all_nodes JOIN m USING (region)"))
def r12_communities(spark, sf):
    return graph.communities(C.places(spark, sf)[1])


@query()
def r12_page_rank(spark, sf):
    return graph.page_rank(C.places(spark, sf)[1])


# code graphs


@query(sql("graphs", "SELECT repo_path, commit_hash, nodes_count, epoch_us(ingested_at) AS at_us FROM graphs ORDER BY ingested_at DESC, repo_path, commit_hash LIMIT 30"))
def s7_listing(spark, sf):
    return codegraph.listing(C.code_graphs(spark, sf), None, 30).withColumn("at_us", us("ingested_at")).drop("ingested_at")


@query(sql("graphs", "SELECT repo_path, commit_hash, nodes_count FROM graphs WHERE repo_path = 'Brand#3' AND commit_hash = 'c1'"))
def s6_lookup(spark, sf):
    return codegraph.get(C.code_graphs(spark, sf), "Brand#3", "c1").drop("ingested_at")


@query(sql("graphs", "SELECT repo_path, arg_max(commit_hash, ingested_at) AS commit_hash FROM graphs GROUP BY 1"))
def w6_latest(spark, sf):
    return codegraph.latest(C.code_graphs(spark, sf)).select("repo_path", "commit_hash")


@query(sql("graphs", "SELECT repo_path, commit_hash, nodes_count + CASE WHEN commit_hash = 'c1' THEN 100 ELSE 0 END AS nodes_count FROM graphs"))
def k8_upsert(spark, sf):
    g = C.code_graphs(spark, sf)
    new = g.where("commit_hash = 'c1'").withColumn("nodes_count", F.col("nodes_count") + 100).withColumn("ingested_at", F.col("ingested_at") + F.make_dt_interval(F.lit(9)))
    return codegraph.upsert(g, new).drop("ingested_at")


@query(sql("graphs", "SELECT repo_path, commit_hash FROM graphs WHERE repo_path NOT IN ('Brand#1', 'Brand#2')"))
def j7_s8_new_graphs(spark, sf):
    g = C.code_graphs(spark, sf)
    return codegraph.unknown_graphs(g, g.where("repo_path in ('Brand#1', 'Brand#2')"), "repo_path").select("repo_path", "commit_hash")


@query(sql("nodes", "SELECT repo_path, commit_hash, coalesce(type, 'unknown') AS type, count(*) AS n FROM nodes GROUP BY ALL"))
def g3_type_histogram(spark, sf):
    return codegraph.type_histogram(C.code_nodes(spark, sf))


@query(sql("nodes", "WITH h AS (SELECT repo_path, coalesce(type, 'unknown') AS type, count(*) AS n FROM nodes GROUP BY ALL), m AS (SELECT type, n FROM h WHERE repo_path = 'Brand#7') SELECT repo_path, round(sum(h.n * coalesce(m.n, 0)) / (sqrt(sum(h.n * h.n)) * (SELECT sqrt(sum(n * n)) FROM m)), 6) AS similarity FROM h LEFT JOIN m USING (type) WHERE repo_path <> 'Brand#7' GROUP BY 1"))
def r6_v12_j5_u4_similar_repositories(spark, sf):
    histogram = codegraph.type_histogram(C.code_nodes(spark, sf), ("repo_path",))
    return six(codegraph.graph_similarity(histogram, "Brand#7", 0.0, None, ("repo_path",)), "similarity")


@query(sql("nodes", "SELECT repo_path, count(*) AS usages, string_agg(DISTINCT file_path, ',' ORDER BY file_path) AS files FROM nodes WHERE contains(lower(name), 'ring') AND file_path IS NOT NULL GROUP BY 1"))
def r7_p6_usage(spark, sf):
    return codegraph.function_usage(C.code_nodes(spark, sf), "RING", 1000).withColumn("files", F.array_join("files", ","))


@query(sql("nodes", "SELECT repo_path, count(*) AS usages FROM nodes WHERE contains(lower(name), 'widget') AND file_path IS NOT NULL AND type IN ('function', 'method', 'call', 'import') GROUP BY 1 ORDER BY 1 LIMIT 20"))
def r8_function_usage(spark, sf):
    return codegraph.find_function_usage(C.code_nodes(spark, sf), "widget").drop("files")


@query(sql("nodes", "SELECT repo_path, commit_hash, node_id, file_path AS file, substr(source, 1, 100) AS match FROM nodes WHERE regexp_matches(source, 'def (red|blue) ') ORDER BY 1, 2, 3 LIMIT 100"))
def r9_p7_p8_patterns(spark, sf):
    return codegraph.search_patterns(C.code_nodes(spark, sf), "def (red|blue) ")


@query(sql("nodes", "SELECT repo_path, commit_hash, node_id, severity, message FROM nodes WHERE severity IN ('ERROR', 'WARNING') ORDER BY CASE severity WHEN 'ERROR' THEN 0 ELSE 1 END, 1, 2, 3 LIMIT 50"))
def r10_p9_o5_problems(spark, sf):
    return codegraph.problems(C.code_nodes(spark, sf), None, "WARNING").select("repo_path", "commit_hash", "node_id", "severity", "message")


@query(sql("nodes", "SELECT DISTINCT repo_path, commit_hash, name AS import_name FROM nodes i WHERE type = 'import' AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.repo_path = i.repo_path AND c.commit_hash = i.commit_hash AND c.type IN ('call', 'reference') AND string_split(c.name, '.')[-1] = string_split(i.name, '.')[-1])"))
def r11_j8_u3_unused_imports(spark, sf):
    n = C.code_nodes(spark, sf)
    short = n.withColumn("name", F.when(F.col("type") == "call", S.last_part(F.col("name"))).otherwise(F.col("name")))
    return codegraph.unused_imports(short)


@query(sql("links", "SELECT DISTINCT a.repo_path, a.commit_hash, a.source, a.target FROM links a JOIN links b ON a.repo_path = b.repo_path AND a.commit_hash = b.commit_hash AND a.source = b.target AND a.target = b.source"))
def r11_j9_circular_imports(spark, sf):
    return codegraph.circular_imports(C.code_links(spark, sf))


@query(sql("nodes", "WITH c AS (SELECT repo_path, name, count(*) AS n, min(node_id) AS f FROM nodes WHERE type = 'import' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_path ORDER BY n DESC, f, name) AS rank FROM c) SELECT repo_path, name, n, rank FROM r WHERE rank <= 10"))
def r11_g4_w5_import_patterns(spark, sf):
    return codegraph.import_patterns(C.code_nodes(spark, sf), key=("repo_path",))


# monitoring


@query(sql("samples", "WITH d AS (SELECT name, ts, value, value - lag(value) OVER (PARTITION BY name ORDER BY ts) AS x FROM samples), i AS (SELECT name, ts, CASE WHEN x < 0 THEN value ELSE x END AS inc FROM d WHERE x IS NOT NULL) SELECT name, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS bucket_us, round(sum(inc), 4) AS increase, round(sum(inc) / 3600, 6) AS rate FROM i GROUP BY 1, 2"))
def m1_rate(spark, sf):
    found = monitoring.rate(C.samples(spark, sf).drop("seq"), ["name"], "1 hour").withColumn("bucket_us", us("bucket")).drop("bucket")
    return six(found.withColumn("increase", F.round("increase", 4)), "rate")


BOUNDS = (1.0, 5.0, 10.0, 20.0, 50.0, 100.0, float("inf"))


@query("WITH b AS (SELECT event_type AS name, u.le, CAST(count(*) FILTER (value <= u.le) AS DOUBLE) AS value FROM events, (SELECT unnest([1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 'Infinity'::DOUBLE]) AS le) u GROUP BY 1, 2), w AS (SELECT *, max(value) OVER (PARTITION BY name) AS total, coalesce(lag(le) OVER (PARTITION BY name ORDER BY le), 0) AS low, coalesce(lag(value) OVER (PARTITION BY name ORDER BY le), 0) AS under FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY le) AS k FROM w WHERE value >= total * 0.95) SELECT name, round(CASE WHEN isinf(le) THEN low WHEN value = under THEN low ELSE low + (le - low) * (total * 0.95 - under) / (value - under) END, 6) AS quantile FROM f WHERE k = 1")
def m2_histogram_quantile(spark, sf):
    e = C.table(spark, sf, "events")
    sums = e.groupBy(F.col("event_type").alias("name")).agg(*[F.count_if(F.col("value") <= b).cast("double").alias(f"b{k}") for k, b in enumerate(BOUNDS)])
    buckets = sums.select("name", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("value")) for k, b in enumerate(BOUNDS)])).alias("b")).select("name", "b.*")
    return six(monitoring.histogram_quantile(buckets, 0.95, ["name"]), "quantile")


@query("SELECT CAST(user_id % 10 AS BIGINT) AS bucket, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) / sum(value), 6) AS ratio FROM events GROUP BY 1")
def m3_ratio(spark, sf):
    e = C.table(spark, sf, "events").withColumn("bucket", F.col("user_id") % 10)
    return six(monitoring.ratio(e, ["bucket"], F.col("event_type") != "error"), "ratio")


@query("SELECT event_type, round(sum(value), 4) AS total, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY 1")
def m4_share(spark, sf):
    return six(monitoring.share(C.table(spark, sf, "events"), "event_type").withColumn("total", F.round("total", 4)), "share")


@query("SELECT event_type, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY 1")
def m5_mean(spark, sf):
    e = C.table(spark, sf, "events").select("event_type", F.col("value").alias("sum_value"), F.lit(1).alias("count_value"))
    return six(monitoring.mean(e, ["event_type"]), "mean")


@query("SELECT source AS tier, CAST(sum(n_chars) AS BIGINT) AS bytes, round(sum(n_chars) / 1e9 * CASE source WHEN 'src1' THEN 0.1 WHEN 'src2' THEN 0.02 END, 12) AS cost FROM documents WHERE source IN ('src1', 'src2') GROUP BY 1")
def m6_costs(spark, sf):
    tiers = C.table(spark, sf, "documents").where("source in ('src1', 'src2')").groupBy(F.col("source").alias("tier")).agg(F.sum("n_chars").alias("bytes"))
    return monitoring.tier_costs(tiers, {"src1": 0.1, "src2": 0.02}).withColumn("cost", F.round("cost", 12))


@query("WITH t AS (SELECT event_id, event_type, ts, value > 3 AS ok, min(ts) OVER (PARTITION BY event_type) AS first, bool_and(value > 3) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS every FROM events) SELECT event_id, event_type FROM t WHERE every AND ts - first >= INTERVAL 30 MINUTE")
def m7_held(spark, sf):
    return monitoring.held(C.table(spark, sf, "events"), ["event_type"], F.col("value") > 3, 30).select("event_id", "event_type")
