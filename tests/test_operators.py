"""Scenarios of the operators on small inline tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loam.catalog import Catalog
from loam.functions import scalars as S
from loam.operators import alerts, codegraph, dedup, fitness, graph, ingest, monitoring, search, tiering, timeseries
from loam.operators.embedding import embed
from loam.operators.validation import InvalidRequest, check_request, manifest_errors, valid_prefix, valid_system_id, valid_upload_id
from loam.schemas import SCHEMAS
from loam.sources import readers

NOW = "2025-03-01"
BASE = datetime(2025, 2, 20)
POINTS = "metric_name string, system_id string, timestamp timestamp, value double, seq long"


def points(spark, values, metric="m", system="s", hours=1, first=0, base=BASE):
    return spark.createDataFrame([(metric, system, base + timedelta(hours=hours * k), float(v), first + k) for k, v in enumerate(values)], POINTS)


@pytest.mark.parametrize("values,direction", [([10 + 0.5 * i for i in range(20)], "increasing"), ([100 - 2 * i for i in range(20)], "decreasing"), ([50 + (i % 3 - 1) for i in range(20)], "stable"), ([7] * 5, "stable")])
def test_trend(spark, values, direction):
    r = timeseries.trends(points(spark, values), NOW, 30).first()
    assert r.trend_direction == direction and r.points == len(values)
    assert r.confidence == pytest.approx(len(values) / 100)
    if len(set(values)) == 1:
        assert r.trend_strength == 0 and r.percent_change == 0


def test_trend_needs_two_points_and_a_window(spark):
    assert timeseries.trends(points(spark, [1]), NOW, 30).collect() == []
    old = points(spark, [900], base=datetime(2024, 1, 1)).unionByName(points(spark, range(10), first=1))
    assert timeseries.trends(old, NOW, 30).first().points == 10


def test_anomalies(spark):
    values = [50 + (i % 5) * 0.1 for i in range(30)] + [150, -30]
    found = timeseries.anomalies(points(spark, values), NOW, 30, 2.5).collect()
    assert sorted(r.value for r in found) == [-30, 150]
    assert timeseries.anomalies(points(spark, [1] * 9), NOW, 30).collect() == []
    assert timeseries.anomalies(points(spark, [5] * 20), NOW, 30).collect() == []


def test_correlation(spark):
    both = points(spark, [50 + i for i in range(20)], system="a").unionByName(points(spark, [55 + i for i in range(25)], system="b", first=100)).unionByName(points(spark, [3] * 20, system="flat", first=300))
    rows = {(r.system_1, r.system_2): r for r in timeseries.correlations(both, NOW, 30).collect()}
    assert rows["a", "b"].correlation == pytest.approx(1) and rows["a", "b"].points == 20
    assert rows["a", "flat"].correlation == 0
    assert timeseries.correlations(points(spark, range(15)), NOW, 30).collect() == []


@pytest.mark.parametrize("values,segments,sharp", [([88] * 21 + [40, 38, 35, 37, 36], 2, True), ([90 - 1.5 * i for i in range(30)], 1, False), ([88] * 14, 1, False), ([50] * 10 + [20] * 5, 2, True), ([1, 2, 3, 4], 0, None)])
def test_change_points(spark, values, segments, sharp):
    series = spark.createDataFrame([("m", "e", (datetime(2025, 2, 1) + timedelta(days=k)).isoformat(), float(v)) for k, v in enumerate(values)] + [("m", "e", None, 1.0), ("m", "e", "junk", 1.0)], SCHEMAS["series"])
    rows = timeseries.change_points(series, NOW, 90).orderBy("segment").collect()
    assert len(rows) == segments
    if rows:
        assert rows[0].has_abrupt == sharp and [r.is_latest for r in rows] == [False] * (segments - 1) + [True]
        assert (rows[-1].trend_class == "abrupt") == sharp
    if segments == 2:
        assert rows[1].change_rank == 1 and rows[1].total_change < 0


def vectors(spark):
    rows = [("s1", "c1", [0.1, 0.2, 0.3]), ("s1", "c2", [0.15, 0.25, 0.35]), ("s2", "c3", [0.12, 0.22, 0.32]), ("s1", "zero", [0.0, 0.0, 0.0]), ("s1", "none", None), ("s1", "far", [-1.0, 0.0, 0.1])]
    return spark.createDataFrame([(*r, BASE + timedelta(hours=k)) for k, r in enumerate(rows)], "system_id string, conversation_id string, embedding array<float>, timestamp timestamp")


def test_search(spark):
    q = [0.1, 0.2, 0.3]
    assert [r.conversation_id for r in search.search_similar(vectors(spark), q, "s1", threshold=0.5).collect()] == ["c1", "c2"]
    assert [r.conversation_id for r in search.search_similar(vectors(spark), [0.0] * 3, limit=2).collect()] == ["far", "none"]
    assert {r.conversation_id for r in search.search_shards(vectors(spark), q, threshold=0.9, shards=4).collect()} == {"c1", "c2", "c3"}
    assert search.search_distance(vectors(spark), q, threshold=0.9).count() == 3
    assert search.get_by_id(vectors(spark), "c3").count() == 1


def test_merge(spark):
    rows = spark.createDataFrame([("conv-1", 0.7, "warm", 0), ("conv-1", 0.95, "hot", 1), ("conv-1", 0.6, "cold", 2), (None, 0.99, "hot", 3), ("conv-2", None, "hot", 4), ("conv-3", 0.95, "hot", 5)], "conversation_id string, similarity double, tier string, seq int")
    got = search.merge_results(rows, 10, [F.col("seq")]).collect()
    assert [(r.conversation_id, r.tier) for r in got] == [("conv-1", "hot"), ("conv-3", "hot"), ("conv-2", "hot")]
    assert search.merge_results(rows, 0).collect() == []


def test_vector_functions(spark):
    row = spark.createDataFrame([([0.5, -1.0, 1.0], [0.0, 0.0], [])], "v array<float>, z array<float>, e array<float>").select(S.quantise(F.col("v")).alias("q"), S.quantise(F.col("z")).alias("z"), S.quantise_plain(F.col("v")).alias("p"), S.is_zero(F.col("z")).alias("zero"), S.is_zero(F.col("e")).alias("empty"), S.normalise(F.col("z")).alias("n")).first()
    assert (row.q, row.z, row.p, row.zero, row.empty, row.n) == ([63, -127, 126], [0, 0], [63, -127, 127], True, True, [0, 0])


def test_scalars(spark):
    df = spark.createDataFrame([("A b. C. . D. E.", "system-1")], "t string, k string")
    r = df.select(S.summary(F.col("t")).alias("s"), S.shard_id(F.col("k")).alias("n"), S.shard_path(F.col("k"), base="x/").alias("p"), S.shard_path(F.lit("../a")).alias("bad"), S.key_part(F.lit("a b/" + "c" * 60)).alias("key"), S.key_part(F.lit("")).alias("none")).first()
    assert (r.s, r.n, r.p, r.bad, r.none) == ("A b. C. D", 145, "x/shard_145/system-1.parquet", None, "unknown")
    assert r.key.startswith("a_b_c") and len(r.key) == 50
    merged = spark.range(1).select(S.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))).alias("m")).first().m
    assert merged == {"a": "1", "b": "2"}


EDGES = "source_id string, target_id string, edge_type string, weight double, seq long"


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "x", 1.0, 0), ("b", "c", "x", 1.0, 1), ("c", "d", "y", 1.0, 2), ("a", "e", "x", 1.0, 3), ("e", "d", "x", 1.0, 4), ("d", "f", "x", 1.0, 5), ("a", "a", "x", 1.0, 6), ("a", "ghost", "x", 1.0, 7), ("a", "b", "x", 1.0, 8)], EDGES)
    entities = spark.createDataFrame([(x, "t") for x in "abcdefz"], "entity_id string, entity_type string")
    path = lambda s, t, n=3: graph.find_shortest_path(edges, entities, s, t, n)
    assert path("a", "c") == ["a", "b", "c"] and path("a", "a") == ["a"]
    assert path("a", "d") == ["a", "e", "d"] and path("a", "f") is None
    assert path("a", "f", 4) == ["a", "e", "d", "f"] and path("a", "z", 9) is None and path("a", "nobody") is None
    near = [(r.entity_id, r.direction) for r in graph.neighbours(edges, entities, "a").collect()]
    assert near == [("b", "outgoing"), ("e", "outgoing"), ("a", "outgoing"), ("a", "incoming"), ("b", "outgoing")]
    assert graph.neighbours(edges, entities, "c", "y").count() == 1
    totals = {(r.kind, r.type): r.n for r in graph.statistics(entities, edges).collect()}
    assert totals["edge", None] == 9 and totals["entity", None] == 7
    assert {r.community for r in graph.communities(edges).collect()} == {"a"}
    assert sum(r["rank"] for r in graph.page_rank(edges, 20).collect()) == pytest.approx(1)


def test_extraction(spark):
    talk = spark.createDataFrame([("sb-1", "alice", "mahi", 0), ("sb-1", "", None, 1), (None, "bob", "mahi", 2)], "system_id string, user_id string, project string, seq long")
    assert {r.entity_id for r in graph.extract_entities(talk).collect()} == {"system:sb-1", "user:alice", "project:mahi", "user:bob"}
    assert {(r.source_id, r.edge_type) for r in graph.extract_relationships(talk).collect()} == {("user:alice", "worked_on"), ("system:sb-1", "contains"), ("user:bob", "worked_on"), ("system:unknown", "contains")}


def code(spark):
    def g(repo, types, commit="c1", day=1, edges="[]"):
        nodes = ", ".join(f'"n{k}": {{"type": {t}, "name": "pkg.f{k}", "file": "a.py", "problems": [{{"severity": "ERROR", "message": "m"}}]}}' for k, t in enumerate(types))
        return (repo, commit, len(types), f'{{"nodes": {{{nodes}}}, "edges": {edges}}}', "{}", datetime(2025, 1, day))

    f, c = '"function"', '"class"'
    return codegraph.parsed(spark.createDataFrame([g("r1", [f, f, c]), g("r2", [f, c, c]), g("r3", ['"import"']), g("r4", []), g("r1", [c], "c0", 0 + 1, '[{"type": "imports", "source": "a", "target": "b"}, {"type": "imports", "source": "b", "target": "a"}]')], SCHEMAS["code_graphs"]))


def test_code_graphs(spark):
    graphs = code(spark)
    newest = graphs.where("commit_hash = 'c1'")
    rows = {r.repo_path: r.similarity for r in codegraph.similar_repositories(newest, "r1").collect()}
    assert rows["r2"] == pytest.approx(0.8) and "r3" not in rows
    nodes = codegraph.nodes(graphs)
    assert codegraph.find_function_usage(nodes, "PKG.F0").first().files == ["a.py"]
    assert codegraph.problems(nodes, "r2").count() == 3
    assert {(r.source, r.target) for r in codegraph.circular_imports(codegraph.links(graphs)).collect()} == {("a", "b"), ("b", "a")}
    assert codegraph.unused_imports(nodes).first().import_name == "pkg.f0"
    assert codegraph.upsert(graphs, graphs.withColumn("nodes_count", F.lit(9))).count() == 5
    for bad in ("(.*)+", "(", "a" * 501):
        with pytest.raises(ValueError):
            codegraph.safe_pattern(bad)


def test_tiers(spark, tmp_path):
    hot = spark.createDataFrame([("s", f"c{k}", f"One. Two. Three. Four {k}.", [0.5, -1.0], datetime(2025, 2, 28) - timedelta(days=10 * (k % 2)), "{}") for k in range(10)] + [("s", None, "x", [1.0], datetime(2025, 1, 1), "{}")], "system_id string, conversation_id string, content string, embedding array<float>, timestamp timestamp, metadata string")
    stays, warm, stats = tiering.migrate(hot, NOW, 7)
    assert stays.count() == 6 and warm.count() == 5
    assert (stats.first().records_migrated, stats.first().errors, stats.first().bytes_freed) == (5, 1, 12500)
    assert tiering.migrate(hot, NOW, 7, warm)[1].count() == 0
    cold = tiering.to_cold(warm, spark.createDataFrame([("s", datetime(2025, 2, 18).date(), "n", 2.0)], "system_id string, day date, name string, value double"))
    assert cold.first().daily_metrics == '{"n":2.0}' and cold.first().ultra_summary == "One"
    tiering.export_cold(cold, str(tmp_path / "cold"))
    assert (tmp_path / "cold/system_id=s/year=2025/month=02/day=18").is_dir()
    with pytest.raises(ValueError):
        tiering.export_cold(cold.limit(0), str(tmp_path / "none"))


@pytest.mark.parametrize("n,index", [(1, 0), (99, 98), (100, 99), (101, 99)])
def test_p99(spark, n, index):
    t = spark.createDataFrame([("quick", None, "error" if k == 0 else "ok", float(k), None) for k in range(n)], "task_class string, selector string, outcome string, duration_ms double, component_name string")
    r = fitness.signals(t).first()
    assert r.p99_ms == index and r.selector == "unknown" and r.failure_rate == pytest.approx(1 / n)
    assert fitness.p99_of_many(t).first().p99_ms == index


def test_alerts(spark):
    rows = spark.createDataFrame([("high_latency", 1500.0), ("high_latency", 10.0), ("low_hit_rate", 0.25), ("other", 9e9)], "alert_type string, value double")
    got = {r.alert_type: r for r in alerts.check_thresholds(rows).collect()}
    assert set(got) == {"high_latency", "low_hit_rate"}
    assert got["high_latency"].message == "High latency detected: 1500.00ms (threshold: 1000.00ms)" and got["low_hit_rate"].message == "Low cache hit rate: 25.0% (threshold: 50.0%)"
    times = [0, 1, 4, 5, 6, 9, 10, 30]
    sent = alerts.suppress(spark.createDataFrame([("t", "p", BASE + timedelta(minutes=m), m) for m in times], "alert_type string, pattern_data string, timestamp timestamp, seq int"))
    assert sorted(r.seq for r in sent.collect()) == [0, 5, 10, 30]


def test_validation(spark):
    good = ("2025-02-27T00:00:00Z", 5, 100, "1.0", "sb", "a" * 64, False, None, ["a.json"], {})
    bad = [("2026-02-27T00:00:00Z", *good[1:]), (good[0], -1, *good[2:]), (*good[:5], "xyz", *good[6:]), (*good[:6], True, None, *good[8:]), (*good[:8], ["../x"], {})]
    rows = spark.createDataFrame([good, *bad], SCHEMAS["manifest"])
    assert [r.e for r in rows.select(manifest_errors(rows, NOW).alias("e")).collect()] == [[], ["uploaded_at"], ["conversation_count"], ["checksum"], ["compression_format"], ["files"]]
    r = spark.range(1).select(valid_system_id(F.lit("a-b_1")).alias("a"), valid_system_id(F.lit("a b")).alias("b"), valid_upload_id(F.lit("a..b")).alias("c"), valid_prefix(F.lit("systems/a/b/")).alias("d"), valid_prefix(F.lit("other/a")).alias("e"), valid_prefix(F.lit("systems/*/b/")).alias("f")).first()
    assert list(r) == [True, False, False, True, False, False]
    with pytest.raises(InvalidRequest):
        check_request("analyze_trends", metric_name="bad name", time_window_days=7)
    with pytest.raises(InvalidRequest):
        check_request("find_path", source_id="a", target_id="a", max_hops=3)


def test_ingest(spark):
    rows = spark.createDataFrame([("1", "text", [1.0], {"source": "x", "correlation_id": "k"}), ("", "t", [1.0], {}), ("2", None, [1.0], {}), ("3", "t", None, {})], "memory_id string, text string, embedding array<float>, metadata map<string,string>")
    good, rejects = ingest.prepare(rows, NOW, 1)
    assert good.first().system_id == "x" and '"correlation_id":"k"' in good.first().metadata and rejects.count() == 3
    assert ingest.batch_status(good, rejects).first().status == "partial"
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "conversation_id string")
    ok, clash = ingest.insertable(new, new.where("conversation_id = 'a'"))
    assert ok.count() == 1 and clash.count() == 2


def test_uploads(spark, tmp_path):
    for u, body in (("u1", '{"conversations": [{"content": "hello"}, {"content": ""}, {"id": "x", "content": "hi", "metadata": {"source": "m"}}]}'), ("u2", "{broken")):
        (tmp_path / f"systems/s1/{u}").mkdir(parents=True)
        (tmp_path / f"systems/s1/{u}/memories.json").write_text(body)
        (tmp_path / f"systems/s1/{u}/manifest.json").write_text('{"uploaded_at": "2025-02-27T00:00:00Z", "conversation_count": 3}')
    found = ingest.from_uploads(readers.memories(spark, str(tmp_path)), NOW, 4).orderBy("conversation_id").collect()
    assert [(r.conversation_id, r.system_id) for r in found] == [("u1_0", "s1"), ("x", "s1")] and found[0].embedding == [0] * 4
    assert readers.manifests(spark, str(tmp_path)).count() == 2 and readers.upload_prefixes(spark, str(tmp_path)).count() == 2


def test_metric_text(spark):
    lines = ["# HELP x", "", 'http_total{code="200",m="a b"} 12', "up 1", "junk", "bad value", "inf_total +Inf"]
    got = {(r.name, r.labels): r.value for r in readers.metric_text(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("http_total", 'code="200",m="a b"'): 12, ("up", ""): 1, ("inf_total", ""): float("inf")}


def test_monitoring(spark):
    c = spark.createDataFrame([("x", BASE + timedelta(seconds=10 * k), float(v)) for k, v in enumerate([0, 5, 9, 2, 4])], "name string, ts timestamp, value double")
    assert monitoring.rate(c, ["name"]).first().increase == 5 + 4 + 2 + 2
    b = spark.createDataFrame([("x", le, v) for le, v in ((1.0, 10.0), (2.0, 90.0), (float("inf"), 100.0))], "name string, le double, value double")
    assert monitoring.histogram_quantile(b, 0.5, ["name"]).first()["quantile"] == pytest.approx(1.5)
    assert monitoring.histogram_quantile(b, 0.99, ["name"]).first()["quantile"] == 2.0


def test_near_duplicates_and_embedding(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "quite another text than the others"), (4, text), (5, None), (6, "")], "id int, content string")
    assert [(r.a, r.b) for r in dedup.find_similar(df, "id").collect()] == [(1, 2)]
    rows = df.select("id", embed(F.col("content"), 8).alias("e")).orderBy("id").collect()
    assert rows[0].e == rows[3].e != rows[1].e and rows[4].e is None


def test_catalog(spark):
    c = Catalog(spark, {"metrics": points(spark, [10 + 0.5 * i for i in range(20)]), "hot": vectors(spark).withColumn("content", F.lit("x")).withColumn("metadata", F.lit("{}"))}, NOW, 3)
    assert c.analyze_trends("m", time_window_days=30).first().trend_direction == "increasing"
    assert c.search_all_systems("hello", threshold=-1.0).count() == 4
    assert "analyze_trends" in [r.name for r in c.discover_tools("trend").collect()]
    assert c.store_memory("1", "t", [1.0])[0].count() == 1
    with pytest.raises(InvalidRequest):
        c.detect_anomalies("m", threshold_std=99)


def test_communities_follow_long_chains(spark):
    edges = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}", "t") for k in range(14)] + [("x", "y", "t")], "source_id string, target_id string, edge_type string")
    got = {r.entity_id: r.community for r in graph.communities(edges).collect()}
    assert got == {f"n{k:02}": "n00" for k in range(15)} | {"x": "x", "y": "x"}
    with pytest.raises(ValueError):
        graph.communities(edges, 3)
