from datetime import datetime, timedelta

from loam.schemas import SCHEMAS
from loam.streaming import streams

BASE = datetime(2025, 2, 20)


def drained(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_uploads_rollup_and_alerts(spark, tmp_path):
    (tmp_path / "in/systems/s1/u1").mkdir(parents=True)
    (tmp_path / "in/systems/s1/u1/memories.json").write_text('{"conversations": [{"content": "a"}, {"content": "b"}]}')
    got = []
    drained(streams.deliver(streams.upload_stream(spark, str(tmp_path / "in")), str(tmp_path / "c1"), lambda df, _: got.extend(df.collect()), every=None))
    assert [(r.system_id, r.upload_id, r.content) for r in got] == [("s1", "u1", "a"), ("s1", "u1", "b")]

    rows = [("m", "s", BASE + timedelta(minutes=k), float(k), None, k) for k in range(30)]
    spark.createDataFrame(rows, SCHEMAS["metrics"]).coalesce(1).write.parquet(str(tmp_path / "points"))
    stream = spark.readStream.schema(SCHEMAS["metrics"]).parquet(str(tmp_path / "points"))
    buckets = []
    drained(streams.deliver(streams.rollup_stream(stream), str(tmp_path / "c2"), lambda df, _: buckets.extend(df.collect()), every=None))
    assert buckets and all(b.n == 5 for b in buckets)

    alerts = [("t", "warning", "x", "p", None, BASE + timedelta(minutes=m)) for m in (0, 1, 4, 5, 6, 9, 10, 30)]
    spark.createDataFrame(alerts, SCHEMAS["alerts"]).coalesce(1).write.parquet(str(tmp_path / "alerts"))
    sent = []
    stream = spark.readStream.schema(SCHEMAS["alerts"]).parquet(str(tmp_path / "alerts"))
    drained(streams.deliver(streams.alert_stream(stream), str(tmp_path / "c3"), lambda df, _: sent.extend(df.collect()), every=None))
    assert sorted((r.timestamp - BASE).seconds // 60 for r in sent) == [0, 5, 10, 30]


def test_failures_go_to_the_dead_letters(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in"))
    tries, dead = [], []

    def send(df, epoch):
        tries.append(epoch)
        raise RuntimeError("down")

    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    drained(streams.deliver(stream, str(tmp_path / "c"), send, lambda df, _: dead.append(df.count()), every=None))
    assert len(tries) == 3 and dead == [3]
