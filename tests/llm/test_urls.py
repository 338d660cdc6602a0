import os
from datetime import date

import duckdb

from loam.llm import urls


def test_intervals_and_captures(spark):
    entries = [("ads", "a.com", "add", date(2024, 1, 10)), ("ads", "a.com", "remove", date(2024, 2, 1)), ("ads", "A.com", "add", date(2024, 3, 1)), ("bad", "x.a.com", "add", date(2024, 1, 1)), ("same", "b.org", "add", date(2024, 1, 5)), ("same", "b.org", "remove", date(2024, 1, 5)), (None, "a.com", "add", date(2024, 1, 1)), ("gone", "c.net", "remove", date(2024, 1, 1)), ("ads", "b.org", "add", None)]
    captures = [(1, "http://x.a.com/p", date(2024, 1, 9)), (2, "https://u@X.A.com:80/p", date(2024, 1, 10)), (3, "http://a.com", date(2024, 2, 1)), (4, "http://ya.com/", date(2024, 1, 20)), (5, "http://y.a.com?q", date(2025, 1, 1)), (6, None, date(2024, 1, 20)), (7, "junk", date(2024, 1, 20)), (8, "http://a.com", None), (9, "http://b.org", date(2024, 1, 6)), (1, "http://x.a.com/p", date(2024, 1, 9)), (None, "http://c.net", date(2024, 2, 2))]
    e = spark.createDataFrame(entries, "list string, domain string, action string, day date")
    c = spark.createDataFrame([(*x, "k", "l") for x in captures], "page_id long, url string, fetched date, lists string, domain string")
    got = sorted(((r.id, r.host, r.lists) for r in urls.listed(c, e).collect()), key=str)
    want = [(1, "x.a.com", ["bad"]), (1, "x.a.com", ["bad"]), (2, "x.a.com", ["ads", "bad"]), (3, "a.com", []), (4, "ya.com", []), (5, "y.a.com", ["ads"]), (6, None, []), (7, None, []), (8, "a.com", []), (9, "b.org", []), (None, "c.net", [])]
    assert got == sorted(want, key=str)
    assert urls.listed(c.limit(0), e).collect() == [] and urls.listed(c, e.limit(0)).where("n_lists > 0").count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = urls.op9_url_filters(spark, sf)
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    result = con.execute(urls.OP9_SQL)
    names = [d[0] for d in result.description]
    assert names == df.columns
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(result.fetchall()) and any(r[-1] for r in rows)
