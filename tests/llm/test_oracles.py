import os

import duckdb
import pytest

from loam.llm import queries


def rows_of(sql, sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    result = con.execute(sql)
    return [d[0] for d in result.description], sorted(result.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    names, rows = rows_of(queries.ORACLES[name], sf)
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == rows
