"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from framelake import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, found):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9) + 0.0
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


def by_sql(sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    out = con.execute(sql)
    return rows([c[0] for c in out.description], out.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_and_sql_agree(spark, name):
    df = registry.queries()[name](spark, SF)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    assert found == by_sql(registry.oracle_sql()[name])
    assert found


def test_entry(spark):
    assert entry.entry(spark).columns == ["k", "mean"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
