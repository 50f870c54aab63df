"""Every registered query with SQL gives what DuckDB gives on the same files."""

import duckdb
import pytest

import __spark_entry__ as entry
from routeloom.plans import fleets, oracle, programs, queries, rules, rules_sql

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    f = frame[columns].astype(object)
    return sorted(map(repr, f.where(f.notna(), None).values.tolist()))


QUERIES, SQL = queries.queries() | {f.__name__: f for f in rules.ALL} | programs.queries() | fleets.queries(), oracle.oracle_sql() | rules_sql.oracle_sql() | programs.oracle_sql() | fleets.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
