"""Every query with checking SQL against DuckDB on the smallest tables, and the contract's basic properties."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return format(round(float(x), 5) + 0.0, ".9g")
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    return str(x).removesuffix(" 00:00:00")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_dont_depend_on_partitions(spark):
    names = ["gate_quota", "canonical_context", "tier_rerank", "hybrid_search", "debounce"]
    before = {n: rows_of((df := catalogue.QUERIES[n](spark, SF)).columns, df.collect()) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for n in names:
            df = catalogue.QUERIES[n](spark, SF)
            assert rows_of(df.columns, df.collect()) == before[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
