"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
CHOSEN = sorted(n for n in contract.oracle_sql() if contract.queries()[n].__module__.startswith("filecensus.plans"))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    found = contract.queries()[name](spark, SF_DIR)
    expected = duck.sql(contract.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    order = [expected.columns.index(c) for c in columns]
    left = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in order) for r in expected.fetchall()), key=repr)
    assert left == right


def test_entry_and_names(spark):
    assert contract.entry(spark).columns == ["category", "n_files", "total_size"]
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_results_do_not_depend_on_partitions(spark):
    query = contract.queries()["classify_files"]
    few = sorted(map(str, query(spark, SF_DIR).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, query(spark, SF_DIR).collect())) == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
