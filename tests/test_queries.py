"""Every query with SQL equals DuckDB on the smallest tables; model queries are covered elsewhere."""

import pytest

import __spark_entry__ as contract
from check import compare, tables

SF = "/root/testdata/sf0.001"
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    ok, message = compare(spark, con, name, contract.queries()[name], SQL[name], SF)
    assert ok, message


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", ["t15_feature_variants_unstemmed", "k1_naive_bayes", "m3_upsample", "a10_kendall_w"])
def test_result_does_not_depend_on_partitions(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            ok, message = compare(spark, con, name, contract.queries()[name], SQL[name], SF)
            assert ok, message
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
