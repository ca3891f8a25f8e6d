"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from .conftest import DATA
from graphspark.registry import IDS, ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, same_rows, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        same_rows(df, ORACLES[name])
    else:
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0
    assert IDS[name]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_second_block_of_a_customer_without_orders(spark, tmp_path):
    """Customers with both kinds of orders, with one, with none, and an order of nobody."""
    duckdb = pytest.importorskip("duckdb")
    customers, orders = [1, 2, 3, 4, 5], [(10, 1, "P"), (11, 1, "O"), (12, 2, "F"), (13, 3, "P"), (14, 9, "P"), (15, None, "P"), (16, 2, None)]
    spark.createDataFrame([(c, f"c{c}", 1, 0.5, "A") for c in customers], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(*o, 1.5, None, "1-URGENT") for o in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    connection = duckdb.connect()
    for name in ("customer", "orders"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = connection.sql(f"SELECT c, o, st FROM ({ORACLES['optional_two_blocks']})").fetchall()
    df = QUERIES["optional_two_blocks"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in df.select("c", "o", "st").collect()), key=str) == sorted(want, key=str)
    assert len(want) == 7 and ("customer/4", None, None) in want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
