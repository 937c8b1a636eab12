"""Queries that do their whole job: on tables where a cap would leave something out, they give the rows of their SQL."""

import pytest

from test_sql_rules import _compared

ORDERS = [(1, 10, 5.25, "LOW", "O", "1996-01-02"), (2, 20, 1.0, "HIGH", "F", "1994-02-03"), (30_000_000, 20, 250000.5, "LOW", "F", "1995-03-04"), (30_000_001, 20, 0.0, "HIGH", "P", "1996-01-02")]
ROWS = {"workbook_formats": 12, "workbook_round_trip": 9, "workbook_widths": 8}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_workbooks_with_rows_far_down_are_written(spark, tmp_path, name):
    orders = spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string, o_orderdate string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = _compared(spark, tmp_path, name, "orders")
    assert len(found[found.book == 20]) == ROWS[name]
