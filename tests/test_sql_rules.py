"""Queries and their SQL on tables where rounding, long lines, equal spans and large sheets tell rules apart."""

import duckdb
import pytest

from quillspark.plans import ORACLES, QUERIES
from test_queries import rows

DOCS = {
    "size_texts": ["x" * 32768, "x" * 98304, "x" * 40000, "", None],  # 3.125 and 9.375 MB
    "redaction_boxes": [" ".join(f"n{k}@example.org" for k in range(60)), "none\na@b.org"],
    "merged_columns": ["\n".join(["aa bb cc dd ee ff gg hh ii jj kk ll"] * 40), "one two"],
    "table_cells": ["\n".join(["aa bb cc dd ee ff gg hh ii jj kk ll"] * 40), "one two"],
}


def _compared(spark, folder, name, table):
    found = QUERIES[name](spark, str(folder)).toPandas()
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    assert rows(found) == rows(c.execute(ORACLES[name]).fetchdf())
    return found


@pytest.mark.parametrize("name", sorted(DOCS))
def test_documents(spark, tmp_path, name):
    docs = spark.createDataFrame(list(enumerate(DOCS[name])), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = _compared(spark, tmp_path, name, "documents")
    if name == "redaction_boxes":
        assert len(found) == 61


def test_large_workbooks_are_refused_with_the_reason(spark, tmp_path):
    orders = spark.createDataFrame([(1, 10, 5.25, "LOW"), (2, 20, 1.0, "HIGH"), (9_000_000, 20, 2.5, "LOW")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = _compared(spark, tmp_path, "workbook_round_trip", "orders")
    assert found[found.book == 20].error.tolist() == ["too many cells"]
