"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import decimal
import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillspark.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, float | decimal.Decimal | numbers.Integral):
        return float(v)  # pandas reads integers with gaps as floats
    return tuple(v) if hasattr(v, "__len__") and not isinstance(v, str | bytes) else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(found.columns)
        return
    expected = db.execute(ORACLES[name]).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
