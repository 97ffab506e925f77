"""Every query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarry import catalog

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda v: "NULL" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_every_column_is_computed(spark, name):
    """Queries that SQL can't express give rows without nulls; their values are compared in test_values.py."""
    out = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(out) and not out.isna().any().any()


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id", "score"] and out.count() >= 0
    assert all(math.isfinite(r["score"]) for r in out.collect())
