"""The operators' queries against their SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from quarry.llm import queries

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), c.execute(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    show = lambda f: sorted(tuple("NULL" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert show(ours) == show(theirs)
