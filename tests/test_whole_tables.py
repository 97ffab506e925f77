"""Queries over whole tables, against their SQL and brute force."""

from __future__ import annotations

import os

import duckdb
import pytest

from quarry import catalog

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def sql(text):
    c = duckdb.connect()
    for t in ("part", "lineitem", "documents"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c.execute(text).fetchall()


def test_shape_relation_of_every_part(spark):
    got = {r["doc_id"]: r["relation"] for r in catalog.QUERIES["geo_shape_relation"](spark, DATA).collect()}

    def relation(y1, x1):
        points = {(y, x) for y in range(y1, y1 + 5) for x in range(x1, x1 + 7)}
        box = {(y, x) for y in range(20, 31) for x in range(10, 31)}
        return "within" if points <= box else "intersects" if points & box else "disjoint"

    want = {k: relation(size, k % 50) for k, size in sql("select p_partkey, p_size from part")}
    assert got == want and set(want.values()) == {"within", "intersects", "disjoint"}
    assert sorted(got.items()) == sorted(sql(catalog.ORACLES["geo_shape_relation"]))


@pytest.mark.parametrize("name, every", [("join_multi_valued", "select distinct l_partkey from lineitem"), ("sort_doc_order", "select p_partkey from part order by 1"), ("doc_and_score", "select doc_id from documents")])
def test_every_row_is_read(spark, name, every):
    got = [tuple(r) for r in catalog.QUERIES[name](spark, DATA).collect()]
    want = [r[0] for r in sql(every)]
    assert sorted(r[0] for r in got) == sorted(want)
    assert sorted(got) == sorted(sql(catalog.ORACLES[name]))
    if name == "sort_doc_order":
        assert [r[0] for r in got] == want
