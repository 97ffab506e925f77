"""Recall of approximate vector search, measured against brute force."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest

from quarry.operators import knn

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")


def brute(ids, x, q, k):
    return [int(i) for i in ids[np.lexsort((ids, ((x - q) ** 2).sum(1)))[:k]]]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_lists_on_the_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = docs.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), float)
    lists = knn.Lists.build(docs, str(tmp_path / "lists"), "embedding", "vec_id", lists=16)
    assert lists.docs.count() == len(rows)
    hits = []
    for at in (3, 50, 150, 250):
        want = brute(ids, x, x[at], 10)
        assert [r["doc_id"] for r in lists.exact(x[at].tolist(), 10).collect()] == want
        # vectors in all directions alike: most lists have to be probed
        hits.append(len({r["doc_id"] for r in lists.search(x[at].tolist(), 10, 12).collect()} & set(want)) / 10)
    assert np.mean(hits) >= 0.9


def test_lists_in_groups(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(0, 10, (12, 16))
    x = np.repeat(centres, 100, 0) + r.normal(0, 0.5, (1200, 16))
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(1200), "v": x.tolist()}))
    lists = knn.Lists.build(docs, str(tmp_path / "lists"), "v", lists=12, sample=600)
    for at in (5, 777):
        want = brute(np.arange(1200), x, x[at], 10)
        assert [d["doc_id"] for d in lists.search(x[at].tolist(), 10, 2).collect()] == want
        assert [d["doc_id"] for d in lists.exact(x[at].tolist(), 10).collect()] == want
        assert len(lists.reached(x[at].tolist(), 10)) <= 3  # lists that lie beyond the k-th aren't read
    none = knn.Lists.build(docs.where("false"), str(tmp_path / "none"), "v")
    assert none.search([0.0] * 16, 3, 2).count() == 0
