"""Queries that SQL can't express, against plain Python over the same rows."""

from __future__ import annotations

import os
import re
import struct
from collections import Counter

import duckdb
import pytest

from quarry import catalog
from quarry.functions import analyzers

DATA = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def sql(text):
    c = duckdb.connect()
    for t in ("part", "documents", "labels", "pages", "customer", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c.execute(text).fetchall()


def got(spark, name):
    return catalog.QUERIES[name](spark, DATA).collect()


def test_feature_field(spark):
    want = {k: struct.unpack("<f", struct.pack("<I", struct.unpack("<I", struct.pack("<f", p))[0] & 0xFFFF8000))[0] for k, p in sql("select p_partkey, p_retailprice from part")}
    assert {r["p_partkey"]: r["feature"] for r in got(spark, "feature_field")} == want


@pytest.mark.parametrize("name", ["standard", "english", "german"])
def test_analyzers(spark, name):
    a = analyzers.analyzer(name)
    want = Counter(t for (x,) in sql("select text from documents") for t in a.terms(x))
    assert {r["term"]: r["n"] for r in got(spark, f"analyze_{name}")} == dict(want)


def test_every_chain_has_terms(spark):
    rows = got(spark, "analyze_all")
    assert {r["analyzer"] for r in rows} == set(analyzers.NAMES)
    texts = [x for (x,) in sql("select p_name from part union all select lang || ' ' || source from documents")]
    plain = {r["term"]: r["n"] for r in rows if r["analyzer"] == "whitespace"}
    assert plain == dict(Counter(w for x in texts for w in x.split()))
    letters = {r["term"]: r["n"] for r in rows if r["analyzer"] == "simple"}
    assert letters == dict(Counter(w.lower() for x in texts for w in re.findall("[A-Za-z]+", x)))


def test_dataset_split_covers_all(spark):
    assert sum(r["n"] for r in got(spark, "dataset_split")) == sql("select count(*) from documents")[0][0]


def test_classifiers_give_known_classes(spark):
    known = {r[0] for r in sql("select distinct toxic from labels")}
    for name in ("classify_knn_fuzzy", "classify_knn_document", "classify_bm25_bayes"):
        rows = got(spark, name)
        assert rows and {r[0] for r in rows} <= known
    labelled = sql("select count(*) from labels join documents using (doc_id)")[0][0]
    assert sum(r["count"] for r in got(spark, "classify_perceptron")) == labelled


def test_highlighted_passages(spark):
    rows = got(spark, "highlight_unified")
    want = {k for (k,) in sql("select doc_id from documents where contains(text, 'idiot')")}
    assert {r["doc_id"] for r in rows} == want
    assert all(re.search(r"<b>(idiot|clown)</b>", r["highlighted"], re.I) for r in rows if re.search(r"\b(idiot|clown)\b", r["highlighted"], re.I))
    phrase = {r["doc_id"]: r["n"] for r in got(spark, "highlight_phrase")}
    texts = dict(sql("select doc_id, text from documents"))
    for k, n in phrase.items():  # start and end of each of two terms
        words = [w for w in re.split("[^a-z0-9]+", texts[k].lower()) if w]
        assert n == 4 * sum(a == "of" and b == "the" for a, b in zip(words, words[1:], strict=False))
