"""Queries whose work must not grow with repeated rows, and results where many rows tie or the driver is small."""

from __future__ import annotations

from collections import Counter

import pytest

from quarry import catalog
from quarry.functions import analysis, analyzers


def _once(split: bool) -> analysis.Analyzer:
    """Of words; in a task it refuses a text that it has seen. split: it may be given the words one by one."""
    seen: set[str] = set()

    def words(text):
        if text in seen:
            raise ValueError(f"analysed again: {text}")
        seen.add(text)
        at = 0
        for w in text.split():
            yield analysis.Token(w, at, at + len(w))

    return analysis.Analyzer(analysis.by_run(words) if split and hasattr(analysis, "by_run") else words)


TEXTS = ["a b", "c", "a  b\tc d", None, "", "b c"] * 50 + ["d " * 300_000]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(i, x, "en", "web") for i, x in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, x) for i, x in enumerate(["large ring", "hot bolt"] * 40 + [None])], "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["standard", "english", "german"])
def test_words_are_analysed_once(spark, tables, monkeypatch, name):
    monkeypatch.setattr(analyzers, "analyzer", lambda _: _once(True))
    got = {r["term"]: r["n"] for r in catalog.QUERIES[f"analyze_{name}"](spark, tables).collect()}
    assert got == dict(Counter(w for x in TEXTS if x for w in x.split()))


def test_names_are_analysed_once(spark, tables, monkeypatch):
    monkeypatch.setattr(analyzers, "analyzer", lambda _: _once(False))
    monkeypatch.setattr(analyzers, "NAMES", ["once"])
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["term"]: r["n"] for r in catalog.QUERIES["analyze_all"](spark, tables).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {"large": 40, "ring": 40, "hot": 40, "bolt": 40, "en": len(TEXTS), "web": len(TEXTS)}


@pytest.mark.parametrize("held", [(1 << 25, 300_000), (8, 300_000), (1 << 25, 3)])
def test_term_counts_in_pieces(spark, monkeypatch, held):
    """What is held is given out in between; runs of any length, white space beyond ASCII and weights count."""
    monkeypatch.setattr(analysis, "HELD_CHARS", held[0])
    monkeypatch.setattr(analysis, "HELD", held[1])
    texts = [("The Äpfel's can't re-use x y", 1), ("漢字かな" * 40 + " ab", 2), ("été 3.14 a,b", 3), (None, 5), ("the the Häuser " * 90_000, 1)]
    chains = {n: analyzers.analyzer(n) for n in ("german", "english", "cjk", "whitespace", "keyword")}
    rows = spark.createDataFrame(texts, "x string, w long")
    want = {n: Counter() for n in chains}
    for x, w in texts:
        for n, a in chains.items():
            for t in a.terms(x):
                want[n][t] += w
    got = {n: Counter() for n in chains}
    for r in analysis.term_counts(rows, "x", chains, "w").collect():
        got[r["analyzer"]][r["term"]] += r["n"]
    assert got == want


def test_sessions_stay_out_of_the_driver(spark, tmp_path):
    """A memory table would hold them there; the result has files that executors wrote."""
    times = [(1, "00:00"), (1, "00:10"), (1, "01:00"), (2, "00:05"), (3, "23:00")]
    spark.createDataFrame([(i, u, f"2024-01-01 {t}:00", "view", 1.0) for i, (u, t) in enumerate(times)], "event_id long, user_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["event_stream_sessions"](spark, str(tmp_path))
    assert got.inputFiles()
    assert sorted((r["user_id"], f"{r['start']:%H:%M}", f"{r['stop']:%H:%M}", r["count"]) for r in got.collect()) == [(1, "00:00", "00:40", 2), (1, "01:00", "01:30", 1), (2, "00:05", "00:35", 1), (3, "23:00", "23:30", 1)]


def test_tied_blocks_by_parent(spark, tmp_path):
    """Orders whose best prices are equal: the smaller order first, whatever its best line's number."""
    rows = [(k, line, p) for k in range(1, 9) for line, p in ((9 - k, 50.0), (9 - k, 50.0), (20, 7.0))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in catalog.QUERIES["block_grouping"](spark, str(tmp_path)).select("parent", "doc_id", "score", "rank", "place").collect()]
    assert sorted(got) == [(k, 9 - k, 50.0, k, place) for k in range(1, 6) for place in (1, 2)]


def test_more_parts_than_the_sample_are_counted(spark, tmp_path):
    spark.range(1_200_007).selectExpr("id p_partkey", "concat('Brand#', id % 7) p_brand").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["label"]: r["count"] for r in catalog.QUERIES["facet_sampling"](spark, str(tmp_path)).collect()}
    assert got == {f"Brand#{i}": 1_200_007 // 7 + (i < 1_200_007 % 7) for i in range(7)}
