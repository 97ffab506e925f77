"""Collectors: top-k, sorting, paging, merging, fusion and rescoring of hits (doc_id, score)."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot

LAST, FIRST = "last", "first"
#: Ranked lists are fused to this depth.
FUSED = 100_000


def top(hits: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """The k best: score falling, then doc_id rising. A partial top-k in every task, then one merge."""
    out = hits.orderBy(F.desc("score"), "doc_id")
    return (out.offset(offset) if offset else out).limit(k)


@dataclass(frozen=True)
class By:
    """A sort key: a column, SQL expression or Column; missing values last (default), first or replaced."""

    key: Any
    reverse: bool = False
    missing: Any = LAST

    def value(self) -> Column:
        c = self.key if isinstance(self.key, Column) else F.expr(self.key)
        return c if self.missing in (LAST, FIRST) else F.coalesce(c, F.lit(self.missing))

    def order(self) -> Column:
        c = self.value()
        if self.missing == FIRST:
            return c.desc_nulls_first() if self.reverse else c.asc_nulls_first()
        return c.desc_nulls_last() if self.reverse else c.asc_nulls_last()


SCORE = By("score", reverse=True)
DOC = By("doc_id")


def sort(hits: DataFrame, keys: list[By], k: int | None = None, offset: int = 0) -> DataFrame:
    """Hits under several keys; ties go to the smaller doc_id."""
    out = hits.orderBy(*[b.order() for b in keys], F.asc("doc_id"))
    out = out.offset(offset) if offset else out
    return out if k is None else out.limit(k)


def multi_value(values: Column, selector: str = "min") -> Column:
    """The value of an array that sorts: min, max, middle_min or middle_max (the lower or upper of two middles)."""
    s = F.array_sort(values)
    n = F.size(values)
    middle = {"middle_min": F.floor((n - 1) / 2) + 1, "middle_max": F.floor(n / 2) + 1}
    if selector in middle:
        return F.when(n > 0, F.element_at(s, F.greatest(middle[selector], F.lit(1)).cast("int")))
    return F.array_min(values) if selector == "min" else F.array_max(values)


def search_after(hits: DataFrame, keys: list[By], after: list, after_doc: Any, k: int) -> DataFrame:
    """The k hits that follow the one with sort values `after` and id `after_doc`. Missing values count as the keys say; None is a missing value."""
    follows = F.lit(False)
    same = F.lit(True)
    for b, v in zip(keys, after, strict=True):
        c = b.value()
        if v is None:
            beyond = c.isNotNull() if b.missing == FIRST else F.lit(False)
            equal = c.isNull()
        else:
            beyond = c < F.lit(v) if b.reverse else c > F.lit(v)
            beyond = F.coalesce(beyond, F.lit(b.missing == LAST))
            equal = F.coalesce(c == F.lit(v), F.lit(False))
        follows = follows | (same & beyond)
        same = same & equal
    follows = follows | (same & (F.col("doc_id") > F.lit(after_doc)))
    return sort(hits.where(follows), keys, k)


def merge(shards: list[DataFrame], k: int, keys: list[By] | None = None, offset: int = 0) -> DataFrame:
    """The best of several shards' hits, with column shard; ties go to the earlier shard, then to the smaller id."""
    rows = [h.withColumn("shard", F.lit(i)) for i, h in enumerate(shards)]
    out = functools.reduce(DataFrame.unionByName, rows).orderBy(*[b.order() for b in keys or [SCORE]], "shard", "doc_id")
    return (out.offset(offset) if offset else out).limit(k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60, top_n: int | None = None) -> DataFrame:
    """(doc_id, score): sum of 1 / (k + rank) over ranked lists of hits, of each its FUSED best."""
    rows = []
    for i, h in enumerate(lists):
        rank = F.row_number().over(Window.partitionBy(F.lit(i)).orderBy(F.desc("score"), "doc_id"))  # of FUSED rows
        rows.append(top(h, FUSED).select("doc_id", (1.0 / (k + rank)).alias("score")))
    out = functools.reduce(DataFrame.union, rows).groupBy("doc_id").agg(F.sum("score").alias("score"))
    return out if top_n is None else top(out, top_n)


def rescore(hits: DataFrame, window: int, second: DataFrame, combine: Callable[[Column, Column], Column] | None = None, k: int | None = None) -> DataFrame:
    """The best `window` hits with scores combined with second hits; those the second lacks keep their score."""
    combine = combine or (lambda a, b: a + b)
    s = second.select("doc_id", F.col("score").alias("s2"))
    joined = top(hits, window).join(s, "doc_id", "left")
    out = joined.select("doc_id", F.when(F.col("s2").isNull(), F.col("score")).otherwise(combine(F.col("score"), F.col("s2"))).alias("score"))
    return top(out, k or window)


def rescore_sort(hits: DataFrame, window: int, docs: DataFrame, keys: list[By], k: int | None = None) -> DataFrame:
    """The best `window` hits sorted by the documents' columns."""
    return sort(top(hits, window).join(docs, "doc_id"), keys, k or window).select("doc_id", "score")


def rescore_expression(hits: DataFrame, window: int, docs: DataFrame, expr: str, k: int | None = None) -> DataFrame:
    """The best `window` hits scored by an expression of `score` and the documents' columns."""
    return top(top(hits, window).join(docs, "doc_id").select("doc_id", F.expr(expr).cast("double").alias("score")), k or window)


def sum_max_similarity(query: list[list[float]], vectors: Column) -> Column:
    """Late interaction: for each query vector the best dot product with any of a document's, summed."""

    def best(q: list[float]) -> Column:
        return F.array_max(F.transform(vectors, lambda v: dot(v, q)))

    return functools.reduce(Column.__add__, [best(q) for q in query])


def early(hits: DataFrame, n: int) -> DataFrame:
    """Any n hits."""
    return hits.limit(n)


def within_time(hits: DataFrame, seconds: float) -> DataFrame:
    """The hits that are collected in so many seconds from now: each task ends at the deadline, between two batches, with what it has."""
    deadline = time.time() + seconds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if time.time() > deadline:
                return
            yield b

    return hits.mapInArrow(run, hits.schema)


def positive(hits: DataFrame) -> DataFrame:
    return hits.where("score > 0")


def total_hits(hits: DataFrame) -> DataFrame:
    """(value, relation): always an exact count."""
    return hits.agg(F.count("*").alias("value")).select("value", F.lit("EQUAL_TO").alias("relation"))


def several(hits: DataFrame, **aggregates: Column) -> DataFrame:
    """Several aggregate collectors in one pass."""
    return hits.agg(*[c.alias(n) for n, c in aggregates.items()])


def docs_in_order(hits: DataFrame) -> DataFrame:
    return hits.orderBy("doc_id")
