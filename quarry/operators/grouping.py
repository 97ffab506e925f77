"""Result grouping: groups of hits, their order, heads, members and values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .collect import SCORE, By, sort


def first_pass(hits: DataFrame, group: str, n: int, keys: list[By] | None = None, offset: int = 0, tie: str = "doc_id") -> DataFrame:
    """(group, rank): the n groups with the best best hit, ties by that hit's `tie`. One aggregation per group, then a top-n."""
    keys = keys or [SCORE]
    w = Window.partitionBy(group).orderBy(*[b.order() for b in keys], F.asc("doc_id"))
    heads = hits.where(F.col(group).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    best = sort(heads, [*keys, By(F.col(tie))], n, offset)
    order = Window.partitionBy(F.lit(1)).orderBy(*[b.order() for b in keys], F.asc(tie), F.asc("doc_id"))  # of n rows
    return best.select(F.col(group), F.row_number().over(order).alias("rank"))


def second_pass(hits: DataFrame, groups: DataFrame, group: str, per_group: int, keys: list[By] | None = None, offset: int = 0) -> DataFrame:
    """Hits with rank (of the group) and place (within it), the best per_group of each chosen group."""
    w = Window.partitionBy(group).orderBy(*[b.order() for b in keys or [SCORE]], F.asc("doc_id"))
    return hits.join(F.broadcast(groups), group).withColumn("place", F.row_number().over(w)).where((F.col("place") > offset) & (F.col("place") <= offset + per_group))  # n groups


def grouped(hits: DataFrame, group: str, n: int, per_group: int, group_sort: list[By] | None = None, within: list[By] | None = None, offset: int = 0, doc_offset: int = 0) -> DataFrame:
    """The best groups and the best hits in each; documents without a group are left out."""
    return second_pass(hits, first_pass(hits, group, n, group_sort, offset), group, per_group, within, doc_offset)


def block_grouped(children: DataFrame, parent: str, n: int, per_group: int, keys: list[By] | None = None) -> DataFrame:
    """grouped() of blocks: rows that were indexed with their parent's id. A block is a group even if it has one row. A child's doc_id counts within its block, so ties of blocks go to the smaller parent."""
    return second_pass(children, first_pass(children, parent, n, keys, tie=parent), parent, per_group, keys)


def all_groups(hits: DataFrame, group: str) -> DataFrame:
    return hits.select(group).where(F.col(group).isNotNull()).distinct()


def group_count(hits: DataFrame, group: str) -> DataFrame:
    return hits.agg(F.count_distinct(group).alias("groups"))


def group_heads(hits: DataFrame, group: str, keys: list[By] | None = None) -> DataFrame:
    """The best hit of each group."""
    w = Window.partitionBy(group).orderBy(*[b.order() for b in keys or [SCORE]], F.asc("doc_id"))
    return hits.where(F.col(group).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def distinct_values(hits: DataFrame, group: str, value: str, cap: int | None = None) -> DataFrame:
    """(group, values): the sorted distinct values of a second column in each group, at most `cap`."""
    v = F.array_sort(F.collect_set(value))
    return hits.where(F.col(group).isNotNull()).groupBy(group).agg((v if cap is None else F.slice(v, 1, cap)).alias("values"))


def group_facets(hits: DataFrame, group: str, facet: str) -> DataFrame:
    """(facet, groups): in how many groups each facet value is found."""
    return hits.where(F.col(facet).isNotNull()).groupBy(facet).agg(F.count_distinct(group).alias("groups"))


def reduce(hits: DataFrame, group: str, **aggregates: Column) -> DataFrame:
    """Any aggregates of each group."""
    return hits.groupBy(group).agg(*[c.alias(n) for n, c in aggregates.items()])


def reduce_in_pandas(hits: DataFrame, group: str, fn: Callable, schema: str) -> DataFrame:
    """A user's function of each group, which must fit in a task."""
    return hits.groupBy(group).applyInPandas(fn, schema)


def range_group(value: Column, width: float, low: float, high: float) -> Column:
    """The start of the range of `width` that holds a value; below low or from high on, low - width or high."""
    return F.when(value < low, F.lit(float(low - width))).when(value >= high, F.lit(float(high))).otherwise(F.floor((value - low) / width) * width + low)


def first_range(value: Column, ranges: list[tuple[str, float, float]]) -> Column:
    """The label of the first half-open range that holds a value."""
    out = F.lit(None).cast("string")
    for label, a, b in reversed(ranges):
        out = F.when((value >= a) & (value < b), label).otherwise(out)
    return out


def diversified(hits: DataFrame, key: str, per_key: int, k: int) -> DataFrame:
    """The k best hits of which at most per_key share a key."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_key).drop("_r").orderBy(F.desc("score"), "doc_id").limit(k)


def merge_groups(shards: list[DataFrame], group: str, n: int) -> DataFrame:
    """(group, score, hits): the best groups of several shards' (group, score, hits)."""
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy(group).agg(F.max("score").alias("score"), F.sum("hits").alias("hits")).orderBy(F.desc("score"), group).limit(n)
