"""Query-time joins and parent/child joins, as equi-joins on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE, AVG, MAX, TOTAL, MIN = "none", "avg", "max", "total", "min"


def score_mode(mode: str, score: str = "score") -> Column:
    """How several scores become one."""
    s = F.col(score)
    return {NONE: F.lit(1.0), AVG: F.avg(s), MAX: F.max(s), TOTAL: F.sum(s), MIN: F.min(s)}[mode]


def join_query(source: DataFrame, from_key: str, target: DataFrame, to_key: str, target_id: str = "doc_id", multi_valued: bool = False) -> DataFrame:
    """Target documents whose key is among the source hits' keys, scored 1; null keys join nothing. A semi-join."""
    keys = source.select((F.explode(from_key) if multi_valued else F.col(from_key)).alias("_k")).where("_k is not null").distinct()
    return target.join(keys, F.col(to_key) == F.col("_k"), "left_semi").select(F.col(target_id).alias("doc_id"), F.lit(1.0).alias("score"))


def join_query_scored(source: DataFrame, from_key: str, target: DataFrame, to_key: str, mode: str = MAX, target_id: str = "doc_id", min_matches: int = 1, max_matches: int | None = None) -> DataFrame:
    """Target documents scored by the source hits of their key, if these are min_matches to max_matches. Source rows carry `score`; aggregated before the join."""
    agg = source.where(F.col(from_key).isNotNull()).groupBy(F.col(from_key).alias("_k")).agg(score_mode(mode).cast("double").alias("score"), F.count("*").alias("_n"))
    agg = agg.where(F.col("_n") >= min_matches)
    agg = agg if max_matches is None else agg.where(F.col("_n") <= max_matches)
    return target.join(agg, F.col(to_key) == F.col("_k")).select(F.col(target_id).alias("doc_id"), "score")


def to_parents(children: DataFrame, parent_key: str, parents: DataFrame, parent_id: str, mode: str = AVG) -> DataFrame:
    """Parents of child hits, scored by them."""
    agg = children.groupBy(F.col(parent_key).alias("_p")).agg(score_mode(mode).cast("double").alias("score"))
    return parents.join(agg, F.col(parent_id) == F.col("_p")).select(F.col(parent_id).alias("doc_id"), "score")


def to_children(parents: DataFrame, parent_id: str, children: DataFrame, parent_key: str, child_ids: list[str]) -> DataFrame:
    """Children of parent hits, with the parent's score."""
    p = parents.select(F.col(parent_id).alias("_p"), "score")
    return children.join(p, F.col(parent_key) == F.col("_p")).select(*child_ids, "score")


def children_of(children: DataFrame, parent_key: str, *parents) -> DataFrame:
    """Children of one or several parents, given by id."""
    return children.where(F.col(parent_key).isin(*parents))


def children_of_hits(children: DataFrame, parent_key: str, parents: DataFrame, parent_id: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_id).alias("_p")), F.col(parent_key) == F.col("_p"), "left_semi")


def select_child_value(children: DataFrame, parent_key: str, value: str, selector: str = MIN, integer: bool = False) -> DataFrame:
    """(parent, value): min, max, avg or sum of the children's value; an integer average is cut towards zero."""
    v = F.col(value)
    agg = {MIN: F.min(v), MAX: F.max(v), TOTAL: F.sum(v), "sum": F.sum(v), AVG: F.avg(v)}[selector]
    if integer and selector == AVG:
        mean = F.sum(v) / F.count(v)
        agg = F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean)).cast("long")
    return children.groupBy(F.col(parent_key).alias("parent")).agg(agg.alias("value"))


def sort_parents(parents: DataFrame, parent_id: str, children: DataFrame, parent_key: str, value: str, selector: str = MIN, reverse: bool = False) -> DataFrame:
    """Parents in the order of a child value; those without children last."""
    v = select_child_value(children, parent_key, value, selector)
    c = F.col("value")
    return parents.join(v, F.col(parent_id) == F.col("parent"), "left").orderBy(c.desc_nulls_last() if reverse else c.asc_nulls_last(), parent_id).select(F.col(parent_id).alias("doc_id"), "value")


def collect_children(children: DataFrame, parent_key: str, child_id: str, per_parent: int) -> DataFrame:
    """(parent, hits): the best children of each parent, best first, and never more than per_parent."""
    w = Window.partitionBy(parent_key).orderBy(F.desc("score"), child_id)
    rows = children.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_parent)
    hits = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(child_id).alias("doc_id"), "score"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score")))
    return rows.groupBy(F.col(parent_key).alias("parent")).agg(hits.alias("hits"))


def check_integrity(children: DataFrame, parent_key: str, parents: DataFrame, parent_id: str) -> DataFrame:
    """(problem, count): children without a key or a parent, and parents that stand twice; no rows if all is well."""
    orphans = children.where(F.col(parent_key).isNull()).agg(F.count("*").alias("count")).select(F.lit("child without key").alias("problem"), "count")
    lost = children.where(F.col(parent_key).isNotNull()).join(parents.select(F.col(parent_id).alias("_p")), F.col(parent_key) == F.col("_p"), "left_anti").agg(F.count("*").alias("count")).select(F.lit("child without parent").alias("problem"), "count")
    twice = parents.groupBy(parent_id).count().where(F.col("count") > 1).agg(F.count("*").alias("count")).select(F.lit("parent id twice").alias("problem"), "count")
    return orphans.union(lost).union(twice).where(F.col("count") > 0)
