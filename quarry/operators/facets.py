"""Facets: counts and aggregates of hits by label, value, range, path and tuple."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .query import range_relation


@dataclass
class FacetsConfig:
    """How dimensions are counted: hierarchical ones are paths joined by a separator, multi-valued ones arrays."""

    hierarchical: set[str] = field(default_factory=set)
    multi_valued: set[str] = field(default_factory=set)
    require_dim_count: set[str] = field(default_factory=set)
    separator: str = "/"


def counts(hits: DataFrame, dim: str, k: int | None = None, multi_valued: bool = False) -> DataFrame:
    """(label, count) of a column, or of an array column's distinct values; count falling, label rising."""
    rows = hits.select(F.explode(F.array_distinct(dim)).alias("label")) if multi_valued else hits.select(F.col(dim).alias("label"))
    out = rows.where("label is not null").groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")
    return out if k is None else out.limit(k)


def all_dims(hits: DataFrame, dims: list[str], k: int) -> DataFrame:
    """(dim, label, count): the k most frequent labels of every dimension, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("label")) for d in dims])).alias("p")
    c = hits.select(pairs).where("p.label is not null").groupBy("p.dim", "p.label").agg(F.count("*").alias("count"))
    w = Window.partitionBy("dim").orderBy(F.desc("count"), "label")
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def specific(hits: DataFrame, dim: str, label) -> DataFrame:
    """(count) of one label; -1 if there is none."""
    return hits.where(F.col(dim) == label).agg(F.when(F.count("*") == 0, -1).otherwise(F.count("*")).cast("long").alias("count"))


def top_dims(hits: DataFrame, dims: list[str], k: int) -> DataFrame:
    """(dim, count, labels): dimensions by how many hits have them."""
    rows = [hits.agg(F.count(d).alias("count"), F.count_distinct(d).alias("labels")).select(F.lit(d).alias("dim"), "count", "labels") for d in dims]
    return functools.reduce(DataFrame.union, rows).orderBy(F.desc("count"), "dim").limit(k)


def taxonomy(hits: DataFrame, path: Column, aggregate: Column | None = None, key: str = "doc_id") -> DataFrame:
    """(depth, path, count[, value]): a count for every prefix of each document's path (an array of labels), rolled up.

    Each document counts once for a prefix, however many of its paths share it.
    """
    prefixes = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda n: F.slice("_p", F.lit(1), n))
    rows = hits.withColumn("_p", path).where(F.size("_p") > 0).withColumn("_x", F.explode(prefixes))
    group = rows.groupBy(F.size("_x").alias("depth"), F.array_join("_x", "/").alias("path"))
    extra = [] if aggregate is None else [aggregate.alias("value")]
    return group.agg(F.count_distinct(key).alias("count"), *extra)


def taxonomy_children(table: DataFrame, path: list[str], k: int) -> DataFrame:
    """(label, count): the k most frequent children of a path in a taxonomy table."""
    at = "/".join(path)
    rows = table.where(F.col("depth") == len(path) + 1)
    if path:
        rows = rows.where(F.col("path").startswith(at + "/"))
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("label"), "count").orderBy(F.desc("count"), "label").limit(k)


def taxonomy_ordinals(table: DataFrame) -> DataFrame:
    """(ord, path, parent): a dimension table of paths; the root is ordinal 0. Ordinals follow depth and path."""
    w = Window.partitionBy(F.lit(1)).orderBy("depth", "path")  # a row a label
    rows = table.select("depth", "path").distinct().withColumn("ord", F.row_number().over(w))
    parent = rows.select(F.col("path").alias("pp"), F.col("ord").alias("parent"))
    up = F.when(F.col("depth") == 1, F.lit("")).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    return rows.join(parent, up == F.col("pp"), "left").select("ord", "path", F.coalesce("parent", F.lit(0)).alias("parent"))


def associations(hits: DataFrame, pairs: str, function: str = "sum") -> DataFrame:
    """(label, value, count): sum or max of the values of an array of (label, value) structs."""
    rows = hits.select(F.explode(pairs).alias("p")).select("p.*")
    agg = F.sum("value") if function == "sum" else F.max("value")
    return rows.groupBy("label").agg(agg.alias("value"), F.count("*").alias("count")).orderBy(F.desc("value"), "label")


def long_values(hits: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """(value, count), count falling, value rising."""
    out = hits.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
    return out if k is None else out.limit(k)


@dataclass(frozen=True)
class RangeBucket:
    label: str
    low: float | None
    high: float | None
    include_low: bool = True
    include_high: bool = False

    def holds(self, v: Column) -> Column:
        out = v.isNotNull()
        if self.low is not None:
            out = out & (v >= F.lit(self.low) if self.include_low else v > F.lit(self.low))
        if self.high is not None:
            out = out & (v <= F.lit(self.high) if self.include_high else v < F.lit(self.high))
        return out


def _unpivot(row: DataFrame, labels: list[str]) -> DataFrame:
    entries = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.lit(i).alias("position"), F.col(f"c{i}").alias("count")) for i, x in enumerate(labels)])).alias("e")
    return row.select(entries).select("e.label", "e.position", "e.count")


def ranges(hits: DataFrame, value: str, buckets: list[RangeBucket], multi_valued: bool = False) -> DataFrame:
    """(label, position, count): hits in each of several ranges, which may overlap; one pass."""
    holds = [(F.exists(value, b.holds) if multi_valued else b.holds(F.col(value))) for b in buckets]
    row = hits.agg(*[F.count_if(h).alias(f"c{i}") for i, h in enumerate(holds)])
    return _unpivot(row, [b.label for b in buckets])


def range_on_range(hits: DataFrame, lows: list[str], highs: list[str], queries: list[tuple[str, list, list]], relation: str) -> DataFrame:
    """(label, position, count): hits whose stored range relates to each query's (label, low, high)."""
    row = hits.agg(*[F.count_if(range_relation([F.col(c) for c in lows], [F.col(c) for c in highs], a, b, relation)).alias(f"c{i}") for i, (_, a, b) in enumerate(queries)])
    return _unpivot(row, [q[0] for q in queries])


def facet_sets(hits: DataFrame, tuples: str, matchers: list[tuple[str, list]]) -> DataFrame:
    """(label, position, count): hits with a tuple, in an array of structs, that matches: each dimension is a value, a (low, high) pair or None for any."""

    def holds(parts: list) -> Column:
        def one(t: Column) -> Column:
            out = F.lit(True)
            for i, p in enumerate(parts):
                c = t[f"d{i}"]
                if isinstance(p, tuple):
                    out = out & c.between(F.lit(min(p)), F.lit(max(p)))
                elif p is not None:
                    out = out & (c == F.lit(p))
            return out

        return F.exists(tuples, one)

    row = hits.agg(*[F.count_if(holds(p)).alias(f"c{i}") for i, (_, p) in enumerate(matchers)])
    return _unpivot(row, [m[0] for m in matchers])


def drill_down(hits: DataFrame, filters: list[tuple[str, list]], any_of: bool = True) -> DataFrame:
    """Hits that pass every dimension's filter: any of its labels, or all of them (any_of=False) as repeated clauses demand."""
    for dim, labels in filters:
        hits = hits.where(F.col(dim).isin(*labels)) if any_of else functools.reduce(lambda h, x, d=dim: h.where(F.col(d) == x), labels, hits)
    return hits


def drill_sideways(hits: DataFrame, filters: dict[str, list], dims: list[str]) -> DataFrame:
    """(dim, label, count): each dimension is counted over hits that pass all filters but its own, in one pass."""
    passes = {d: F.col(d).isin(*v) for d, v in filters.items()}

    def others(dim: str) -> Column:
        return functools.reduce(Column.__and__, [F.coalesce(p, F.lit(False)) for d, p in passes.items() if d != dim], F.lit(True))

    entries = F.explode(F.array(*[F.when(others(d), F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("label"))) for d in dims])).alias("e")
    return hits.select(entries).where("e is not null and e.label is not null").groupBy("e.dim", "e.label").agg(F.count("*").alias("count"))


def sampled(hits: DataFrame, dim: str, n: int, seed: int = 0, key: str = "doc_id", exact: bool = False) -> DataFrame:
    """(label, count): counts over a sample of about n hits, taken by a hash of their key, scaled up to all. No more than n hits are all counted.

    exact: an estimate for more than n hits won't do; the counts are those of all hits, in one pass.
    """
    if exact:
        return counts(hits, dim)
    total = hits.count()
    if total <= n:
        return counts(hits, dim)
    sample = hits.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int((1 << 30) * n / total))
    return counts(sample, dim).select("label", F.round(F.col("count") * (total / max(1, sample.count()))).cast("long").alias("count"))


def histogram(hits: DataFrame, value: str, width: int, max_buckets: int = 1024) -> DataFrame:
    """(bucket, count) by floor(value / width); more than max_buckets buckets are an error."""
    if width < 2:
        raise ValueError("the width must be at least 2")
    out = hits.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).cast("long").alias("bucket")).agg(F.count("*").alias("count"))
    over = F.count("*").over(Window.partitionBy(F.lit(1)))
    checked = out.withColumn("_n", over)
    return checked.select(F.when(F.col("_n") > max_buckets, F.raise_error(F.lit(f"more than {max_buckets} buckets")).cast("long")).otherwise(F.col("bucket")).alias("bucket"), "count")


def cut_and_record(hits: DataFrame, cut: Column, **recorders: Column) -> DataFrame:
    """(ordinal, ...): any cutter expression with any recorders (aggregates)."""
    return hits.withColumn("ordinal", cut).where("ordinal is not null").groupBy("ordinal").agg(*[c.alias(n) for n, c in recorders.items()])


def overlapping_ranges(hits: DataFrame, value: str, buckets: list[RangeBucket], **recorders: Column) -> DataFrame:
    """(ordinal, ...): recorders over the hits of each range; a hit counts in every range that holds it."""
    which = F.explode(F.filter(F.array(*[F.when(b.holds(F.col(value)), F.lit(i)) for i, b in enumerate(buckets)]), lambda x: x.isNotNull()))
    return hits.withColumn("ordinal", which).groupBy("ordinal").agg(*[c.alias(n) for n, c in recorders.items()])


def stats(hits: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return hits.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.count(v).alias("count"), F.avg(v).alias("mean"))


def high_frequency_terms(terms: DataFrame, n: int | None = None, min_df: int = 0, by: str = "df") -> DataFrame:
    """The terms (term, df, ttf) with the largest df or ttf."""
    out = terms.where(F.col("df") > min_df).orderBy(F.desc(by), "term")
    return out if n is None else out.limit(n)


def rollup(hits: DataFrame, *dims: str) -> DataFrame:
    return hits.rollup(*dims).agg(F.count("*").alias("count"))


def cube(hits: DataFrame, *dims: str) -> DataFrame:
    return hits.cube(*dims).agg(F.count("*").alias("count"))
