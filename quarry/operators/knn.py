"""Vector search: exact nearest neighbours, thresholds, diversity, hashing by angle and inverted lists."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import vectors as V
from .collect import top


def scores(docs: DataFrame, vector: str, query: Sequence[float], function: str = V.EUCLIDEAN, key: str = "doc_id", where: Column | None = None) -> DataFrame:
    """(doc_id, score) of every document with a vector, exactly."""
    docs = docs if where is None else docs.where(where)
    return docs.where(F.col(vector).isNotNull()).select(F.col(key).alias("doc_id"), V.similarity(F.col(vector), query, function).alias("score"))


def knn(docs: DataFrame, vector: str, query: Sequence[float], k: int, function: str = V.EUCLIDEAN, key: str = "doc_id", where: Column | None = None) -> DataFrame:
    """The k most similar documents among those `where` accepts. Each task keeps k, then they are merged."""
    return top(scores(docs, vector, query, function, key, where), k)


def seeded(docs: DataFrame, vector: str, query: Sequence[float], k: int, seeds: Column, function: str = V.EUCLIDEAN, key: str = "doc_id") -> DataFrame:
    """The k nearest, exactly: the k-th best score of the seeds, which are scored first, bounds those that are sorted."""
    rows = scores(docs, vector, query, function, key)
    first = scores(docs.where(seeds), vector, query, function, key).orderBy(F.desc("score")).limit(k).agg(F.count("*"), F.min("score")).first()
    return top(rows.where(F.col("score") >= first[1]) if first[0] == k else rows, k)


def knn_bytes(docs: DataFrame, vector: str, query: Sequence[int], k: int, function: str = V.EUCLIDEAN, key: str = "doc_id") -> DataFrame:
    s = V.byte_similarity(F.col(vector), [float(x) for x in query], function, len(query))
    return top(docs.where(F.col(vector).isNotNull()).select(F.col(key).alias("doc_id"), s.alias("score")), k)


def above(docs: DataFrame, vector: str, query: Sequence[float], least: float, function: str = V.EUCLIDEAN, key: str = "doc_id") -> DataFrame:
    """All documents at least so similar."""
    return scores(docs, vector, query, function, key).where(F.col("score") >= least)


def diversified(children: DataFrame, vector: str, query: Sequence[float], k: int, parent: str, function: str = V.EUCLIDEAN, key: str = "doc_id") -> DataFrame:
    """The k best children of different parents."""
    s = children.where(F.col(vector).isNotNull()).select(F.col(key).alias("doc_id"), F.col(parent).alias("parent"), V.similarity(F.col(vector), query, function).alias("score"))
    w = Window.partitionBy("parent").orderBy(F.desc("score"), "doc_id")
    return top(s.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r"), k)


def approximate(docs: DataFrame, vector: str, query: Sequence[float], k: int, planes: int = 8, probes: int = 2, key: str = "doc_id", function: str = V.COSINE) -> DataFrame:
    """The k best: first among documents whose signature differs from the query's in at most `probes` bits, then among the others that can still reach the k-th score found there.

    A vector on the other side of a plane is at least as far from the query, by angle, as the plane
    is; so a cosine has a bound by the bits that differ, and no document is missed. Other functions
    have no such bound: all documents are scored.
    """
    docs = docs.where(F.col(vector).isNotNull())
    length = math.sqrt(sum(x * x for x in query))
    if function != V.COSINE or not length:
        return knn(docs, vector, query, k, function, key)
    p = V.hyperplanes(len(query), planes)
    at = [sum(a * b for a, b in zip(plane, query, strict=True)) for plane in p]
    own = sum((1 << i) for i, x in enumerate(at) if x >= 0)
    differ = V.signature(F.col(vector), p).bitwiseXOR(F.lit(own).cast("long"))
    sines = [abs(x) / length / math.sqrt(sum(c * c for c in plane)) for x, plane in zip(at, p, strict=True)]
    sine = F.greatest(F.lit(0.0), *[F.when(differ.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(x)) for i, x in enumerate(sines)])
    marked = docs.withColumn("_differ", F.bit_count(differ)).withColumn("_most", (1 + F.sqrt(F.greatest(F.lit(0.0), 1 - sine * sine))) / 2 + 1e-9)
    near = knn(marked.where(F.col("_differ") <= probes), vector, query, k, function, key)
    # One row: the k-th score, or null if fewer were near, or if one of them has no score.
    kth = near.agg(F.when(F.count("score") == k, F.min("score")).alias("_kth"))
    rest = marked.where(F.col("_differ") > probes).join(F.broadcast(kth)).where("_kth is null or _most >= _kth")
    return top(near.union(scores(rest, vector, query, function, key)), k)


#: Giving up early on a graph's walk has no counterpart where every vector is read: the exact search.
patience = knn


@dataclass(frozen=True)
class Lists:
    """An inverted file of vectors: every row in the list of its nearest centre, in Parquet partitioned by list.

    Centres are fitted on at most `sample` rows, taken by a hash of the key; all rows are in a
    list. A list's radius is the largest distance of its vectors to its centre, so that no vector
    of it is nearer to a query than the centre's distance less the radius: search() with probes
    reads that many lists, nearest centres first, exact() reads on until that bound excludes the rest.
    """

    docs: DataFrame
    centres: list[list[float]]
    radius: dict[int, float]
    vector: str
    key: str

    @classmethod
    def build(cls, docs: DataFrame, path: str, vector: str, key: str = "doc_id", lists: int = 32, sample: int = 20_000, rounds: int = 10) -> Lists:
        spark = docs.sparkSession
        rows = docs.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>").alias(vector))
        total = rows.count()
        some = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, total)))).orderBy(key).toPandas()  # about `sample` rows
        centres = _fitted(np.array(some[vector].tolist(), float), lists, rounds)

        @F.pandas_udf("struct<list:int,far:double>")
        def nearest(v: pd.Series) -> pd.DataFrame:
            x = np.array(v.tolist(), float).reshape(len(v), centres.shape[1])
            d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T))
            return pd.DataFrame({"list": d.argmin(1).astype(np.int32), "far": d.min(1)})

        rows.withColumn("_at", nearest(vector)).select(key, vector, "_at.list", "_at.far").repartition("list").write.partitionBy("list").parquet(path)
        stored = spark.read.schema(StructType([*rows.schema.fields, StructField("far", DoubleType()), StructField("list", IntegerType())])).parquet(path)
        radius = {r["list"]: r["far"] for r in stored.groupBy("list").agg(F.max("far").alias("far")).collect()}  # one row a list
        return cls(stored, centres.tolist(), radius, vector, key)

    def _order(self, query: Sequence[float]) -> list[tuple[float, int]]:
        """(distance of the centre, list) of lists that hold rows, by distance."""
        return sorted((math.dist(query, c), i) for i, c in enumerate(self.centres) if i in self.radius)

    def search(self, query: Sequence[float], k: int, probes: int) -> DataFrame:
        """(doc_id, score) of the k nearest in the `probes` lists of the nearest centres, by Euclidean similarity. Other lists' files aren't read."""
        chosen = [i for _, i in self._order(query)[:probes]]
        return knn(self.docs.where(F.col("list").isin(*chosen)), self.vector, query, k, key=self.key)

    def reached(self, query: Sequence[float], k: int, first: int = 4) -> list[int]:
        """The lists that may hold one of the k nearest: what the `first` give bounds the distance of the k-th."""
        order = self._order(query)
        kth = self.search(query, k, first).agg(F.count("*"), F.min("score")).first()
        most = math.inf if kth[0] < k else math.sqrt(max(0.0, 1 / kth[1] - 1))  # similarity is 1 / (1 + distance squared)
        return [i for d, i in order if d - self.radius[i] <= most + 1e-9]

    def exact(self, query: Sequence[float], k: int, first: int = 4) -> DataFrame:
        """The k nearest of all; lists that can't hold one aren't read."""
        return knn(self.docs.where(F.col("list").isin(*self.reached(query, k, first))), self.vector, query, k, key=self.key)


def _fitted(x: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Centres by Lloyd's rounds from far-apart rows."""
    if not len(x):
        return np.zeros((1, 0))
    centres, far = [x[0]], ((x - x[0]) ** 2).sum(1)
    while len(centres) < min(lists, len(x)):
        centres.append(x[far.argmax()])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        own = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        for i in np.unique(own):
            c[i] = x[own == i].mean(0)
    return c
