"""Exact top-k inner-product search with a pivot table.

Queries meet all candidates in a grid of blocks of queries and shards of candidates, each of
bounded size. A shard has the distances of its vectors to many pivots. Its vectors are ordered by
their nearest pivot and cut into runs; the triangle inequality gives for a query and each pivot a
lower bound of the distance to a run, and the largest of them an upper bound of its inner
products. A query evaluates runs in the order of its own bounds until its k-th best score is
above all that remain, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release

K = 20
PIVOTS = 64
#: Queries and candidates meet in groups of at most so many vectors of each, on average.
QUERY_BLOCK = 16_384
SHARD = 65_536
#: Shards for each core, if there are few candidates.
PER_CORE = 3
#: Candidates that are bounded, and evaluated, together.
RUN = 128


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as double, of vectors without null or non-finite components and with a non-null id."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The matrix of a column of lists of one length."""
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), len(values) // max(1, len(column)))


def best_of(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among their row's k best, copies counted, in order: by row, falling score and rising id."""
    order = np.lexsort((ids, -scores, rows))
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    before = np.cumsum(copies[order]) - copies[order]
    start = np.repeat(before[first], np.diff(np.append(first, len(order))))
    return order[before - start < k]


class PivotTable:
    """A shard of vectors and its distances to pivots, which are the shard's own vectors, far apart."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, copies: np.ndarray | None = None, pivots: int = PIVOTS, run: int = RUN):
        far, at, table, chosen = np.full(len(x), np.inf), 0, [], []
        square = np.einsum("ij,ij->i", x, x)
        for _ in range(min(pivots, len(x))):
            p = x[at]
            d = np.sqrt(np.maximum(0, square + square[at] - 2 * (x @ p)))
            table.append(d)
            chosen.append(p)
            far = np.minimum(far, d)
            at = int(far.argmax())
        table = np.array(table).reshape(len(chosen), len(x))
        near = table.argmin(0) if len(x) else np.zeros(0, int)
        order = np.lexsort((table[near, np.arange(len(x))], near))
        self.ids, self.x, self.square = ids[order], x[order], square[order]
        self.copies = np.ones(len(x), np.int64) if copies is None else copies[order]
        self.pivots = np.array(chosen).reshape(len(chosen), x.shape[1])
        self.cuts = np.arange(0, len(x), run)
        self.low, self.high = (f.reduceat(table[:, order], self.cuts, axis=1) for f in (np.minimum, np.maximum)) if len(x) else (np.zeros((0, 0)),) * 2
        self.most = np.maximum.reduceat(self.square, self.cuts) if len(x) else np.zeros(0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No inner product of a query (row) with a run (column) is above this."""
        square = np.einsum("ij,ij->i", q, q)
        to = np.sqrt(np.maximum(0, square[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots) - 2 * q @ self.pivots.T))
        gap = np.zeros((len(q), len(self.cuts)))
        for p in range(len(self.pivots)):
            np.maximum(gap, np.maximum(self.low[p] - to[:, p : p + 1], to[:, p : p + 1] - self.high[p]), out=gap)
        return (square[:, None] + self.most - np.maximum(0, gap - 1e-6) ** 2) / 2 + 1e-3  # above rounding of the distances

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(row, id, score, copies) of the k best of each query, and how many inner products were computed. Ties go to the smaller id; a query's own id is left out."""
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        kth = np.full(len(q), -np.inf)
        rows, ids, scores, copies = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        seen, every = 0, np.arange(len(q))
        for r in range(len(self.cuts)):
            at = order[:, r]
            open_ = every[bound[every, at] >= kth]  # the rest have stopped: their further bounds are lower still
            if not len(open_):
                break
            found = [(rows, ids, scores, copies)]
            by_run = open_[np.argsort(at[open_], kind="stable")]
            edges = np.flatnonzero(np.diff(at[by_run], prepend=-1))
            for own in np.split(by_run, edges[1:]):
                c = self.cuts[at[own[0]]]
                part = slice(c, c + (self.cuts[1] - self.cuts[0] if len(self.cuts) > 1 else len(self.x)))
                s = q[own] @ self.x[part].T
                seen += s.size
                i, j = np.nonzero((s >= kth[own][:, None]) & (self.ids[part][None] != query_ids[own][:, None]))
                found.append((own[i], self.ids[part][j], s[i, j], self.copies[part][j]))
            rows, ids, scores, copies = (np.concatenate(c) for c in zip(*found, strict=True))
            kept = best_of(rows, ids, scores, copies, k)
            rows, ids, scores, copies = rows[kept], ids[kept], scores[kept], copies[kept]
            full = np.bincount(rows, weights=copies, minlength=len(q)) >= k
            last = np.append(np.flatnonzero(np.diff(rows)), len(rows) - 1) if len(rows) else np.zeros(0, int)
            kth[rows[last]] = np.where(full[rows[last]], scores[last], -np.inf)
        return rows, ids, scores, copies, seen


def search(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `vectors` for each of `queries`, both (vec_id, v).

    Blocks of queries and shards of candidates are dealt out by hash and meet in a task for each
    pair, which gives k rows for a query at most; those are merged. Nothing goes through the
    driver. Equal scores go to the smaller id; a candidate with the query's own id is not one.
    Repeated rows of one id and vector are one query, and candidates each; one id with several
    vectors is as many queries, each with its own ranks. Vectors of other lengths aren't compared.
    No rows, no result.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n, m = vectors.count(), queries.count()
    shards = max(-(-n // shard), min(PER_CORE * cores, -(-n // 1024)), 1)
    blocks = max(1, -(-m // query_block))
    size = F.size("v").alias("d")
    own = queries.groupBy("vec_id", "v").agg(F.lit(1)).select(size, F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).alias("block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), "vec_id", "v", F.xxhash64("v").alias("h"))
    all_ = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).select(size, F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(shards)).alias("shard"), "vec_id", "v", "copies")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = ids = scores = copies = np.zeros(0, np.int64)
        qid = h = np.zeros(0, np.int64)
        if len(left) and len(right):
            table = PivotTable(left["vec_id"].to_numpy(), _vectors(left["v"]), left["copies"].to_numpy())
            qid, h = right["vec_id"].to_numpy(), right["h"].to_numpy()
            rows, ids, scores, copies, _ = table.top(qid, _vectors(right["v"]), k)
        out = pa.table({"query_id": pa.array(qid[rows], pa.int64()), "h": pa.array(h[rows], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores.astype(np.int64)), "copies": pa.array(np.minimum(copies, k))})
        release()
        return out

    keys = ("d", "block", "shard")
    best = all_.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(run, "query_id long, h long, vec_id long, score long, copies long")
    best = best.select("query_id", "h", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    w = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_neighbours(embeddings: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """The query: rows whose id is divisible by `every` against all rows. Vectors that are null or hold null or non-finite components, and null ids, take no part."""
    v = quantised(embeddings)
    return search(v, v.where(F.col("vec_id") % every == 0), k)


SQL = """
with v as (
  select vec_id, [floor(64 * x::double)::bigint for x in embedding] as v
  from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, q.v as q, c.vec_id as vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint as score
  from (select distinct vec_id, v from v where vec_id % 20 = 0) q join v c on c.vec_id <> q.vec_id and len(q.v) = len(c.v)
), r as (
  select *, row_number() over (partition by query_id, q order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""
