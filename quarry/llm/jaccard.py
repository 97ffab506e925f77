"""Exact n-gram Jaccard join with set-relation skipping.

A text's set holds the hashes of its distinct word shingles; texts with one set are one class
and are joined once. The prefix of a set under a global order (rarer shingles first) goes into
index lists. A list is cut by set size into blocks that no qualifying pair crosses, blocks of
one set are skipped, and entries whose position leaves too few shingles behind are skipped too.

What remains is gathered around centres: every set chooses the first set of its longest block,
and meets there all sets that share a block with one that chose the same. Around a centre a
set's overlaps with all others are derived from those of a very similar set already computed,
by walking the lists of only those shingles in which the two differ. Only links that join two
groups are passed on, so that a group of many copies gives as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HashTable, binary, checkpointed, connected_components, forget_shuffles, map_columns, ngram_hashes, pieces, released, word_hashes

SHINGLE = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Of all shingles, those with hashes in the first COUNTED eighths come first in the order and are counted; of short sets all are.
COUNTED = 3
SHORT = 64
#: Only shingles of so many texts are told apart by their count, and at most so many shingles: the order decides about speed, never about results.
FREQUENT = 16
MAX_FREQUENT = 1 << 20
#: Around a centre so many sets are compared at once; more are dealt out in pairs of blocks.
BLOCK = 1500
#: ... and sets of so many shingles in all, on average.
BLOCK_SHINGLES = 4_000_000
#: Tasks that share the sets of one centre when they are joined to its size.
SALTS = 16
#: Up to so many ids of sets are broadcast to skip others when sets are read again; beyond, all are read and joined.
MAX_NEEDED = 2_000_000


def shingle_sets(texts: list[bytes | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of n-word shingles; fewer words make one shingle, none an empty set."""
    h, cuts = word_hashes([t and t.lower() for t in texts])
    grams = ngram_hashes(h, n)
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        s = np.sort(grams[a : b - n + 1]) if b - a >= n else ngram_hashes(h[a:b], n)
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def set_id(tokens: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def _sets(batches: Iterator[pa.RecordBatch], column: int, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for batch in pieces(whole):
            yield batch, shingle_sets(binary(batch.column(column)), n)


def members(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, set_id, n_shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, 1, n):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "set_id", "n_shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, set_id long, n_shingles long")


def _first(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(61)) < COUNTED


def frequent(docs: DataFrame, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, counted over all texts, and their counts: at most MAX_FREQUENT, by a threshold that the counts' histogram gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, 0, n):
            kept = [s if len(s) <= SHORT else s[_first(s)] for s in sets]
            t, c = np.unique(np.concatenate([*kept, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], names=["t", "c"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(released(run), "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT).persist()
    left, least = MAX_FREQUENT, None
    # The histogram has at most as many rows as there are different counts; the largest counts are few.
    for r in counts.groupBy(F.floor(F.log2("c") * 8).alias("b")).agg(F.count("*").alias("k"), F.min("c").alias("least")).orderBy(F.desc("b")).collect():
        if r["k"] > left:
            break
        left, least = left - r["k"], r["least"]
    table = counts.where(F.col("c") >= least).toArrow() if least else None
    counts.unpersist()
    del counts
    forget_shuffles(docs.sparkSession)
    if table is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return table["t"].combine_chunks().to_numpy().view(np.uint64), table["c"].combine_chunks().to_numpy()


def postings(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(t, s, n, pos): shingle, set, its size and the shingle's position, for each set's prefix."""
    keys, counts = frequent(docs, n)
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts))  # at most 16 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        table = HashTable(keys)
        counts = np.concatenate([counts, [0]])  # for those not found, at -1
        seen: set[int] = set()
        for _, sets in _sets(batches, 0, n):
            out: list[tuple] = []
            if len(seen) > 500_000:
                seen.clear()
            for s in sets:
                sid = set_id(s)
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                size = len(s)
                prefix = size - (percent * size + 99) // 100 + 1
                own = s[_first(s)]
                if len(own) < prefix:
                    own = s
                order = np.lexsort((own, counts[table.find(own)], ~_first(own)))[:prefix]
                out.append((own[order], np.full(prefix, sid), np.full(prefix, size), np.arange(prefix)))
            if out:
                t, s_, m, p = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(s_.astype(np.int64)), pa.array(m.astype(np.int32)), pa.array(p.astype(np.int32))], names=["t", "s", "n", "pos"])

    return docs.select(F.col("text").cast("string")).mapInArrow(released(run), "t long, s long, n int, pos int")


def blocks(index: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(t, seg, s, n, rest, centre, size): the index without what can be skipped; seg numbers a list's blocks by set size."""
    near = lambda small, large: F.col(small).cast("long") * 100 >= F.col(large).cast("long") * percent
    w = Window.partitionBy("t").orderBy("n", "s")
    x = index.select("*", F.lag("n").over(w).alias("pn"), F.lag("s").over(w).alias("ps"), F.lead("n").over(w).alias("nn"))
    x = x.where(F.coalesce(near("pn", "n"), F.lit(False)) | F.coalesce(near("n", "nn"), F.lit(False)))
    x = x.where(F.col("ps").isNull() | (F.col("ps") != F.col("s")))
    x = x.withColumn("seg", F.sum(F.when(F.coalesce(near("pn", "n"), F.lit(False)), 0).otherwise(1)).over(w))
    b = Window.partitionBy("t", "seg")
    x = x.select("t", "seg", "s", "n", (F.col("n") - F.col("pos") - 1).alias("rest"), F.min("s").over(b).alias("centre"), F.count("*").over(b).alias("size"))
    return x.where("size > 1")


def gatherings(kept: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(centre, s, own, n): the sets that meet around each centre, and their sizes; own: the set chose it."""
    choice = kept.groupBy("s").agg(F.max_by("centre", F.struct("size", "centre")).alias("chosen"), F.max("n").alias("n_own"))
    by_list = kept.drop("centre", "size").join(choice.drop("n_own"), "s")
    groups = by_list.groupBy("t", "seg", "chosen").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("most"))
    need = F.ceil((F.col("n") + F.greatest("lo", F.ceil(F.col("n") * (percent / 100)))) * (percent / (100.0 + percent)) - 1e-6)
    y = kept.select("t", "seg", "s", "n", "rest").join(groups, ["t", "seg"])
    y = y.where((F.col("n") * 100 >= F.col("lo") * percent) & (F.col("n") * percent <= F.col("hi") * 100) & (1 + F.least("rest", "most") >= need))
    guests = y.select(F.col("chosen").alias("centre"), "s", F.lit(0).alias("own"), "n")
    own = choice.select(F.col("chosen").alias("centre"), "s", F.lit(1).alias("own"), F.col("n_own").alias("n"))
    return guests.union(own).groupBy("centre", "s").agg(F.max("own").alias("own"), F.max("n").alias("n"))


def sets_of(docs: DataFrame, needed: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(s, tokens): the sets with the ids in `needed`, as bytes."""
    few = needed.count() <= MAX_NEEDED
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(needed.toArrow()["s"].combine_chunks().to_numpy()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(shared.value.tolist()) if shared.value is not None else None
        given: set[int] = set()
        for _, sets in _sets(batches, 0, n):
            rows = []
            if len(given) > 500_000:
                given.clear()
            for s in sets:
                sid = set_id(s)
                if sid is not None and sid not in given and (wanted is None or sid in wanted):
                    given.add(sid)
                    rows.append((sid, s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["s", "tokens"])

    out = docs.select(F.col("text").cast("string")).mapInArrow(released(run), "s long, tokens binary")
    return (out if few else out.join(needed, "s", "left_semi")).groupBy("s").agg(F.first("tokens").alias("tokens"))


class Links:
    """Groups joined by links; add() tells whether a link joins two."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def add(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links_around(sets: list[np.ndarray], own: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets of which one at least is `own`, in different sides if there are two: enough of them to join what any of them joins."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        c = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * c >= percent * (sizes[0] + sizes[1] - c) else []
    flat, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1  # only these can be in two sets
    number = np.cumsum(shared) - 1
    holder = np.repeat(np.arange(m), sizes)
    keep = shared[inverse]
    tokens, holder = number[inverse[keep]], holder[keep]
    at = np.searchsorted(holder, np.arange(m + 1))
    local = [tokens[at[i] : at[i + 1]] for i in range(m)]
    order = np.argsort(tokens, kind="stable")
    lists, start = holder[order], np.searchsorted(tokens[order], np.arange(int(shared.sum()) + 1))
    two = len(np.unique(side)) > 1

    def walked(t: np.ndarray) -> np.ndarray:
        lo, size = start[t], start[t + 1] - start[t]
        total = int(size.sum())
        if not total:
            return np.zeros(m, np.int64)
        within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        return np.bincount(lists[np.repeat(lo, size) + within], minlength=m)

    joined, out = Links(m), []
    known: list[tuple[np.ndarray, np.ndarray]] = []  # sets with computed answers
    inside = np.zeros(int(shared.sum()) + 1, bool)
    for x in np.lexsort((sizes, ~own.astype(bool))):
        if not own[x]:
            break
        mine = local[x]
        inside[mine] = True
        best = None
        for tokens_y, answers in known:
            both = int(inside[tokens_y].sum())
            differ = len(mine) + len(tokens_y) - 2 * both
            if best is None or differ < best[0]:
                best = (differ, tokens_y, answers)
        if best and best[0] * 2 < len(mine):  # derived: only where the two sets differ
            _, y, answers = best
            gone = y[~inside[y]]
            inside[mine] = False
            inside[y] = True
            new = mine[~inside[mine]]
            inside[y] = False
            c = answers - walked(gone) + walked(new)
            remember = best[0] * 6 > len(mine)
        else:
            inside[mine] = False
            c = walked(mine)
            remember = True
        if remember:
            known = [*known[-5:], (mine, c)]
        hit = 100 * c >= percent * (sizes[x] + sizes - c)
        hit[x] = False
        if two:
            hit &= side != side[x]
        out += [(int(x), int(y)) for y in np.flatnonzero(hit) if joined.add(int(x), int(y))]
    return out


def links(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between sets, enough of them to join all that are reachable from each other."""
    kept = checkpointed(blocks(postings(docs, n, percent), percent))
    meet = checkpointed(gatherings(kept, percent))
    del kept
    forget_shuffles(docs.sparkSession)  # and the checkpoint of the index
    # Counts by centre, a copy for each salt: a centre with very many sets is joined in as many tasks.
    salt = F.pmod(F.xxhash64(F.lit("salt"), "s"), F.lit(SALTS)).cast("int")
    sizes = meet.groupBy("centre").agg(F.count("*").alias("m"), F.sum(F.col("n").cast("long")).alias("total")).where("m > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    meet = meet.withColumn("salt", salt).join(sizes, ["centre", "salt"]).drop("salt")
    tokens = sets_of(docs, meet.select("s").distinct(), n)
    nb = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    meet = meet.withColumn("side", F.pmod(F.xxhash64("s"), nb).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
    meet = meet.select("centre", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "s", "own", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def solve() -> None:
            if len(rows) > 1:
                found = links_around([np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[1] for r in rows]), np.array([r[3] for r in rows]), percent)
                out.extend((rows[a][0], rows[b][0]) for a, b in found)
            rows.clear()

        for batch in batches:
            for c, i, j, s, own, side, t in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (c, i, j) != key:
                    solve()
                    key = (c, i, j)
                rows.append((s, own, t, side))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out.clear()
        solve()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    together = meet.join(tokens, "s").select("centre", "i", "j", "s", "own", "side", "tokens").repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "s")
    return together.mapInArrow(released(run), "a long, b long")


def _rooted(own: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(set_id, least, root): each set's smallest doc_id, and the set that names the component."""
    roots = connected_components(links(docs, n, percent))
    classes = own.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    return classes.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root"))


def components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs.

    component_id is the smallest doc_id reachable by links. Texts that are null or have no words
    have an empty set and are linked with nothing. Rows with a null id take part in links but
    name no component, unless nothing else does: then it is null. Sets are told apart by 64-bit
    hashes of their 64-bit shingle hashes.
    """
    own = checkpointed(members(docs, n))
    rooted = _rooted(own, docs, n, percent)
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_set = rooted.where(F.col("root").isNotNull()).join(named, "root").select("set_id", "component")
    return own.join(by_set, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, with their own columns, one row of each component: that with the smallest (doc_id, set), null ids last.

    Rows without words are linked with nothing: one stays for each id, and all whose id is null.
    """
    rooted = _rooted(members(docs, n), docs, n, percent)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "set_id")).alias("x")).select("x.set_id", "x.least")
    words = F.coalesce(F.col("text").cast("string").rlike(r"[^\x09-\x0D ]"), F.lit(False))
    own = "near_set"
    while own in map(str.lower, docs.columns):
        own += "_"
    marked = map_columns(docs.where(words), "text", f"{own} long", lambda: lambda texts: [pa.array([set_id(s) for s in shingle_sets(binary(texts), n)], pa.int64())])
    # The join and the choice of one of several equal rows deal by the same keys: texts are shuffled once.
    doc_id = F.col("doc_id").cast("long")
    marked = marked.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(own).alias("set_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"))
    keys = ["set_id", "id", "none"]
    chosen = marked.join(first.select("set_id", F.coalesce("least", F.lit(0)).alias("id"), F.col("least").isNull().alias("none")), keys, "left_semi").dropDuplicates(keys)
    bare = docs.where(~words)
    return chosen.select("row.*").union(bare.where("doc_id is not null").dropDuplicates(["doc_id"])).union(bare.where("doc_id is null"))
