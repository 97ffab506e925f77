"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Texts handled by one vectorised step hold at most about so many bytes (a longer text is a step of its own).
STEP_BYTES = 1 << 20
#: Spark's setting for the bytes of an Arrow batch, and its value where the session has none.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and there is but one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, with its lineage cut: a lost executor loses nothing, and the shuffles that led to it are given up."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    forget_shuffles(out.sparkSession)
    return out


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that no plan refers to any more: it does so when the driver collects garbage, which may else be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeatable(df: DataFrame) -> DataFrame:
    """df in a form that gives the same rows in the same order whenever it is read: checkpointed, unless it is a plain scan."""
    plan = df._jdf.queryExecution()
    if plan.optimizedPlan().deterministic() and "Exchange" not in plan.executedPlan().toString():
        return df
    return checkpointed(df)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names in any letter case: an operator's own output replaces them."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def map_columns(df: DataFrame, column: str, added: str, make: Callable[[], Callable], keep: list[str] | None = None, step: int = STEP_BYTES) -> DataFrame:
    """df (or its columns `keep`) with the columns `added` (DDL), computed from `column` by Arrow batch.

    `make()` is called once in each task and returns a function from an array to a list of result
    arrays. Batches are cut so that one call sees about `step` bytes at most. Only `column` goes to
    the Python worker and only the results come back: all else stays in the JVM.
    """
    bound_batches()
    new = StructType.fromDDL(added)
    df = without(df, *new.names)
    kept = df.columns if keep is None else keep

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        try:
            for whole in batches:
                out = [pa.StructArray.from_arrays(fn(batch), names=new.names) for batch in pieces(whole, step)]
                yield pa.concat_arrays(out) if out else pa.array([], pa.struct([(f.name, to_arrow_type(f.dataType)) for f in new.fields]))
        finally:
            release()

    # Not deterministic as far as the optimiser is told: it would else run the function once for a filter and again for a projection.
    fn = F.arrow_udf(run, new).asNondeterministic()
    own = "computed_"
    while own in map(str.lower, df.columns):
        own += "_"
    out = df.withColumn(own, fn(F.col(f"`{column}`")))
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(own)[f.name].alias(f.name) for f in new.fields])


def bound_batches() -> None:
    """Bounds Arrow batches by bytes, unless the session does already: batches are else of 10,000 rows, however long."""
    spark = SparkSession.getActiveSession()
    if spark and spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def released(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of Arrow batches, of bounded size, that calls release() at the task's end."""
    bound_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def own_columns(df: DataFrame, *inputs: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with `text` (and other `inputs`) under their names and all else under names that clash with nothing; and the way back."""
    inputs = ("text", *inputs)
    name = {c: c if c in inputs else f"own_{i}" for i, c in enumerate(df.columns)}
    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in name.items()])
    return inner, lambda out: out.select(*[F.col(n).alias(c) for c, n in name.items()])


def release() -> None:
    """Gives memory that a task has freed back to the machine: workers live on, and the next stage's find it taken else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch | pa.Array, most: int = STEP_BYTES) -> Iterator:
    """The batch in slices of about `most` bytes."""
    if not len(batch):
        return
    rows = max(1, int(len(batch) * most / max(1, batch.nbytes)))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Random numbers for each byte at each of 64 places.
_RANDOM = np.random.default_rng(20240607).integers(0, 1 << 64, 64 * 256, dtype=np.uint64, endpoint=False)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin: text i has those from cuts[i] to cuts[i + 1].

    Words are runs without ASCII white space. A word's hash is the sum of a random number for each
    byte at its place (tabulation hashing), computed for all bytes at once.
    """
    texts = [t or b"" for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    starts, n = edge[::2], edge[1::2] - edge[::2]
    cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(starts):
        return np.zeros(0, np.uint64), cuts
    first = np.cumsum(n) - n
    b = buf[inside]
    place = np.arange(len(b), dtype=np.int64) - np.repeat(first, n)
    each = _RANDOM[((place & 63) << 8) | b]
    far = np.flatnonzero(place > 63)
    if len(far):
        each[far] *= (2 * (place[far] >> 6) + 1).astype(np.uint64)
    return np.add.reduceat(each, first), cuts


START, END = np.uint64(1), np.uint64(2)


def sequences(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(s, start, n): the word hashes of all texts in a row, each text with order - 1 starts before and an end behind.

    Text i has n[i] words and begins at start[i]; one without words isn't there.
    """
    h, cuts = word_hashes(texts)
    n = np.diff(cuts)
    size = np.where(n > 0, n + order, 0)
    start = np.cumsum(size) - size
    s = np.full(int(size.sum()), START)
    s[np.arange(len(h)) - np.repeat(cuts[:-1], n) + np.repeat(start + order - 1, n)] = h
    s[(start + size - 1)[n > 0]] = END
    return s, start, n


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the finaliser of splitmix64)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive word hashes; of the whole sequence if it is shorter, none if it is empty."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    last = len(words) - n + 1
    h = np.full(last, np.uint64(n))
    for k in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += words[k : k + last]
        h ^= h >> np.uint64(29)
    return mix(h)


class HashTable:
    """uint64 keys to positions: open addressing over numpy arrays, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        size = 1 << self.bits
        self.slot = np.full(size, -1, np.int32)
        self.keys = keys
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of those that want one slot, the last gets it
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & (size - 1)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys) or not len(h):
            return out
        left, at, mask = np.arange(len(h)), self._home(h), (1 << self.bits) - 1
        while len(left):
            s = self.slot[at]
            there = s >= 0
            left, at, s = left[there], at[there], s[there]
            hit = self.keys[s] == h[left]
            out[left[hit]] = s[hit]
            left, at = left[~hit], (at[~hit] + 1) & mask
        return out


def unit_hash(*columns: str):
    """A number in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(1 << 30)) / F.lit(float(1 << 30))


def window(text: Column, chars: int) -> Column:
    """A text, or of a longer one so many characters from a place that a hash of doc_id gives."""
    start = F.pmod(F.xxhash64(F.lit("window"), F.col("doc_id")), F.greatest(F.length(text) - chars, F.lit(0)).cast("long") + 1).cast("int") + 1
    return F.when(F.length(text) > chars, F.substring(text, start, F.lit(chars))).otherwise(text)


def binary(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the edge set stays
    the same; every step is a pair of shuffles on node ids and is checkpointed. Groups are
    aggregated, never collected, so that a large component is no large task.
    """
    cur = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        cur = checkpointed(small)
        sums = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
