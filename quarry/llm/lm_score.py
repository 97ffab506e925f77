"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

The corpus is cut into blocks of documents. A block's distinct n-grams with their counts are a
row for each shard of the count tables, which are partitioned by hash: sorted hashes, packed, as
rows of single n-grams take more disk than the check tool allows (see the README). A shard adds
up the counts of all blocks and joins them back to each block's n-grams, by merging sorted arrays
as a merge join does. The block then sums its documents' scores. A frequent n-gram is one entry a
block, never one an occurrence; packed rows are never more than the n-grams they hold, whose
number grows with the corpus.

S(w | u v) = c(u v w) / c(u v) if c(u v w) > 0, else ALPHA * S(w | v), down to unigrams,
c(w) / N, and to 1 / N for a word that no other document has. Counts leave out the document's own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import START, binary, mix, released, repeatable, sequences

ORDER = 3
ALPHA = 0.4
#: A block holds documents of about so many bytes.
BLOCK_BYTES = 12 << 20
#: A shard of the count tables holds the n-grams of about so many bytes of corpus.
SHARD_BYTES = 12 << 20

@dataclass
class Grams:
    """The n-grams of several texts: keys[n - 1][first[i] : first[i] + words[i] + 1] are those of n words that end at text i's words and its end; before[n - 1] is that of n starts."""

    keys: list[np.ndarray]
    before: list[np.uint64]
    first: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None], order: int) -> Grams:
        s, start, n = sequences(texts, order)
        last, c = order - 1, np.uint64(0x9E3779B97F4A7C15)
        keys, before = [], []
        h, b = np.zeros(max(0, len(s) - last), np.uint64), np.zeros(1, np.uint64)
        for k in range(1, order + 1):  # from the last word backwards
            h = mix(h * c + s[last - k + 1 : len(s) - k + 1] + np.uint64(k))
            b = mix(b * c + START + np.uint64(k))
            keys.append(h)
            before.append(b[0])
        return cls(keys, before, start, n)

    def flat(self) -> np.ndarray:
        """All n-grams of all texts, then the contexts of starts alone, once for each text with words. The n-grams between two texts are left out."""
        size = np.where(self.words > 0, self.words + 1, 0)
        at = np.repeat(self.first, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        starts = [np.full(int((self.words > 0).sum()), b, np.uint64) for b in self.before[:-1]]
        return np.concatenate([*(k[at] for k in self.keys), *starts])


def pack(a: np.ndarray) -> bytes:
    """Sorted hashes by their differences, or counts, without the bytes that are zero throughout."""
    a = np.ascontiguousarray(a, np.uint64)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T  # byte by byte: high bytes compress
    return struct.pack("<IB", len(a), width) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=max(1, n * width)), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).reshape(n)


def pack_sorted(h: np.ndarray) -> bytes:
    return pack(np.diff(h, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class Blocks:
    """Cuts a task's rows into blocks, each with a key of its place and contents: a block that was cut otherwise when the input was read again has no counterpart."""

    def __init__(self):
        self.task, self.number = TaskContext.get().partitionId(), 0

    def __call__(self, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
        held, size = [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
            lo = 0
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= BLOCK_BYTES:
                    held.append(batch.slice(lo, i + 1 - lo))
                    yield self._key(held, column), held
                    held, size, lo = [], 0, i + 1
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
        if held:
            yield self._key(held, column), held

    def _key(self, held: list[pa.RecordBatch], column: int) -> int:
        self.number += 1
        digest = xxhash.xxh64(f"{self.task} {self.number}")
        for b in held:
            for t in binary(b.column(column)):
                digest.update(b"\xff" if t is None else t + b"\xfe")
        return digest.intdigest() - (1 << 63)


def _arrays(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns.values()], names=list(columns))


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, score, per_word): one row per document.

    `score` is the sum of natural logarithms over the words and the end, `per_word` their mean. A
    null or wordless text has no words and null scores. Repeated rows are documents of their own,
    each counted for the others. An n-gram's context counts the same positions as the n-gram.
    """
    docs = repeatable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    size, tokens = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(n_words), F.lit(0))).first()
    shards = max(4, -(-size // SHARD_BYTES))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's distinct n-grams in a row for each shard."""
        for block, held in Blocks()(batches, 1):
            h, c = np.unique(Grams.of([t for b in held for t in binary(b.column(1))], order).flat(), return_counts=True)
            cut = np.searchsorted(h, (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)) if shards > 1 else np.zeros(0, int)
            edges = [0, *cut.tolist(), len(h)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if b > a:
                    yield _arrays({"shard": ([k], pa.int64()), "block": ([block], pa.int64()), "hashes": ([pack_sorted(h[a:b])], pa.binary()), "counts": ([pack(c[a:b])], pa.binary())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's rows stand together: all blocks' n-grams are merged and counted, and each block gets the counts in the order of its n-grams."""
        key, held = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            own = [unpack_sorted(h) for _, h, _ in held]
            distinct, at = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([unpack(c) for _, _, c in held]), minlength=len(distinct)).astype(np.uint64)
            lo = 0
            for (block, _, _), h in zip(held, own, strict=True):
                yield _arrays({"block": ([block], pa.int64()), "shard": ([key], pa.int64()), "counts": ([pack(total[at[lo : lo + len(h)]])], pa.binary())})
                lo += len(h)
            held.clear()

        for batch in batches:
            for shard, block, h, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if shard != key:
                    if held:
                        yield from solve()
                    key = shard
                held.append((block, h, c))
        if held:
            yield from solve()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in Blocks()(batches, 1):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            yield _arrays({"block": ([block], pa.int64()), "texts": ([sink.getvalue().to_pybytes()], pa.binary())})

    def last(back: pa.Table, own: pa.Table) -> pa.Table:
        """A block's counts from all shards and its texts."""
        if len(own) != 1:
            raise RuntimeError("the input gave other rows when it was read again")
        table = pa.ipc.open_stream(own["texts"][0].as_buffer()).read_all()
        grams = Grams.of(binary(table["text"].combine_chunks()) if table.num_rows else [], order)
        distinct, at = np.unique(grams.flat(), return_inverse=True)
        c = np.concatenate([*map(unpack, back.sort_by("shard")["counts"].to_pylist()), np.zeros(0, np.uint64)]).astype(np.int64)
        if len(c) != len(distinct):
            raise RuntimeError("the input gave other rows when it was read again")
        n = grams.words.tolist()
        s = score_texts(n, at, c, order, tokens)
        per = [x / (k + 1) if k else None for x, k in zip(s, n, strict=True)]
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n, pa.int64()), "score": pa.array(s, pa.float64()), "per_word": pa.array(per, pa.float64())})

    packed = docs.mapInArrow(released(first), "shard long, block long, hashes binary, counts binary").repartition(int(shards), "shard")
    back = packed.sortWithinPartitions("shard", "block").mapInArrow(released(joined), "block long, shard long, counts binary")
    whole = docs.mapInArrow(released(texts), "block long, texts binary")
    return back.groupBy("block").cogroup(whole.groupBy("block")).applyInArrow(last, "doc_id long, n_words long, score double, per_word double")


def score_texts(words: list[int], at: np.ndarray, counts: np.ndarray, order: int, tokens: int) -> list[float | None]:
    """The score of each text. at: for each n-gram of Grams.flat() its place in counts, the corpus's."""
    texts = sum(w > 0 for w in words)
    size = (len(at) - (order - 1) * texts) // order
    grams = [at[k * size : (k + 1) * size] for k in range(order)]
    starts = [int(counts[at[order * size + k * texts]]) - 1 if texts else 0 for k in range(order - 1)]
    out: list[float | None] = []
    lo = 0
    for w in words:
        if not w:
            out.append(None)
            continue
        hi = lo + w + 1
        others = []
        for g in grams:  # without this text's own
            own, inverse, n = np.unique(g[lo:hi], return_inverse=True, return_counts=True)
            others.append((counts[own] - n)[inverse])
        low = np.log(np.maximum(others[0], 1) / max(1, tokens - w))
        for k in range(1, order):
            # the context of an n-gram is the shorter one before it, or the starts alone, which stand once in each text
            before = np.maximum(np.concatenate([[starts[k - 1]], others[k - 1][:-1]]), 1)
            low = np.where(others[k] > 0, np.log(np.maximum(others[k], 1) / before), np.log(ALPHA) + low)
        out.append(float(low.sum()))
        lo = hi
    return out
