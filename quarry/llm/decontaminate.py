"""Benchmark decontamination with suffix arrays over the training shards.

Every shard of documents gets a suffix array of its words; each suffix of each benchmark item
is found in it by binary search, which gives its longest verbatim match, and for the item's
windows the range of suffixes that start with them, hence all places. Words that no item holds
only part the shard into runs: a run too short for any window is left out of the array, which
loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, map_columns, own_columns, released

#: Words in a window; an item of fewer words, but not none, is one window.
WINDOW = 8
#: A document in which windows of so many items occur is contaminated.
MIN_ITEMS = 2
#: Benchmark text is held in blocks of about so many bytes; one block is in a worker's memory at a time.
BLOCK_BYTES = 8 << 20
#: A shard of documents, which gets a suffix array, has about so many bytes.
SHARD_BYTES = 4 << 20
#: Suffixes are sorted by so many words; longer matches are measured on the words themselves.
DEPTH = 16

#: A-Z to lower case; what is neither a letter, a digit nor beyond ASCII to a space.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z. None has none."""
    return text.translate(WORD_BYTES).split() if text else []


class SuffixArray:
    """The suffixes, in order, of a sequence of word numbers (0 and up), sorted by their first DEPTH words."""

    def __init__(self, words: np.ndarray):
        self.words = np.concatenate([words, np.full(DEPTH, -1, np.int64)])  # the end sorts first
        n = len(words)
        rank, k = words.astype(np.int64) + 1, 1
        self.order = np.argsort(rank, kind="stable")
        while k < DEPTH and n:
            after = np.zeros(n, np.int64)
            after[: max(0, n - k)] = rank[k:]
            key = rank * (rank.max() + 1) + after
            self.order = np.argsort(key, kind="stable")
            s = key[self.order]
            new = np.concatenate([[1], 1 + np.cumsum(s[1:] != s[:-1])])
            rank = np.empty(n, np.int64)
            rank[self.order] = new
            k *= 2

    def __len__(self) -> int:
        return len(self.order)

    def search(self, suffixes: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
        """For each row of `suffixes`, of which the first `lengths` words count: the first place whose suffix is not smaller (upper: that is larger)."""
        lo, hi = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), len(self), np.int64)
        width = suffixes.shape[1] if len(suffixes) else 0
        span, used = np.arange(width), np.arange(width)[None, :] < lengths[:, None]
        for _ in range(int(len(self)).bit_length()):
            open_ = lo < hi
            mid = (lo + hi) >> 1
            at = self.order[np.minimum(mid, len(self) - 1)]
            here = self.words[np.minimum(at[:, None] + span, len(self.words) - 1)]
            differ = (here != suffixes) & used
            first = differ.argmax(1)
            rows = np.arange(len(suffixes))
            some = differ[rows, first]
            less = np.where(some, here[rows, first] < suffixes[rows, first], upper)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo


class Items:
    """A block of benchmark items as word numbers. Picklable."""

    def __init__(self, rows: list[tuple], window: int = WINDOW):
        self.window = window
        self.ids: list[str] = []
        self.number: dict[bytes, int] = {}
        texts = []
        for item, text in rows:
            words = words_of(text.encode() if isinstance(text, str) else text)
            if words and item is not None:
                self.ids.append(str(item))
                texts.append(np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64))
        self.owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        self.words = np.concatenate([*texts, np.zeros(0, np.int64)])
        ends = np.repeat(np.cumsum([len(t) for t in texts], dtype=np.int64), [len(t) for t in texts])
        self.left = ends - np.arange(len(self.words))  # words from each place to its item's end
        size = np.repeat([min(window, len(t)) for t in texts], [len(t) for t in texts]).astype(np.int64)
        self.starts = np.flatnonzero(self.left >= size)
        self.sizes = size[self.starts]
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0


def find(items: Items, docs: list[list[bytes]], spans: bool = False) -> tuple[list[np.ndarray], list[set], list[tuple]]:
    """For each document which words are hit and which items (numbers) occur; with `spans`, also the
    longest verbatim matches (document, word, item, word, length) of every item suffix of a window's length or more."""
    first = np.cumsum([0, *map(len, docs)])
    flat = np.zeros(first[-1], bool)
    hit = np.split(flat, first[1:-1]) if docs else []  # views of flat
    found: list[set] = [set() for _ in docs]
    longest: list[tuple] = []
    if not len(items.starts):
        return hit, found, longest
    get = items.number.get
    runs, where = [], []
    for i, words in enumerate(docs):
        if len(words) < items.shortest:
            continue
        n = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], n >= 0, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= items.shortest:
                runs += [n[a:b], [-1]]
                where += [np.arange(a, b) + (i << 32), [-1]]
    if not runs:
        return hit, found, longest
    seq = np.concatenate(runs).astype(np.int64)
    place = np.concatenate(where).astype(np.int64)
    array = SuffixArray(seq)
    width = int(items.sizes.max())
    rows = items.words[np.minimum(items.starts[:, None] + np.arange(width), len(items.words) - 1)]
    low, high = array.search(rows, items.sizes, False), array.search(rows, items.sizes, True)
    for s in np.flatnonzero(high > low):
        own, size = int(items.owner[items.starts[s]]), int(items.sizes[s])
        at = place[array.order[low[s] : high[s]]]
        for d in np.unique(at >> 32).tolist():
            found[d].add(own)
        begin = first[at >> 32] + (at & 0xFFFFFFFF)
        for k in range(size):
            flat[begin + k] = True
        if spans:  # the longest match is among the suffixes of the window's range
            for e in array.order[low[s] : high[s]]:
                n, most = size, int(items.left[items.starts[s]])
                while n < most and array.words[e + n] == items.words[items.starts[s] + n]:
                    n += 1
                longest.append((int(place[e] >> 32), int(place[e] & 0xFFFFFFFF), items.ids[own], int(items.starts[s] - np.flatnonzero(items.owner == own)[0]), n))
    return hit, found, longest


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> list:
    """The benchmark in broadcast blocks of about `block_bytes`; the driver reads one block at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    blocks = []
    for k in range(n):
        own = rows if n == 1 else rows.where(part == k)
        blocks.append(spark.sparkContext.broadcast(Items([tuple(r) for r in own.orderBy("item_id", "text").collect()], window)))
    return blocks


def _find_all(shared: list, docs: list[list[bytes]]) -> tuple[list[np.ndarray], list[set]]:
    hit, ids = [np.zeros(len(d), bool) for d in docs], [set() for _ in docs]
    for block in shared:
        items = block.value
        own, found, _ = find(items, docs)
        for i in range(len(docs)):
            hit[i] |= own[i]
            ids[i] |= {items.ids[k] for k in found[i]}
        if len(shared) > 1:
            block.__dict__.pop("_value", None)  # read again from the worker's disk for the next shard
    return hit, ids


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined ids) and contaminated.

    A null or wordless text has no words, no hits and the hash of the empty string. Items with a
    null id or without words are no items; items that share an id count once. Every occurrence is
    found, in texts of any length; repeated rows stay. Existing columns of these names are replaced.
    """
    shared = item_blocks(benchmark, window=window)

    def make():
        def run(text: pa.Array) -> list[pa.Array]:
            raw = binary(text)
            out: list[tuple] = []
            shard, size = [], 0

            def flush() -> None:
                hit, ids = _find_all(shared, shard)
                out.extend((len(w), int(h.sum()), len(x), hashlib.sha256(",".join(sorted(x)).encode()).hexdigest(), len(x) >= min_items) for w, h, x in zip(shard, hit, ids, strict=True))
                shard.clear()

            for t in raw:
                shard.append(words_of(t))
                size += len(t or b"")
                if size > SHARD_BYTES:
                    flush()
                    size = 0
            flush()
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            return [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]

        return run

    return map_columns(docs, "text", "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", make, keep, SHARD_BYTES)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The longest verbatim match of every item suffix with every place that starts with its window:
    doc_id, doc_word, item_id, item_word (places from 0) and n_words. One row for each, unbounded by any cap."""
    shared = item_blocks(benchmark, window=window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [words_of(t) for t in binary(batch.column(1))]
            rows = []
            for block in shared:
                rows += [(ids[d], w, i, k, n) for d, w, i, k, n in find(block.value, texts, spans=True)[2]]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "doc_word", "item_id", "item_word", "n_words"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("doc_word", pa.int64()), ("item_id", pa.string()), ("item_word", pa.int64()), ("n_words", pa.int64())]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, doc_word long, item_id string, item_word long, n_words long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """The documents, with their own columns, in which windows of fewer than min_items items occur."""
    inner, restore = own_columns(docs)
    return restore(annotate(inner, benchmark, min_items=min_items).where("not contaminated"))
