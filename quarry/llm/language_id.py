"""Language ID by prediction by partial matching over bytes.

Each language has a variable-order context tree of byte counts, gathered once and then frozen.
A byte that a context has seen costs -log2(c / (n + q)) bits, where c is its count, n the
context's total and q its number of distinct bytes; an unseen one costs the escape
-log2(q / (n + q)) and is coded by the next shorter context, down to the uniform order -1
(method C). The text's exact code length under every tree is summed, and the shortest wins.

All contexts of all languages are numbered in one table for each order, so that the code
length of a byte is a table entry, found for whole batches of texts by array indexing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, checkpointed, map_columns, own_columns, unit_hash, window, without

#: Trained on at most about so many characters of each language ...
SAMPLE_CHARS = 400_000
#: ... of a longer row on a window of so many, at a place that a hash of its id gives ...
SAMPLE_ROW_CHARS = 50_000
#: ... and on so many in all, shared out if there are very many languages.
SAMPLE_TOTAL_CHARS = 16_000_000
MAX_ORDER = 3
#: Up to so many code lengths are kept in tables by (context, byte, language); beyond, those that training has seen are searched for. Results are the same.
MAX_CELLS = 24_000_000
#: Rates of up to so many languages are broadcast.
MAX_BROADCAST = 100_000
UNDETERMINED = "und"


class ContextTrees:
    """Frozen byte context trees of several languages. Picklable; the tables of code lengths are made on first use."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = MAX_ORDER):
        self.langs = sorted(texts)
        self.order = order
        streams = []
        for lang in self.langs:
            streams.append(np.frombuffer(b"".join(b"\0" * order + t for t in texts[lang]), np.uint8))
        seen = np.zeros(256, bool)
        for s in streams:
            seen[s] = True
        seen[0] = False
        #: 0 stands before a text's start, 1 for bytes that training has not seen.
        self.code = np.ones(256, np.uint8)
        self.code[seen] = np.arange(2, 2 + seen.sum())
        self.size = int(seen.sum()) + 2
        starts = [np.repeat(np.arange(len(texts[lang])), [len(t) + order for t in texts[lang]]) for lang in self.langs]
        coded = []
        for s, own in zip(streams, starts, strict=True):
            c = self.code[s].copy()
            at = np.flatnonzero(np.diff(own, prepend=-1))
            for k in range(order):
                c[at + k] = 0
            first = np.zeros(len(c), bool)
            for k in range(order):
                first[at + k] = True
            coded.append((c.astype(np.int64), ~first))
        index = [np.zeros(len(c), np.int64) for c, _ in coded]
        self.next: list[np.ndarray] = []
        self.parent: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.counts = [[self._count(i, c, ok) for i, (c, ok) in zip(index, coded, strict=True)]]
        self.rows = [1]
        for _ in range(order):
            keys = [np.concatenate([[0], i[:-1] * self.size + c[:-1]]) for i, (c, _) in zip(index, coded, strict=True)]
            used = np.unique(np.concatenate([k[ok] for k, (_, ok) in zip(keys, coded, strict=True)] or [np.zeros(0, np.int64)]))
            rows = len(used) + 1
            table = np.zeros(self.rows[-1] * self.size, np.int32)
            table[used] = np.arange(1, rows)
            below = [table[k].astype(np.int64) for k in keys]
            parent = np.zeros(rows, np.int64)
            for i, b, (_, ok) in zip(index, below, coded, strict=True):
                parent[b[ok]] = i[ok]
            index = below
            self.next.append(table)
            self.parent.append(parent)
            self.rows.append(rows)
            self.counts.append([self._count(i, c, ok) for i, (c, ok) in zip(index, coded, strict=True)])
        self.dense = sum(self.rows) * self.size * len(self.langs) <= MAX_CELLS

    def _count(self, index: np.ndarray, c: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(index[ok] * self.size + c[ok], return_counts=True)

    def tables(self) -> tuple[np.ndarray, list[int]]:
        """Code lengths in bits by (row, byte, language), and each order's first row."""
        if not hasattr(self, "_tables"):
            n, out, first = len(self.langs), [], []
            base = np.full((1, self.size, n), 8.0)
            at = 0
            for k, rows in enumerate(self.rows):
                c = np.zeros((n, rows * self.size))
                for j, (cells, counts) in enumerate(self.counts[k]):
                    c[j][cells] = counts
                c = c.reshape(n, rows, self.size).transpose(1, 2, 0)
                total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                shorter = base[self.parent[k]] if k else base
                with np.errstate(divide="ignore", invalid="ignore"):
                    cost = np.where(c > 0, -np.log2(c / (total + kinds)), np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0) + shorter)
                base = cost
                out.append(cost.astype(np.float32))
                first.append(at)
                at += rows
            self._tables = np.concatenate(out).reshape(-1, n), first
        return self._tables

    def _searched(self, indexes: list[np.ndarray], c: np.ndarray) -> np.ndarray:
        """Code lengths in bits by (place, language) of bytes in contexts, of each order, found among what training has seen."""
        if not hasattr(self, "_seen"):
            self._seen = [[(cells, counts, *(np.bincount(cells // self.size, weights=w, minlength=self.rows[k]) for w in (counts, None))) for cells, counts in own] for k, own in enumerate(self.counts)]
        out = np.full((len(c), len(self.langs)), 8.0)
        for index, own in zip(indexes, self._seen, strict=True):
            cell = index * self.size + c
            for j, (cells, counts, total, kinds) in enumerate(own):
                n, q = total[index], kinds[index]
                at = np.minimum(np.searchsorted(cells, cell), max(0, len(cells) - 1))
                hit = cells[at] == cell if len(cells) else np.zeros(len(c), bool)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape = np.where(n > 0, -np.log2(q / (n + q)), 0.0) + out[:, j]
                    out[:, j] = np.where(hit, -np.log2((counts[at] if len(cells) else 0) / (n + q)), escape)
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text under each language's tree."""
        out = np.zeros((len(texts), len(self.langs)))
        step, size = [], 0
        for i, t in enumerate(texts):
            if len(t) > 1 << 20:
                self._add(out, [i], [t])
                continue
            step.append(i)
            size += len(t)
            if size > 1 << 19:
                self._add(out, step, [texts[j] for j in step])
                step, size = [], 0
        if step:
            self._add(out, step, [texts[j] for j in step])
        return out

    def _add(self, out: np.ndarray, rows: list[int], texts: list[bytes]) -> None:
        cost, first = self.tables() if self.dense else (None, [])
        d = max(1, self.order)
        lengths = np.array([len(t) for t in texts])
        coded = self.code[np.frombuffer(b"".join(b"\0" * d + t for t in texts), np.uint8)].astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + d)[:-1]])
        for k in range(d):
            coded[starts + k] = 0
        ends = starts + lengths + d
        for lo in range(0, len(coded), 1 << 20):  # a very long text goes piece by piece
            hi, back = min(len(coded), lo + (1 << 20)), max(0, lo - d)
            c = coded[back:hi]
            indexes = [np.zeros(len(c), np.int64)]
            for table in self.next:
                indexes.append(np.concatenate([[0], table[indexes[-1][:-1] * self.size + c[:-1]]]))
            if self.dense:
                row = indexes[0] + first[0]
                for k, index in enumerate(indexes[1:], 1):
                    row = np.where(index > 0, index + first[k], row)
                each = cost[row * self.size + c]
            else:
                each = self._searched(indexes, c)
            here = (starts < hi) & (ends > lo)
            for j in np.flatnonzero(here):
                a, b = max(starts[j] + d, lo) - back, min(ends[j], hi) - back
                if b > a:
                    out[rows[j]] += each[a:b].sum(0, dtype=np.float64)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, order: int = MAX_ORDER, sample_chars: int = SAMPLE_CHARS) -> ContextTrees:
    """Context trees from documents that are not held out and have a language.

    A bounded sample, as documented at SAMPLE_CHARS: rows are taken by a hash of their id, at a
    rate for each language that gives about `sample_chars` characters; of a long row a window.
    """
    rows = without(docs, "held_out").where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), window(F.col("text"), SAMPLE_ROW_CHARS).alias("text"))
    sizes = checkpointed(rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).where("n > 0"))
    k = sizes.count()
    rates = sizes.select(F.col("lang").alias("l"), (F.lit(min(sample_chars, SAMPLE_TOTAL_CHARS // max(1, k))) / F.col("n")).alias("rate"))
    taken = rows.join(F.broadcast(rates) if k <= MAX_BROADCAST else rates, F.col("lang") == F.col("l")).where(unit_hash("doc_id") < F.col("rate"))
    texts: dict[str, list[bytes]] = {}
    for r in taken.select("doc_id", "lang", "text").orderBy("doc_id", "text").collect():  # about SAMPLE_TOTAL_CHARS at most
        if r["text"]:
            texts.setdefault(r["lang"], []).append(r["text"].encode())
    return ContextTrees(texts, order)


def predict(docs: DataFrame, model: ContextTrees, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (0 to 1: the best language's posterior under equal priors) and bits_per_byte.

    A null text, or one without any letter, gets `und`, score 0 and null bits; so does every text
    if no language was learned. Ties go to the name that sorts first. Existing columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_TOTAL_CHARS and MAX_CELLS

    def make():
        trees = shared.value

        def run(text: pa.Array) -> list[pa.Array]:
            raw, strings = binary(text), text.to_pylist()
            some = [i for i, s in enumerate(strings) if s and trees.langs and (s.isalpha() or any(map(str.isalpha, s)))]
            lang, score, per = [UNDETERMINED] * len(raw), [0.0] * len(raw), [None] * len(raw)
            bits = trees.bits([raw[i] for i in some]) if some else []
            for i, b in zip(some, bits, strict=True):
                best = int(np.argmin(b))
                lang[i] = trees.langs[best]
                score[i] = float(1 / np.exp2(np.clip(b[best] - b, -1000, 0)).sum())
                per[i] = float(b[best] / len(raw[i]))
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(per, pa.float64())]

        return run

    return map_columns(docs, "text", "lang_pred string, score double, bits_per_byte double", make, keep)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, bits_per_byte. Repeated rows stay; an empty table gives an empty one."""
    out = predict(docs.select("doc_id", "text"), train(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


#: A document whose best code length is above this many bits a byte is in none of the languages.
REJECT_BITS = 6.0


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, whose language is recognised: not `und`, posterior at least a half, at most REJECT_BITS."""
    inner, restore = own_columns(docs)
    out = predict(inner, train(docs))
    return restore(out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= 0.5) & (F.col("bits_per_byte") <= REJECT_BITS)))
