"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over hashed words; each later
model also sees the earlier categories' probabilities. It is trained with out-of-fold
probabilities, each from a model that has not seen the document, so that it learns how far to
trust them. The table of labels names the categories; by default the chain runs from poor
quality to toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, map_columns, pieces, released, unit_hash, window

#: The chain: names and SQL expressions over labels, each 0, 1 or null.
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))
#: Trained on about so many labelled rows, of a longer one on a window of TRAIN_CHARS ...
TRAIN_DOCS = 12_000
TRAIN_CHARS = 100_000
#: ... chosen by a hash of the id.
BITS = 18
FOLDS = 4
#: Words in fewer training documents have no weight.
MIN_DOCS = 8
L2 = 2.0
EPOCHS = 60
#: A document is in a category from this probability on.
CUT = 0.5


class Buckets(dict):
    """Bucket numbers of words (bytes): of lower-cased letters and digits without what surrounds them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        bare = word.lower().strip(b".,;:!?\"'()[]{}<>|#$%&*-_=+/\\~`^@")
        self[word] = b = xxhash.xxh64_intdigest(bare or word) >> (64 - BITS)
        return b

    def of(self, text: bytes | None) -> np.ndarray:
        return np.unique(np.fromiter(map(self.__getitem__, w), np.int64, len(w))) if text and (w := text.split()) else np.zeros(0, np.int64)


class Linear:
    """Logistic regression over present words and a few dense features, fitted by gradient descent with momentum per weight (Adam)."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    @classmethod
    def fit(cls, rows: np.ndarray, words: np.ndarray, extra: np.ndarray, y: np.ndarray) -> Linear:
        """rows, words: the pairs of document number and bucket; extra: (documents, dense features)."""
        n = len(y)
        size = 1 << BITS
        if n == 0 or y.min() == y.max():
            return cls(np.zeros(size, np.float32), np.zeros(extra.shape[1]), 0.0 if n == 0 else (8.0 if y[0] else -8.0))
        seen = np.bincount(words, minlength=size) >= min(MIN_DOCS, max(2, n // 50))
        ok = seen[words]
        rows, words = rows[ok], words[ok]
        used, words = np.unique(words, return_inverse=True)
        # Naive Bayes log-ratios scale the words: rare words of one class get large steps, common ones small.
        p = np.bincount(words, weights=y[rows], minlength=len(used)) + 0.5
        q = np.bincount(words, weights=1 - y[rows], minlength=len(used)) + 0.5
        r = np.log(p / (y.sum() + 1)) - np.log(q / ((1 - y).sum() + 1))
        value = r[words]
        w, d, b = np.zeros(len(used)), np.zeros(extra.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
        theta = np.concatenate([w, d, [b]])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, EPOCHS + 1):
            w, d, b = theta[: len(used)], theta[len(used) : -1], theta[-1]
            z = np.bincount(rows, weights=value * w[words], minlength=n) + extra @ d + b
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g = np.concatenate([np.bincount(words, weights=value * e[rows], minlength=len(used)) / n + L2 * w / n, extra.T @ e / n, [e.mean()]])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights = np.zeros(size, np.float32)
        weights[used] = theta[: len(used)] * r
        return cls(weights, theta[len(used) : -1], float(theta[-1]))

    def logits(self, rows: np.ndarray, words: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=self.weights[words], minlength=len(extra)) + extra @ self.dense + self.bias


def _feed(z: np.ndarray) -> np.ndarray:
    """An earlier category's probability, from its logit, as a feature of the later ones."""
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_chain(rows: np.ndarray, words: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """A model for each column of labels (NaN: unknown), fed with the earlier ones' out-of-fold logits."""
    n = len(labels)
    extra = np.zeros((n, 0))
    chain = []

    def part(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.cumsum(of) - 1
        ok = of[rows]
        return number[rows[ok]], words[ok]

    for k in range(labels.shape[1]):
        y = labels[:, k]
        known = ~np.isnan(y)
        chain.append(Linear.fit(*part(known), extra[known], y[known]))
        out = np.zeros(n)
        if k + 1 < labels.shape[1]:
            for f in range(FOLDS):
                train, test = known & (folds != f), folds == f
                model = Linear.fit(*part(train), extra[train], y[train])
                out[test] = model.logits(*part(test), extra[test])
            extra = np.concatenate([extra, _feed(out)[:, None]], 1)
    return chain


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES) -> list[Linear]:
    """The chain from a bounded sample of labelled documents. One label per id and category: the largest, if there are several."""
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.expr(e).cast("double")).alias(f"y{k}") for k, (_, e) in enumerate(categories)])
    n = own.count()
    sample = F.broadcast(own.where(unit_hash("doc_id") < min(1.0, TRAIN_DOCS / max(1, n))))  # about TRAIN_DOCS rows
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = text.join(sample, "doc_id").withColumn("text", window(F.col("text"), TRAIN_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for whole in batches:
            for batch in pieces(whole):
                found = [buckets.of(t).astype(np.int32) for t in binary(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), *batch.columns[2:]], names=["doc_id", "words", *(f"y{k}" for k in range(len(categories)))])

    table = joined.mapInArrow(released(run), "doc_id long, words array<int>, " + ", ".join(f"y{k} double" for k in range(len(categories)))).toPandas()
    table = table.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    sizes = [len(w) for w in table["words"]]
    rows = np.repeat(np.arange(len(table)), sizes)
    words = np.concatenate([*table["words"], np.zeros(0, np.int64)]).astype(np.int64)
    y = table[[f"y{k}" for k in range(len(categories))]].to_numpy(np.float64).reshape(len(table), len(categories))
    folds = np.array([xxhash.xxh64_intdigest(str(i)) % FOLDS for i in table["doc_id"]], np.int64)
    return fit_chain(rows, words, y, folds)


def predict(docs: DataFrame, chain: list[Linear], categories=CATEGORIES, keep: list[str] | None = None) -> DataFrame:
    """docs with p_<category> (0 to 1) and <category> (boolean) of every category.

    A null or wordless text has probability 0 in all. Texts are whole, repeated rows stay; existing
    columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 1 MB a category

    def make():
        models, buckets = shared.value, Buckets()

        def run(text: pa.Array) -> list[pa.Array]:
            found = [buckets.of(t) for t in binary(text)]
            sizes = np.array([len(w) for w in found], np.int64)
            rows, words = np.repeat(np.arange(len(found)), sizes), np.concatenate([*found, np.zeros(0, np.int64)])
            extra, out = np.zeros((len(found), 0)), []
            for m in models:
                z = m.logits(rows, words, extra)
                p = np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                out += [pa.array(p), pa.array(p >= CUT)]
                extra = np.concatenate([extra, _feed(z)[:, None]], 1)
            return out

        return run

    return map_columns(docs, "text", ", ".join(f"p_{c} double, {c} boolean" for c, _ in categories), make, keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_low_quality, low_quality, p_toxic, toxic): one row per document. Without labels all probabilities are a half or less and nothing is toxic."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(own, train(own, labels), keep=["doc_id"])
