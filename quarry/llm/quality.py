"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

The model is trained on trusted text by joins and aggregations of n-gram count tables. In the
back-off form of the interpolated model, a text's log-probability is a plain sum over its
n-grams: a unigram brings its own log-probability and its weight as a context, and a longer
n-gram that the model knows brings the correction against the shorter one and its own weight as
a context. Documents are exploded to the hashes of their n-grams, joined to the table of these
terms by hash, and summed per document. Up to MAX_BROADCAST terms the table is broadcast, so that
no n-gram is shuffled; beyond, both sides are sharded by hash. A Bloom filter of the terms leaves
out most n-grams that the model doesn't know before they are exploded.

A document is kept if its perplexity is at most a quantile of trusted text in its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import START, binary, checkpointed, mix, own_columns, pieces, released, sequences, unit_hash, window

#: The model is trained on about so many trusted documents, at most half of them, of a longer one on a window of TRAIN_CHARS.
TRAIN_DOCS = 2000
TRAIN_CHARS = 50_000
#: Terms of 24 bytes each; the sample's bound keeps to this.
MAX_BROADCAST = 5_000_000
#: The filter has 16 bits a term, at most so many in all: a fuller one lets more n-grams pass, never fewer.
MAX_FILTER_BITS = 1 << 28
#: A document is kept up to this quantile of the perplexity of trusted documents of its language that the model was not trained on, times MARGIN.
QUANTILE = 0.98
MARGIN = 1.25
#: A language with fewer trusted documents uses the quantile of all languages.
MIN_TRUSTED = 30

#: Tasks that share the copies of one text when they meet its verdict.
SALTS = 8

SCHEMA = "h3 long, h_uv long, h_vw long, h_v long, h_w long, starts boolean, c long"


def _hash(n: int, *words: np.ndarray) -> np.ndarray:
    h = np.full(len(words[0]), np.uint64(n))
    for w in words:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def trigram_counts(trusted: DataFrame) -> DataFrame:
    """Counts of the trigrams of text, with the hashes of the n-grams within: SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                s, start, n = sequences(binary(batch.column(0)), 3)
                if not len(s):
                    continue
                ends = np.ones(len(s), bool)  # where a trigram may end: not at the two starts of a text
                ends[start[n > 0]] = ends[start[n > 0] + 1] = False
                at = np.flatnonzero(ends)
                u, v, w = s[at - 2], s[at - 1], s[at]
                h3, first, c = np.unique(_hash(3, u, v, w), return_index=True, return_counts=True)
                u, v, w = u[first], v[first], w[first]
                yield pa.RecordBatch.from_arrays([_signed(h3), _signed(_hash(2, u, v)), _signed(_hash(2, v, w)), _signed(_hash(1, v)), _signed(_hash(1, w)), pa.array(v == START), pa.array(c.astype(np.int64))], names=["h3", "h_uv", "h_vw", "h_v", "h_w", "starts", "c"])

    rows = trusted.select(F.col("text").cast("string")).mapInArrow(released(run), SCHEMA)
    return rows.groupBy("h3", "h_uv", "h_vw", "h_v", "h_w", "starts").agg(F.sum("c").alias("c"))


def _discount(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts; a half where these don't define one."""
    n = counts.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    if not n[0] or not n[1]:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))


def _less(d: tuple[float, float, float]):
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def model_terms(trusted: DataFrame) -> tuple[DataFrame, float] | None:
    """(h, x): what each known n-gram adds to a log-probability, and the log-probability of an unknown word; None without text."""
    c3 = checkpointed(trigram_counts(trusted))
    # A shorter n-gram counts the different words before it; one that starts a text counts its occurrences.
    c2 = c3.groupBy("h_vw", "h_v", "h_w").agg(F.sum(F.when(F.col("starts"), F.col("c")).otherwise(1)).alias("c"))
    c2 = checkpointed(c2)
    c1 = c2.groupBy("h_w").agg(F.count("*").alias("c"))
    total = c1.agg(F.sum("c"), F.count("*")).first()
    if not total[1]:
        return None
    d1, d2, d3 = _discount(c1), _discount(c2), _discount(c3)

    def contexts(c: DataFrame, key: str, d: tuple) -> DataFrame:
        return c.groupBy(F.col(key).alias("ctx")).agg(F.sum("c").cast("double").alias("t"), F.sum(_less(d)).alias("g")).select("ctx", "t", (F.col("g") / F.col("t")).alias("gamma"))

    t1 = float(total[0])
    gamma1 = c1.agg(F.sum(_less(d1))).first()[0] / t1
    unknown = float(np.log(gamma1 / (total[1] + 1)))
    p1 = c1.select("h_w", ((F.col("c") - _less(d1)) / t1 + float(np.exp(unknown))).alias("p1"))
    x2, x3 = contexts(c2, "h_v", d2), contexts(c3, "h_uv", d3)
    p2 = c2.join(x2, F.col("h_v") == F.col("ctx")).join(p1, "h_w")
    p2 = p2.select("h_vw", ((F.col("c") - _less(d2)) / F.col("t") + F.col("gamma") * F.col("p1")).alias("p2"), (F.col("gamma") * F.col("p1")).alias("low"))
    p2 = checkpointed(p2)
    p3 = c3.join(x3, F.col("h_uv") == F.col("ctx")).join(p2.select("h_vw", "p2"), "h_vw")
    low = F.col("gamma") * F.col("p2")
    terms = [
        p1.select(F.col("h_w").alias("h"), (F.log("p1") - unknown).alias("x")),
        x2.select(F.col("ctx").alias("h"), F.log("gamma").alias("x")),
        p2.select(F.col("h_vw").alias("h"), F.log(F.col("p2") / F.col("low")).alias("x")),
        x3.select(F.col("ctx").alias("h"), F.log("gamma").alias("x")),
        p3.select(F.col("h3").alias("h"), F.log(((F.col("c") - _less(d3)) / F.col("t") + low) / low).alias("x")),
    ]
    out = terms[0]
    for t in terms[1:]:
        out = out.union(t)
    return out.groupBy("h").agg(F.sum("x").cast("float").alias("x")), unknown


class Filter:
    """A Bloom filter of 64-bit hashes."""

    def __init__(self, size: int):
        self.bits = min(MAX_FILTER_BITS, 1 << max(10, (16 * size).bit_length())).bit_length() - 1
        self.data = np.zeros(1 << (self.bits - 3), np.uint8)

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        m = np.uint64((1 << self.bits) - 1)
        yield h & m
        yield (h >> np.uint64(64 - self.bits)) ^ (h & np.uint64(0xFFF))

    def add(self, h: np.ndarray) -> None:
        for p in self._places(h):
            np.bitwise_or.at(self.data, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self._places(h):
            out &= (self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


#: Stands for a document in the table of terms: every document has one, which adds nothing.
DOCUMENT = 0


class Model:
    """A model's terms (h, x), the log-probability of an unknown word, and the filter of the terms' hashes."""

    def __init__(self, terms: DataFrame, unknown: float):
        self.unknown = unknown
        terms = checkpointed(terms)
        size = terms.count()
        spark = terms.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Filter(size)
            for b in batches:
                own.add(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([own.data.tobytes()], pa.binary())], names=["bits"])

        merged = Filter(size)
        for r in terms.select("h").coalesce(4).mapInArrow(released(run), "bits binary").collect():  # four of at most 32 MB
            merged.data |= np.frombuffer(r["bits"], np.uint8)
        self.filter = spark.sparkContext.broadcast(merged)
        self.terms = terms.union(spark.createDataFrame([(DOCUMENT, 0.0)], "h long, x float"))
        if size <= MAX_BROADCAST:
            self.terms = F.broadcast(self.terms)


def text_grams(texts: list[bytes | None], known: Filter) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each text: the hashes of its n-grams of one to three words that pass the filter, DOCUMENT first; and its number of words."""
    s, start, sizes = sequences(texts, 3)
    some = np.flatnonzero(sizes > 0)
    begin, parts = start[some], []
    for n, h in ((1, _hash(1, s)), (2, _hash(2, s[:-1], s[1:])), (3, _hash(3, s[:-2], s[1:-1], s[2:]))) if len(s) else ():
        at = np.arange(len(h)) + n - 1  # where the n-gram ends: within its text, and not at its first place, which is only a context
        ok = np.ones(len(s), bool)
        for k in range(max(1, n - 1)):
            ok[begin + k] = False
        ok = ok[at] & known.has(h)
        parts.append((h[ok], at[ok]))
    out = [np.zeros(1, np.uint64)] * len(texts)
    ends = [np.searchsorted(at, begin) for _, at in parts]
    for i, j in enumerate(some.tolist()):
        out[j] = np.concatenate([np.array([DOCUMENT], np.uint64), *(h[e[i] : e[i + 1] if i + 1 < len(some) else len(h)] for (h, _), e in zip(parts, ends, strict=True))])
    return out, sizes


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with n_words and perplexity (null without words, or without a model), one row for each row.

    Rows that are alike in `keep` and text are summed together, and given as many times as there are.
    """
    if not model:
        n = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        return docs.select(*keep, n.alias("n_words"), F.lit(None).cast("double").alias("perplexity"))
    shared, unknown = model.filter, model.unknown
    keyed = docs.select(*keep, F.xxhash64("text").alias("key_1"), F.xxhash64(F.lit(1), "text").alias("key_2"), "text")
    keys = [*keep, "key_1", "key_2"]
    schema = StructType([*keyed.select(*keys).schema.fields, *StructType.fromDDL("n_words long, grams array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                grams, n = text_grams(binary(batch.column(len(keys))), shared.value)
                ends = np.cumsum([0, *map(len, grams)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(n.astype(np.int64)), lists], names=schema.names)

    rows = keyed.mapInArrow(released(run), schema)
    joined = rows.select(*keys, "n_words", F.explode("grams").alias("h")).join(model.terms, "h")
    sums = joined.groupBy(*keys, "n_words").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count(F.when(F.col("h") == DOCUMENT, 1)).alias("copies"))
    ends = F.col("n_words") + 1
    logp = (F.col("x") / F.col("copies") + ends * unknown) / ends
    out = sums.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(F.least(-logp, F.lit(700.0)))))
    return out.withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))"))).select(*keep, "n_words", "perplexity")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): documents labelled as good."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, float]:
    """A model of a bounded sample of trusted documents, and the rate of the sample: ids whose unit hash is below it are in it."""
    ids = trusted_ids(labels)
    n = ids.count()
    rate = min(0.5, TRAIN_DOCS / max(1, n))
    sample = F.broadcast(ids.where(unit_hash("doc_id") < rate))  # about TRAIN_DOCS ids
    text = docs.join(sample, "doc_id", "left_semi").select(window(F.col("text"), TRAIN_CHARS).alias("text"))
    terms = model_terms(text)
    return (Model(*terms) if terms else None), rate


def thresholds(scored: DataFrame, labels: DataFrame, rate: float) -> tuple[dict[str, float], float | None]:
    """The highest kept perplexity of each language, and that of all others; from trusted documents outside the training sample."""
    held = scored.where((unit_hash("doc_id") >= rate) & F.col("perplexity").isNotNull()).join(trusted_ids(labels), "doc_id", "left_semi")
    quantile = F.percentile_approx("perplexity", QUANTILE, 10000)
    own = held.groupBy("lang").agg(quantile.alias("q"), F.count("*").alias("n")).where((F.col("n") >= MIN_TRUSTED) & F.col("lang").isNotNull()).collect()
    rest = held.agg(quantile).first()[0]
    return {r["lang"]: r["q"] * MARGIN for r in own}, rest * MARGIN if rest else None


def _verdict(limits: dict[str, float], rest: float | None):
    limit = F.lit(rest).cast("double")
    for lang, x in sorted(limits.items()):
        limit = F.when(F.col("lang") == lang, F.lit(x)).otherwise(limit)
    return limit, F.coalesce(F.col("perplexity") <= limit, F.col("perplexity").isNotNull() | ((F.col("n_words") > 0) & F.lit(rest is None)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, keep): one row per document.

    A null or wordless text has a null perplexity and isn't kept. Without trusted text there is no
    model: all perplexities are null and every text with words is kept. A null language, or one
    with few trusted documents, has the threshold of all languages. Repeated rows stay.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model, rate = train(own, labels)
    scored = checkpointed(score(own, model, ["doc_id", "lang"]))
    limit, keep = _verdict(*thresholds(scored, labels, rate))
    return scored.select("doc_id", "lang", "n_words", "perplexity", limit.alias("threshold"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with their own columns, that classify() keeps. Verdicts are by language and text; texts are shuffled once, to meet them."""
    lang, text = F.col("lang").cast("string"), F.col("text").cast("string")
    key = F.struct(F.xxhash64(lang, text).alias("a"), F.xxhash64(F.lit(1), lang, text).alias("b"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), key.alias("key"), text.alias("text"))
    model, rate = train(own, labels)
    scored = checkpointed(score(own, model, ["doc_id", "lang", "key"]))
    _, keep = _verdict(*thresholds(scored, labels, rate))
    # The copies of one text meet its verdict in several tasks.
    good = scored.where(keep).select("key").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inner, restore = own_columns(docs, "lang", "doc_id")
    salted = inner.withColumns({"key": key, "salt": F.pmod(F.xxhash64(F.lit("salt"), F.col("doc_id").cast("string")), F.lit(SALTS)).cast("int")})
    return restore(salted.join(good, ["key", "salt"], "left_semi"))
