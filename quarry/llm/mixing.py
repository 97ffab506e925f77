"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0 (uniform) and 1
(proportional), normalised. The exponent is found by bisection: the largest whose weights reach
a target entropy, or the smallest at which no source is repeated more often than a limit; with
both, the limit decides. The budget of tokens is then dealt out by weights: a source is read in
passes, each over its documents in an order permuted within and across blocks, and the last
pass ends where the source's budget does.

Documents are ordered by two-level sums: blocks of bounded size by hash, their totals over a
small table, then the documents within each block; a source that holds most rows is many blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, without

#: The share of the largest possible entropy that the weights reach, and how often a source's documents may be seen.
TARGET_ENTROPY = 0.9
MAX_REPEATS = 4.0
#: The budget is so many tokens for each token of the input.
BUDGET = 1.0
#: A block holds about so many documents.
BLOCK_ROWS = 4096
#: A table of more sources than this isn't broadcast, but joined by shuffle.
MAX_BROADCAST = 100_000
SEED = 17


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def weights_at(shares: list[float], exponent: float) -> list[float]:
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [r / total for r in raised] if total else raised


def solve_exponent(tokens: list[int], budget: float, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent, by bisection. Entropy falls and the smallest source's repeats fall as it grows."""
    total = sum(tokens)
    shares = [t / total for t in tokens if t > 0] if total else []
    if len(shares) < 2:
        return 1.0
    most = math.log(len(shares))

    def bisect(ok_at_zero, low: float, high: float) -> float:
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if ok_at_zero(mid) else (low, mid)
        return (low + high) / 2

    exponent = 1.0
    if target_entropy is not None and entropy(shares) < target_entropy * most:
        exponent = bisect(lambda e: entropy(weights_at(shares, e)) >= target_entropy * most, 0.0, 1.0)
    if max_repeats is not None:
        too_often = lambda e: max(w * budget / (s * total) for w, s in zip(weights_at(shares, e), shares, strict=True)) > max_repeats
        if too_often(exponent) and not too_often(1.0):
            exponent = bisect(too_often, exponent, 1.0)
        elif too_often(exponent):
            exponent = 1.0
    return exponent


def source_weights(sizes: DataFrame, budget: float = BUDGET, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS) -> tuple[list[dict], float]:
    """For each source with tokens: its tokens, share, weight and token budget; and the exponent. `sizes`: (source, tokens)."""
    rows = [(r["source"], int(r["tokens"])) for r in sizes.orderBy("source").collect() if r["tokens"]]
    total = sum(t for _, t in rows)
    exponent = solve_exponent([t for _, t in rows], budget * total, target_entropy, max_repeats)
    w = weights_at([t / total for _, t in rows], exponent)
    return [{"source": s, "tokens": t, "share": t / total, "weight": x, "quota": int(round(x * budget * total))} for (s, t), x in zip(rows, w, strict=True)], exponent


def n_tokens(text):
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plan(docs: DataFrame, budget: float = BUDGET, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, n_tokens, weight, copies, block, place): how often each document is taken, and where it stands.

    `block` is the document's block in its source's permuted order, `place` its first token's
    place in one pass over the source. A document is in every full pass, and in the last, cut
    one if it starts before the source's remaining budget; a source thus overshoots by less than
    one document. Null sources are a source of their own. Null and wordless texts have no tokens
    and are taken as often as their place says. Repeated rows are rows of their own. The table
    of sources, which the driver reads, is one row for each source.
    """
    rows, sources = _sources(docs, budget, target_entropy, max_repeats)
    out = _placed(rows, rows, sources)
    source = F.when(F.col("source") == "\0", F.lit(None)).otherwise(F.col("source"))
    return out.select("doc_id", source.alias("source"), "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), "copies", "block", "place")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, text_hash): what orders rows."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"), n_tokens(text).alias("n_tokens"), F.xxhash64(text).alias("text_hash"))


def _sources(docs: DataFrame, budget: float, target_entropy: float | None, max_repeats: float | None) -> tuple[DataFrame, DataFrame]:
    """The keyed rows, and (source, blocks, weight, passes, rest)."""
    rows = checkpointed(_keyed(docs))
    sizes = checkpointed(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    deal, _ = source_weights(sizes, budget, target_entropy, max_repeats)
    quotas = docs.sparkSession.createDataFrame([(d["source"], d["weight"], d["quota"] // d["tokens"], d["quota"] % d["tokens"]) for d in deal], "source string, weight double, passes long, rest long")
    sources = sizes.join(quotas, "source", "left").select("source", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).alias("blocks"), "weight", "passes", "rest")
    # beyond MAX_BROADCAST another plan, with the same result
    return rows, F.broadcast(sources) if sizes.count() <= MAX_BROADCAST else sources


def _placed(rows: DataFrame, keyed: DataFrame, sources: DataFrame) -> DataFrame:
    """rows, which have the columns of `keyed`, with block, place and copies."""

    def in_blocks(df: DataFrame) -> DataFrame:
        return df.join(sources, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + 1), "source", "doc_id", "text_hash"), F.col("blocks")))

    totals = in_blocks(keyed).groupBy("source", "block").agg(F.sum("n_tokens").alias("t"))
    before = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED + 2), "source", "block"), "block")  # one row a block
    base = totals.select("source", "block", (F.sum("t").over(before) - F.col("t")).alias("base"))
    order = F.xxhash64(F.lit(SEED), "source", "doc_id")
    within = Window.partitionBy("source", "block").orderBy(order, "doc_id", "n_tokens", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = in_blocks(rows).withColumn("upto", F.sum("n_tokens").over(within)).join(base, ["source", "block"])
    out = out.withColumn("place", F.col("base") + F.col("upto") - F.col("n_tokens"))
    copies = F.coalesce(F.col("passes"), F.lit(0)) + F.when(F.col("place") < F.coalesce(F.col("rest"), F.lit(0)), 1).otherwise(0)
    return out.withColumn("copies", copies)


def mix(docs: DataFrame, budget: float = BUDGET, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS) -> DataFrame:
    """The mixed corpus: the documents' own columns with `mix_pass` (from 0), `mix_block` and `mix_place`, one row for each time a document is taken.

    Sorting by source, pass and place gives each source's order. Every row, repeated ones
    included, is taken as often as plan() says of it: rows are dealt to their blocks whole. Nulls
    and empty texts are as in plan(); an empty table gives an empty one.
    """
    own = without(docs, "mix_pass", "mix_block", "mix_place")
    keyed, sources = _sources(docs, budget, target_entropy, max_repeats)
    text = F.col("text").cast("string")
    rows = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"), n_tokens(text).alias("n_tokens"), F.xxhash64(text).alias("text_hash"))
    out = _placed(rows, keyed, sources).where("copies > 0")
    return out.select("row", F.explode(F.expr("sequence(0, cast(copies - 1 as int))")).alias("mix_pass"), F.col("block").alias("mix_block"), F.col("place").alias("mix_place")).select("row.*", "mix_pass", "mix_block", "mix_place")
