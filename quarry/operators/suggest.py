"""Suggesters and spell checkers over dictionaries (term, weight)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..functions.text import ngrams


def dictionary(docs: DataFrame, term: str, weight: str | None = None, payload: str | None = None, contexts: str | None = None) -> DataFrame:
    """(term, weight[, payload, contexts]) from columns or SQL expressions; a term's weights are added, without one its rows are counted."""
    w = F.sum(F.expr(weight)) if weight else F.count("*")
    extra = [F.max(F.expr(payload)).alias("payload")] if payload else []
    extra += [F.array_sort(F.collect_set(F.expr(contexts))).alias("contexts")] if contexts else []
    return docs.where(F.expr(term).isNotNull()).groupBy(F.expr(term).alias("term")).agg(w.alias("weight"), *extra)


def _best(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("weight"), "term").limit(k)


def prefix(words: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Terms that start with a text, heaviest first; of equal weight by name."""
    return _best(words.where(F.col("term").startswith(text)), k)


#: Tree, transducer and automaton lookups give the same answers from the same table.
tst = wfst = prefix


def fst(words: DataFrame, text: str, k: int = 10, buckets: int = 10, exact_first: bool = True) -> DataFrame:
    """Weights are only known by bucket; within one, terms go by name. An exact match comes first."""
    w = Window.partitionBy(F.lit(1)).orderBy("weight", "term")
    rows = words.where(F.col("term").startswith(text)).withColumn("bucket", F.ntile(buckets).over(w))
    first = (F.col("term") == text).cast("int") if exact_first else F.lit(0)
    return rows.orderBy(F.desc(first), F.desc("bucket"), "term").limit(k)


def infix(words: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Terms that hold a text anywhere."""
    return _best(words.where(F.lower("term").contains(text.lower())), k)


def fuzzy(words: DataFrame, text: str, edits: int = 1, k: int = 10) -> DataFrame:
    """Terms within so many edits of a text."""
    return _best(words.where(F.levenshtein("term", F.lit(text), edits) >= 0), k)


def fuzzy_prefix(words: DataFrame, text: str, edits: int = 1, k: int = 10) -> DataFrame:
    """Terms with a prefix within so many edits of a text."""
    n = len(text)
    near = [F.levenshtein(F.substring("term", 1, m), F.lit(text), edits) >= 0 for m in range(max(1, n - edits), n + edits + 1)]
    test = near[0]
    for t in near[1:]:
        test = test | t
    return _best(words.where(test), k)


def regex(words: DataFrame, pattern: str, k: int = 10) -> DataFrame:
    """Terms with a prefix that matches."""
    return _best(words.where(F.col("term").rlike(f"^(?:{pattern})")), k)


def in_context(words: DataFrame, text: str, contexts: dict[str, float], k: int = 10) -> DataFrame:
    """Terms by prefix in any of several contexts, whose boosts multiply the weight: the largest counts."""
    boost = F.array_max(F.transform("contexts", lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in contexts.items() for x in kv]), c), F.lit(0.0))))
    rows = words.where(F.col("term").startswith(text)).withColumn("weight", F.col("weight") * boost).where("weight > 0")
    return _best(rows, k)


def blended(parts: Iterable[DataFrame], k: int = 10) -> DataFrame:
    """Terms of several suggesters with the mean of their weights."""
    rows = None
    for p in parts:
        p = p.select("term", F.col("weight").cast("double").alias("weight"))
        rows = p if rows is None else rows.union(p)
    return _best(rows.groupBy("term").agg(F.avg("weight").alias("weight")), k)


def free_text(tokens: DataFrame, text: str, n: int = 2, k: int = 10, alpha: float = 0.4) -> DataFrame:
    """Next words by n-gram counts, with stupid backoff. tokens: (doc_id, pos, term); the last word of text is a prefix unless a space follows it."""
    words = text.lower().split()
    open_ = "" if text.endswith(" ") or not words else words.pop()
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = tokens.select("term", *[F.lag("term", i).over(w).alias(f"b{i}") for i in range(1, n)])
    out = None
    for m in range(min(n - 1, len(words)), -1, -1):
        test = F.col("term").startswith(open_)
        all_ = F.lit(True)
        for i in range(1, m + 1):
            all_ = all_ & (F.col(f"b{i}") == words[-i])
        counts = rows.where(all_).groupBy("term").agg(F.count("*").alias("c"))
        total = counts.agg(F.sum("c").alias("t"))
        level = counts.where(test).crossJoin(F.broadcast(total)).select("term", (F.col("c") / F.col("t") * alpha ** (min(n - 1, len(words)) - m)).alias("weight"), F.lit(m).alias("m"))  # one row
        out = level if out is None else out.union(level)
    best = out.groupBy("term").agg(F.max_by("weight", "m").alias("weight"))
    return _best(best, k)


# --- spelling --------------------------------------------------------------------------------------

ALWAYS, WHEN_NOT_IN_INDEX, MORE_POPULAR = "always", "when_not_in_index", "more_popular"
DISTANCES = {"levenshtein": strings.levenshtein_similarity, "osa": strings.osa_similarity, "jaro_winkler": strings.jaro_winkler_similarity, "ngram": strings.ngram_distance}


def direct_spelling(terms: DataFrame, word: str, k: int = 5, accuracy: float = 0.5, mode: str = WHEN_NOT_IN_INDEX, min_prefix: int = 1, edits: int = 2, distance: str = "osa", max_query_frequency: int | None = None) -> DataFrame:
    """(term, df, score): terms like a word that share its first letters. terms: (term, df).

    when_not_in_index: none if the word is a term; more_popular: only terms in more documents.
    """
    own = terms.where(F.col("term") == word).agg(F.coalesce(F.max("df"), F.lit(0)).alias("own"))
    near = (F.col("term") != word) & F.col("term").startswith(word[:min_prefix]) & F.length("term").between(len(word) - edits, len(word) + edits)
    # A swap is two plain edits.
    rows = terms.where(near & (F.levenshtein("term", F.lit(word), 2 * edits) >= 0)).crossJoin(F.broadcast(own))  # one row
    if mode == WHEN_NOT_IN_INDEX:
        rows = rows.where("own = 0")
    elif mode == MORE_POPULAR:
        rows = rows.where("df > own")
    if max_query_frequency is not None:
        rows = rows.where(F.col("own") <= max_query_frequency)
    scored = rows.withColumn("score", DISTANCES[distance](F.col("term"), word)).where(F.col("score") >= accuracy)
    return scored.select("term", "df", "score").orderBy(F.desc("score"), F.desc("df"), "term").limit(k)


def ngram_spelling(words: DataFrame, word: str, k: int = 5, accuracy: float = 0.5, distance: str = "levenshtein") -> DataFrame:
    """(term, score): dictionary words that share character n-grams with a word, by similarity."""
    n = 1 if len(word) < 5 else 2 if len(word) == 5 else 3
    grams = [word[i : i + n] for i in range(len(word) - n + 1)]
    shared = F.exists(ngrams(F.col("term"), n, n), lambda g: g.isin(*grams))
    rows = words.where((F.col("term") != word) & shared).withColumn("score", DISTANCES[distance](F.col("term"), word))
    return rows.where(F.col("score") >= accuracy).select("term", "score").orderBy(F.desc("score"), "term").limit(k)


def word_breaks(terms: DataFrame, word: str, min_part: int = 1, min_df: int = 1) -> DataFrame:
    """(left, right, df): splits of a word into two terms, by the smaller frequency."""
    spark = terms.sparkSession
    cuts = spark.createDataFrame([(word[:i], word[i:]) for i in range(min_part, len(word) - min_part + 1)] or [("", "")], "left string, right string")
    t = terms.where(F.col("df") >= min_df).select("term", "df")
    left = t.select(F.col("term").alias("left"), F.col("df").alias("dl"))
    right = t.select(F.col("term").alias("right"), F.col("df").alias("dr"))
    return cuts.join(left, "left").join(right, "right").select("left", "right", F.least("dl", "dr").alias("df")).orderBy(F.desc("df"), "left")


def word_combinations(terms: DataFrame, words: list[str], min_df: int = 1) -> DataFrame:
    """(combined, df, first, parts): neighbours in a query that together are a term."""
    rows = [("".join(words[i : i + n]), i, n) for n in (2, 3) for i in range(len(words) - n + 1)]
    c = terms.sparkSession.createDataFrame(rows or [("", 0, 0)], "combined string, first int, parts int")
    return c.join(terms.where(F.col("df") >= min_df).select(F.col("term").alias("combined"), "df"), "combined").select("combined", "df", "first", "parts").orderBy(F.desc("df"), "combined")


def similarity_column(name: str, a: Column, b: Column | str) -> Column:
    return DISTANCES[name](a, b)
