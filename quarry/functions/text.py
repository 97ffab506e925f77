"""Tokenising inside the JVM, for analyzers that need no more than a split or a pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def whitespace(text: Column) -> Column:
    """Runs without white space, as they are."""
    return F.array_remove(F.split(text, r"\s+"), "")


def letters(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.array_remove(F.split(F.lower(text), r"\P{L}+"), "")


def keyword(text: Column) -> Column:
    """The whole text as one token."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))


def shingles(tokens: Column, n: int, separator: str = " ") -> Column:
    """Runs of n consecutive tokens, joined: tokens zipped with themselves shifted, so that nothing is computed anew for each run."""
    out = tokens
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(tokens, F.lit(k), F.greatest(F.size(tokens), F.lit(0))), lambda a, b: F.concat(a, F.lit(separator), b))
    return F.array_compact(out)


def ngrams(token: Column, low: int, high: int) -> Column:
    """Character n-grams of low to high characters."""
    def of(n: int) -> Column:
        last = F.length(token) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(token, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def edge_ngrams(token: Column, low: int, high: int) -> Column:
    """Prefixes of low to high characters."""
    top = F.least(F.length(token), F.lit(high))
    return F.when(top >= low, F.transform(F.sequence(F.lit(low), F.greatest(top, F.lit(low))), lambda n: F.substring(token, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def path_prefixes(path: Column, separator: str = "/") -> Column:
    """a/b/c to a, a/b, a/b/c."""
    parts = F.split(path, "[" + separator + "]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


#: Analyzers that compile to Columns.
COLUMN_ANALYZERS = {"ascii": ascii_words, "whitespace": whitespace, "simple": letters, "keyword": keyword}
