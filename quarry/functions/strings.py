"""String distances, from 0 (different) to 1 (equal) unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no substring edited twice."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1]


def jaro_winkler(a: str, b: str, threshold: float = 0.7, scale: float = 0.1) -> float:
    """Jaro similarity, raised for a common prefix of up to four characters where it is at least `threshold`."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    first = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                first.append(x)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [b[j] for j in range(len(b)) if taken[j]]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro < threshold:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + scale * prefix * (1 - jaro)


def ngram_similarity(a: str, b: str, n: int = 2) -> float:
    """Kondrak's n-gram similarity: edit costs are the shares of differing characters in n-grams; starts are padded."""
    if not a or not b:
        return float(a == b)
    if len(a) < n or len(b) < n:
        return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))
    pa, pb = "\0" * (n - 1) + a, "\1" * (n - 1) + b
    row = [float(j) for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        before, row = row, [float(i)]
        ga = pa[i - 1 : i - 1 + n]
        for j in range(1, len(b) + 1):
            gb = pb[j - 1 : j - 1 + n]
            known = n
            cost = 0
            for x, y in zip(ga, gb, strict=True):
                if x in "\0\1" and y in "\0\1":
                    known -= 1
                elif x != y:
                    cost += 1
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + cost / max(1, known)))
    return 1 - row[-1] / max(len(a), len(b))


def _pairs(fn, kind: str):
    def column(a: Column, b: Column | str) -> Column:
        @F.pandas_udf(kind)
        def udf(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)])

        return udf(a, b if isinstance(b, Column) else F.lit(b))

    return column


#: Number of edits with swaps of neighbours.
osa_distance = _pairs(osa, "int")
jaro_winkler_similarity = _pairs(jaro_winkler, "double")
ngram_distance = _pairs(ngram_similarity, "double")


def levenshtein_similarity(a: Column, b: Column | str) -> Column:
    """1 - edits / the longer length, inside the JVM."""
    b = b if isinstance(b, Column) else F.lit(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def osa_similarity(a: Column, b: Column | str) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - osa_distance(a, b) / longest)
