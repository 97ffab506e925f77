"""Similarities as Column arithmetic.

Every similarity is a function of a `Stats` of Columns or literals: tf (occurrences in the
document), dl (the field's length there), df, ttf (documents with the term, its occurrences in
all), n (documents with the field), total (occurrences of all terms) and boost.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Stats:
    tf: Any
    dl: Any
    df: Any
    ttf: Any
    n: Any
    total: Any
    boost: Any = 1.0

    def __post_init__(self):
        for k in ("tf", "dl", "df", "ttf", "n", "total", "boost"):
            v = getattr(self, k)
            setattr(self, k, v.cast("double") if isinstance(v, Column) else F.lit(float(v)))

    @property
    def avgdl(self) -> Column:
        return self.total / self.n


def byte4(length: Column) -> Column:
    """A length after it has been stored in one byte: exact below 40, then four significant bits."""
    x = (length.cast("long") - 24).cast("double")
    # of the surplus above 24 the three bits below the leading one are kept
    shift = F.greatest(F.floor(F.log2(F.greatest(x, F.lit(1.0)))) - 3, F.lit(0))
    unit = F.pow(F.lit(2.0), shift)
    return F.when(length < 40, length.cast("double")).otherwise(24 + F.floor(x / unit) * unit)


def log2(x: Column) -> Column:
    return F.log2(x)


Similarity = Callable[[Stats], Column]


def bm25(k1: float = 1.2, b: float = 0.75, quantised: bool = False) -> Similarity:
    """weight - weight / (1 + tf / (k1 (1 - b + b dl / avgdl))), without the factor k1 + 1."""

    def score(s: Stats) -> Column:
        idf = F.log(1 + (s.n - s.df + 0.5) / (s.df + 0.5))
        dl = byte4(s.dl) if quantised else s.dl
        w = s.boost * idf
        return w - w / (1 + s.tf / (k1 * ((1 - b) + b * dl / s.avgdl)))

    return score


def classic() -> Similarity:
    """sqrt(tf) (ln((n + 1) / (df + 1)) + 1) / sqrt(dl)."""
    return lambda s: s.boost * F.sqrt(s.tf) * (F.log((s.n + 1) / (s.df + 1)) + 1) / F.sqrt(s.dl)


def collection_probability(s: Stats) -> Column:
    return (s.ttf + 1) / (s.total + 1)


def lm_dirichlet(mu: float = 2000.0) -> Similarity:
    def score(s: Stats) -> Column:
        p = collection_probability(s)
        return F.greatest(F.lit(0.0), s.boost * (F.log(1 + s.tf / (mu * p)) + F.log(mu / (s.dl + mu))))

    return score


def lm_jelinek_mercer(lam: float = 0.1) -> Similarity:
    return lambda s: s.boost * F.log(1 + ((1 - lam) * s.tf / s.dl) / (lam * collection_probability(s)))


def indri_dirichlet(mu: float = 2000.0) -> Similarity:
    return lambda s: s.boost * F.log((s.tf + mu * collection_probability(s)) / (s.dl + mu))


def boolean() -> Similarity:
    return lambda s: s.boost + 0.0 * s.tf


def raw_tf() -> Similarity:
    return lambda s: s.boost * s.tf


#: Normalisations of divergence from randomness: the term frequency after regard to length.
NORMALISATIONS: dict[str, Callable[[Stats], Column]] = {
    "none": lambda s: s.tf,
    "H1": lambda s: s.tf * s.avgdl / s.dl,
    "H2": lambda s: s.tf * log2(1 + s.avgdl / s.dl),
    "H3": lambda s: (s.tf + 800.0 * ((s.ttf + 1) / (s.total + 1))) / (s.dl + 800.0) * 800.0,
    "Z": lambda s: s.tf * F.pow(s.avgdl / s.dl, F.lit(0.3)),
}

def _geometric(s: Stats) -> Column:
    return (s.ttf + 1) / (s.n + s.ttf + 1)


#: Basic models: the information of tfn occurrences.
BASIC_MODELS: dict[str, Callable[[Stats, Column], Column]] = {
    "G": lambda s, tfn: log2(_geometric(s) + 1) + tfn * log2((1 + _geometric(s)) / _geometric(s)),
    "IF": lambda s, tfn: tfn * log2(1 + (s.n + 1) / (s.ttf + 0.5)),
    "In": lambda s, tfn: tfn * log2((s.n + 1) / (s.df + 0.5)),
    "Ine": lambda s, tfn: tfn * log2((s.n + 1) / (s.n * (1 - F.pow((s.n - 1) / s.n, s.ttf)) + 0.5)),
}

#: First normalisations: what is gained by one more occurrence.
AFTER_EFFECTS: dict[str, Callable[[Stats, Column], Column]] = {
    "none": lambda s, tfn: F.lit(1.0),
    "L": lambda s, tfn: 1 / (tfn + 1),
    "B": lambda s, tfn: (s.ttf + 2) / ((s.df + 1) * (tfn + 1)),
}


def dfr(model: str = "G", effect: str = "L", normalisation: str = "H2") -> Similarity:
    """Divergence from randomness."""

    def score(s: Stats) -> Column:
        tfn = NORMALISATIONS[normalisation](s)
        return s.boost * BASIC_MODELS[model](s, tfn) * AFTER_EFFECTS[effect](s, tfn)

    return score


def ib(distribution: str = "LL", lam: str = "DF", normalisation: str = "H2") -> Similarity:
    """Information based: log-logistic or smoothed power law."""

    def score(s: Stats) -> Column:
        tfn = NORMALISATIONS[normalisation](s)
        x = (s.df + 1) / (s.n + 1) if lam == "DF" else (s.ttf + 1) / (s.n + 1)
        if distribution == "LL":
            return s.boost * -F.log(x / (tfn + x))
        x = F.when(x == 1.0, F.lit(math.nextafter(1.0, 0.0))).otherwise(x)
        q = tfn / (tfn + 1)
        return s.boost * -F.log((F.pow(x, q) - x) / (1 - x))

    return score


#: Measures of divergence from independence.
INDEPENDENCE: dict[str, Callable[[Column, Column], Column]] = {
    "chi_squared": lambda tf, e: (tf - e) * (tf - e) / e,
    "saturated": lambda tf, e: (tf - e) / e,
    "standardized": lambda tf, e: (tf - e) / F.sqrt(e),
}


def dfi(measure: str = "standardized") -> Similarity:
    """Divergence from independence; 0 where a term is no more frequent than expected."""

    def score(s: Stats) -> Column:
        e = (s.ttf + 1) * s.dl / (s.total + 1)
        return F.when(s.tf > e, s.boost * log2(INDEPENDENCE[measure](s.tf, e) + 1)).otherwise(0.0)

    return score


def axiomatic(kind: str = "F2LOG", s_: float = 0.25, k: float = 0.35, query_length: int = 1) -> Similarity:
    """The six axiomatic functions: F1, F2 or F3, each with EXP or LOG; never below 0."""
    f, growth = kind[:2].upper(), kind[2:].upper()

    def score(s: Stats) -> Column:
        tf = 1 + F.log(1 + F.log(s.tf))
        ln = (s.avgdl + s_) / (s.avgdl + s.dl * s_)
        tfln = s.tf / (s.tf + s_ + s_ * s.dl / s.avgdl)
        idf = F.pow((s.n + 1) / s.df, F.lit(k)) if growth == "EXP" else F.log((s.n + 1) / s.df)
        if f == "F1":
            out = tf * ln * idf
        elif f == "F2":
            out = tfln * idf
        else:
            out = tf * idf - (s.dl - query_length) * s_ * query_length / s.avgdl
        return F.greatest(F.lit(0.0), s.boost * out)

    return score


def sweet_spot_norm(length: Column, low: int = 1, high: int = 1, steepness: float = 0.5) -> Column:
    """1 between low and high; falls on either side."""
    x = length.cast("double")
    return 1 / F.sqrt(steepness * (F.abs(x - low) + F.abs(x - high) - (high - low)) + 1)


def sweet_spot(low: int = 1, high: int = 1, steepness: float = 0.5) -> Similarity:
    return lambda s: s.boost * F.sqrt(s.tf) * (F.log((s.n + 1) / (s.df + 1)) + 1) * sweet_spot_norm(s.dl, low, high, steepness)


def multi(*parts: Similarity) -> Similarity:
    """The sum of several."""
    return lambda s: sum((p(s) for p in parts[1:]), parts[0](s))


def custom(fn: Callable[[Stats], Column]) -> Similarity:
    """A user's own function of the statistics."""
    return fn


@dataclass
class PerField:
    """A similarity for each field."""

    default: Similarity
    fields: dict[str, Similarity] = field(default_factory=dict)

    def of(self, name: str) -> Similarity:
        return self.fields.get(name, self.default)


def of_field(similarity: Similarity | PerField, name: str) -> Similarity:
    return similarity.of(name) if isinstance(similarity, PerField) else similarity


def idf(n: float, df: float) -> float:
    """The BM25 inverse document frequency of plain numbers."""
    return math.log(1 + (n - df + 0.5) / (df + 0.5))
