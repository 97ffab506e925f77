"""Vector similarities on array columns, inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EUCLIDEAN, DOT, COSINE, MAX_INNER = "euclidean", "dot_product", "cosine", "maximum_inner_product"


def _column(v: Column | Sequence[float]) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(a, _column(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def square_distance(a: Column, b: Column | Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(a, _column(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """The cosine; null if a vector is zero."""
    b = _column(b)
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def similarity(a: Column, b: Column | Sequence[float], function: str = EUCLIDEAN) -> Column:
    """A score above 0 that grows with similarity."""
    if function == EUCLIDEAN:
        return 1 / (1 + square_distance(a, b))
    if function == DOT:
        return F.greatest(F.lit(0.0), (1 + dot(a, b)) / 2)
    if function == COSINE:
        return F.greatest(F.lit(0.0), (1 + cosine(a, b)) / 2)
    x = dot(a, b)
    return F.when(x < 0, 1 / (1 - x)).otherwise(x + 1)


def byte_similarity(a: Column, b: Column | Sequence[float], function: str = EUCLIDEAN, dims: int = 1) -> Column:
    """As similarity, for vectors of bytes; a dot product is scaled by the number of dimensions."""
    return F.lit(0.5) + dot(a, b) / float(dims * (1 << 15)) if function == DOT else similarity(a, b, function)


def normalise(a: Column) -> Column:
    """Of unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def quantise(a: Column, low: float, high: float, bits: int = 7) -> Column:
    """Components clipped to [low, high] and rounded to integers of so many bits."""
    top = (1 << bits) - 1
    step = (high - low) / top
    return F.transform(a, lambda x: F.floor((F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high)) - low) / step + 0.5).cast("int"))


def dequantise(a: Column, low: float, high: float, bits: int = 7) -> Column:
    step = (high - low) / ((1 << bits) - 1)
    return F.transform(a, lambda x: x.cast("double") * step + low)


def quantised_dot(a: Column, b: Column, low: float, high: float, bits: int = 7) -> Column:
    """The dot product of quantised vectors, corrected for the offset."""
    step = (high - low) / ((1 << bits) - 1)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return step * step * dot(a, b) + low * step * (total(a) + total(b)) + low * low * F.size(a)


def hyperplanes(dims: int, count: int, seed: int = 0) -> list[list[float]]:
    """Random directions for hashing by angle."""
    import random

    r = random.Random(seed)
    return [[r.gauss(0, 1) / math.sqrt(dims) for _ in range(dims)] for _ in range(count)]


def signature(a: Column, planes: list[list[float]]) -> Column:
    """On which side of each plane a vector lies, as bits."""
    out = F.lit(0).cast("long")
    for i, p in enumerate(planes):
        out = out.bitwiseOR(F.when(dot(a, p) >= 0, F.lit(1 << i)).otherwise(0).cast("long"))
    return out
