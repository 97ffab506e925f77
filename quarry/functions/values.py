"""Value sources: per-document values as Columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import divide


def constant(x: float | str) -> Column:
    return F.lit(x)


def field(name: str, default: float | None = None) -> Column:
    """A column's value; missing ones are the default."""
    c = F.col(name)
    return c if default is None else F.coalesce(c, F.lit(default))


def multi_field(name: str, selector: str = "min") -> Column:
    """The least or largest of an array."""
    return F.array_min(name) if selector == "min" else F.array_max(name)


def enum_field(name: str, ordinals: dict[str, int]) -> Column:
    """Names to numbers."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in ordinals.items() for x in kv]), F.col(name))


def total(*xs: Column) -> Column:
    return functools.reduce(Column.__add__, xs)


def product(*xs: Column) -> Column:
    return functools.reduce(Column.__mul__, xs)


def largest(*xs: Column) -> Column:
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def smallest(*xs: Column) -> Column:
    return F.least(*xs) if len(xs) > 1 else xs[0]


def quotient(a: Column, b: Column) -> Column:
    """Division that gives infinities and NaN."""
    return divide(a.cast("double"), b.cast("double"))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def linear(x: Column, slope: float, intercept: float) -> Column:
    return slope * x + intercept


def reciprocal(x: Column, m: float, a: float, b: float) -> Column:
    return a / (m * x + b)


def scale(rows: DataFrame, x: str, low: float, high: float, out: str = "scaled") -> DataFrame:
    """x rescaled to [low, high] by its range over all rows; a range of zero gives low. One row of extremes is joined."""
    ends = rows.agg(F.min(x).cast("double").alias("_lo"), F.max(x).cast("double").alias("_hi"))
    factor = F.when(F.col("_hi") > F.col("_lo"), (high - low) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return rows.crossJoin(F.broadcast(ends)).withColumn(out, (F.col(x) - F.col("_lo")) * factor + low).drop("_lo", "_hi")


def range_map(x: Column, low: float, high: float, target: Column | float, default: Column | float | None = None) -> Column:
    """target for values in [low, high], else the default, or the value itself."""
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(x.between(low, high), c(target)).otherwise(x if default is None else c(default))


def if_(test: Column, yes: Column, no: Column) -> Column:
    return F.when(test, yes).otherwise(no)


def compare(a: Column, op: str, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]


def all_of(*tests: Column) -> Column:
    return functools.reduce(Column.__and__, tests)


def any_of(*tests: Column) -> Column:
    return functools.reduce(Column.__or__, tests)


def none_of(*tests: Column) -> Column:
    return ~any_of(*tests)


def payload_value(values: Column, function: str = "average") -> Column:
    """average, min, max or sum of an array of payload values."""
    s = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return {"average": F.when(F.size(values) > 0, s / F.size(values)).otherwise(1.0), "min": F.array_min(values), "max": F.array_max(values), "sum": s}[function]


def running(x: str, by: str, order: str) -> Column:
    """The running sum within a group."""
    return F.sum(x).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
