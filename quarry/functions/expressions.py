"""JavaScript-like numeric expressions compiled to Columns.

Operators, from loose to tight: ?:, ||, &&, |, ^, &, == !=, < <= > >=, << >> >>>, + -, * / %,
unary + - ! ~. Numbers may be decimal, hexadecimal (0x) or octal (leading 0). Variables are
names with dots, brackets and calls, looked up in bindings or as columns. All values are
doubles; division by zero gives an infinity or NaN, and logic gives 1 or 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import haversine


class ExpressionError(ValueError):
    """An expression that can't be compiled."""


def divide(a: Column, b: Column) -> Column:
    """IEEE division."""
    inf = F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, inf).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def remainder(a: Column, b: Column) -> Column:
    """With the sign of the dividend; NaN for a zero divisor."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def _truth(c: Column) -> Column:
    return (c != 0) & ~F.isnan(c)


def _bool(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _long(c: Column) -> Column:
    return c.cast("long")


def _guard(c: Column, ok: Column) -> Column:
    return F.when(ok, c).otherwise(F.lit(float("nan")))


#: Functions by name: arity and Column function.
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs),
    "acos": (1, F.acos),
    "acosh": (1, F.acosh),
    "asin": (1, F.asin),
    "asinh": (1, F.asinh),
    "atan": (1, F.atan),
    "atan2": (2, F.atan2),
    "atanh": (1, F.atanh),
    "ceil": (1, lambda x: F.ceil(x).cast("double")),
    "cos": (1, F.cos),
    "cosh": (1, F.cosh),
    "exp": (1, F.exp),
    "floor": (1, lambda x: F.floor(x).cast("double")),
    "haversin": (4, lambda a, b, c, d: haversine(a, b, c, d)),
    "ln": (1, lambda x: _guard(F.log(x), x > 0)),
    "log10": (1, lambda x: _guard(F.log10(x), x > 0)),
    "logn": (2, lambda b, x: F.log(x) / F.log(b)),
    "max": (2, F.greatest),
    "min": (2, F.least),
    "pow": (2, F.pow),
    "sin": (1, F.sin),
    "sinh": (1, F.sinh),
    "sqrt": (1, F.sqrt),
    "tan": (1, F.tan),
    "tanh": (1, F.tanh),
}

_TOKEN = re.compile(r"""\s*(?:(?P<num>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*|\[(?:'[^']*'|"[^"]*"|\d+)\])*)|(?P<op>>>>|<<|>>|&&|\|\||<=|>=|==|!=|[-+*/%&|^~!<>?:(),.\[\]]))""")

_LEVELS: list[dict[str, Callable[[Column, Column], Column]]] = [
    {"||": lambda a, b: _bool(_truth(a) | _truth(b))},
    {"&&": lambda a, b: _bool(_truth(a) & _truth(b))},
    {"|": lambda a, b: _long(a).bitwiseOR(_long(b)).cast("double")},
    {"^": lambda a, b: _long(a).bitwiseXOR(_long(b)).cast("double")},
    {"&": lambda a, b: _long(a).bitwiseAND(_long(b)).cast("double")},
    {"==": lambda a, b: _bool(a == b), "!=": lambda a, b: _bool(a != b)},
    {"<": lambda a, b: _bool(a < b), "<=": lambda a, b: _bool(a <= b), ">": lambda a, b: _bool(a > b), ">=": lambda a, b: _bool(a >= b)},
    {"<<": lambda a, b: F.call_function("shiftleft", _long(a), b.cast("int")).cast("double"), ">>": lambda a, b: F.call_function("shiftright", _long(a), b.cast("int")).cast("double"), ">>>": lambda a, b: F.call_function("shiftrightunsigned", _long(a), b.cast("int")).cast("double")},
    {"+": lambda a, b: a + b, "-": lambda a, b: a - b},
    {"*": lambda a, b: a * b, "/": divide, "%": remainder},
]


def compile_expression(text: str, bindings: dict[str, Any] | None = None, functions: dict[str, tuple[int, Callable[..., Column]]] | None = None) -> Column:
    """The expression as a double Column. bindings: names to Columns, column names or numbers; functions: more functions."""
    names = bindings or {}
    known = FUNCTIONS | (functions or {})
    toks: list[tuple[str, str]] = []
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"{text[at]!r} at {at} isn't expected")
        toks.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return toks[pos][1] if pos < len(toks) else None

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal pos
        if pos >= len(toks) or (expected is not None and toks[pos][1] != expected):
            raise ExpressionError(f"{expected or 'more'} is expected in {text!r}")
        pos += 1
        return toks[pos - 1]

    def conditional() -> Column:
        c = level(0)
        if peek() == "?":
            take()
            yes = conditional()
            take(":")
            return F.when(_truth(c), yes).otherwise(conditional())
        return c

    def level(n: int) -> Column:
        if n == len(_LEVELS):
            return unary()
        out = level(n + 1)
        while peek() in _LEVELS[n] and toks[pos][0] == "op":
            op = take()[1]
            out = _LEVELS[n][op](out, level(n + 1))
        return out

    def unary() -> Column:
        if pos < len(toks) and toks[pos][0] == "op" and toks[pos][1] in "+-!~":
            op = take()[1]
            x = unary()
            return {"+": x, "-": -x, "!": _bool(~_truth(x)), "~": F.bitwise_not(_long(x)).cast("double")}[op]
        return primary()

    def primary() -> Column:
        kind, v = take()
        if kind == "num":
            if v[:2] in ("0x", "0X"):
                return F.lit(float(int(v, 16)))
            return F.lit(float(int(v, 8)) if re.fullmatch(r"0[0-7]+", v) else float(v))
        if v == "(":
            out = conditional()
            take(")")
            return out
        if kind != "name":
            raise ExpressionError(f"{v!r} isn't expected in {text!r}")
        if peek() == "(":
            take()
            args = []
            while peek() != ")":
                args.append(conditional())
                if peek() != ")":
                    take(",")
            take(")")
            if v in known:
                arity, fn = known[v]
                if arity >= 0 and len(args) != arity:
                    raise ExpressionError(f"{v} takes {arity} arguments, not {len(args)}")
                return fn(*args)
            if f"{v}()" in names and not args:
                return value(names[f"{v}()"])
            raise ExpressionError(f"no function {v}")
        if v in names:
            return value(names[v])
        return variable(v)

    def value(x: Any) -> Column:
        return (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))).cast("double")

    def variable(name: str) -> Column:
        parts = re.findall(r"[A-Za-z_$][\w$]*|\[(?:'[^']*'|\"[^\"]*\"|\d+)\]", name)
        root = names.get(parts[0], parts[0])
        c = root if isinstance(root, Column) else F.col(root)
        for p in parts[1:]:
            c = c.getItem(int(p[1:-1]) if p[1:-1].isdigit() else p[2:-2]) if p[0] == "[" else c.getField(p)
        return c.cast("double")

    out = conditional()
    if pos < len(toks):
        raise ExpressionError(f"{toks[pos][1]!r} isn't expected in {text!r}")
    return out


def log2(x: int) -> int:
    """The floor of a positive whole number's binary logarithm."""
    return x.bit_length() - 1


def log_base(base: float, x: float) -> float:
    return math.log(x) / math.log(base)
