"""Minimal-interval queries over one document's positions.

A source turns a document's positions of terms into minimal intervals (start, end), both
inclusive, of which none contains another. Sources combine as plain values; a query runs them by
Arrow batch over position arrays that hold only its own terms.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import query as Q
from .index import Index

Interval = tuple[int, int, int]  # start, end, width of what matched (gaps = end - start + 1 - width)
Positions = dict[str, list[int]]


def minimal(found: list[Interval]) -> list[Interval]:
    """Without intervals that hold another; sorted."""
    out: list[Interval] = []
    for s, e, w in sorted(set(found), key=lambda x: (x[1], -x[0])):
        if not out or s > out[-1][0]:
            out.append((s, e, w))
    return sorted(out)


class Source:
    def at(self, p: Positions) -> list[Interval]:
        raise NotImplementedError

    def terms(self) -> set[str]:
        return set().union(*(s.terms() for s in self.parts())) if self.parts() else set()

    def patterns(self) -> list[Q.MultiTerm]:
        return [x for s in self.parts() for x in s.patterns()]

    def parts(self) -> list[Source]:
        return []

    def min_extent(self) -> int:
        return 1


@dataclass(frozen=True)
class Term(Source):
    term: str

    def at(self, p: Positions) -> list[Interval]:
        return [(x, x, 1) for x in p.get(self.term, ())]

    def terms(self) -> set[str]:
        return {self.term}


@dataclass(frozen=True)
class MultiTerm(Source):
    """Any term that a multi-term query accepts."""

    query: Q.MultiTerm
    matches: Callable[[str], bool]

    def at(self, p: Positions) -> list[Interval]:
        return sorted({(x, x, 1) for t, xs in p.items() if self.matches(t) for x in xs})

    def patterns(self) -> list[Q.MultiTerm]:
        return [self.query]


def prefix(name: str, p: str) -> Source:
    return MultiTerm(Q.Prefix(name, prefix=p), lambda t: t.startswith(p))


def wildcard(name: str, pattern: str) -> Source:
    import re

    r = re.compile(Q.wildcard_regex(pattern))
    return MultiTerm(Q.Wildcard(name, pattern=pattern), lambda t: bool(r.match(t)))


def fuzzy(name: str, term: str, edits: int = 2) -> Source:
    from ..functions.strings import osa

    return MultiTerm(Q.Fuzzy(name, term=term, max_edits=edits), lambda t: abs(len(t) - len(term)) <= edits and osa(t, term) <= edits)


@dataclass(frozen=True)
class Nothing(Source):
    def at(self, p: Positions) -> list[Interval]:
        return []


class Compound(Source):
    def parts(self) -> list[Source]:
        return list(self.sources)


@dataclass(frozen=True)
class Or(Compound):
    sources: tuple[Source, ...]

    def at(self, p: Positions) -> list[Interval]:
        return minimal([i for s in self.sources for i in s.at(p)])

    def min_extent(self) -> int:
        return min(s.min_extent() for s in self.sources)


@dataclass(frozen=True)
class Ordered(Compound):
    """One of each source in order, without overlap."""

    sources: tuple[Source, ...]

    def at(self, p: Positions) -> list[Interval]:
        lists = [s.at(p) for s in self.sources]
        out = []
        for last in lists[-1]:
            # back from the last: the latest of each that still ends before the next begins
            s, e, w = last
            for ls in reversed(lists[:-1]):
                before = [i for i in ls if i[1] < s]
                if not before:
                    break
                b = max(before)
                s, w = b[0], w + b[2]
            else:
                out.append((s, e, w))
        return minimal(out)

    def min_extent(self) -> int:
        return sum(s.min_extent() for s in self.sources)


@dataclass(frozen=True)
class Phrase(Ordered):
    """In order and adjoining."""

    def at(self, p: Positions) -> list[Interval]:
        cur = self.sources[0].at(p)
        for s in self.sources[1:]:
            nxt = s.at(p)
            cur = [(a, e, w + w2) for a, b, w in cur for c, e, w2 in nxt if c == b + 1]
        return minimal(cur)


@dataclass(frozen=True)
class Unordered(Compound):
    """One of each source in any order; without overlaps, no two share a position."""

    sources: tuple[Source, ...]
    overlaps: bool = True

    def at(self, p: Positions) -> list[Interval]:
        lists = [s.at(p) for s in self.sources]
        if any(not ls for ls in lists):
            return []
        at = [0] * len(lists)
        out = []
        while True:
            now = [ls[i] for ls, i in zip(lists, at, strict=True)]
            low = min(range(len(now)), key=lambda i: (now[i][0], now[i][1]))
            apart = self.overlaps or all(a[1] < b[0] for a, b in zip(sorted(now), sorted(now)[1:], strict=False))
            if apart:
                out.append((now[low][0], max(i[1] for i in now), sum(i[2] for i in now)))
            at[low] += 1
            if at[low] >= len(lists[low]):
                return minimal(out)

    def min_extent(self) -> int:
        return sum(s.min_extent() for s in self.sources)


@dataclass(frozen=True)
class AtLeast(Compound):
    """At least n of the sources."""

    n: int
    sources: tuple[Source, ...]

    def at(self, p: Positions) -> list[Interval]:
        every = sorted((i[0], i[1], i[2], k) for k, s in enumerate(self.sources) for i in s.at(p))
        out = []
        for a, x in enumerate(every):
            seen: dict[int, Interval] = {}
            for y in sorted(every[a:], key=lambda i: (i[1], i[0])):
                if y[3] not in seen:
                    seen[y[3]] = y[:3]
                if len(seen) >= self.n:
                    out.append((x[0], y[1], sum(i[2] for i in seen.values())))
                    break
        exact = []
        for s, e, w in out:  # starts may be later than the first of a window
            held = [i for i in every if i[0] >= s and i[1] <= e]
            if len({i[3] for i in held}) >= self.n:
                exact.append((min(i[0] for i in held), e, w))
        return minimal(exact)


@dataclass(frozen=True)
class Filtered(Compound):
    """A source's intervals that a predicate on them and a reference's intervals accepts."""

    source: Source
    accepts: Callable[[Interval, list[Interval]], bool]
    reference: Source = Nothing()

    @property
    def sources(self) -> tuple[Source, ...]:
        return self.source, self.reference

    def at(self, p: Positions) -> list[Interval]:
        ref = self.reference.at(p)
        return [i for i in self.source.at(p) if self.accepts(i, ref)]

    def min_extent(self) -> int:
        return self.source.min_extent()


def max_gaps(source: Source, n: int) -> Source:
    return Filtered(source, lambda i, _: i[1] - i[0] + 1 - i[2] <= n)


def max_width(source: Source, n: int) -> Source:
    return Filtered(source, lambda i, _: i[1] - i[0] + 1 <= n)


def containing(big: Source, small: Source) -> Source:
    return Filtered(big, lambda i, r: any(x[0] >= i[0] and x[1] <= i[1] for x in r), small)


def not_containing(big: Source, small: Source) -> Source:
    return Filtered(big, lambda i, r: not any(x[0] >= i[0] and x[1] <= i[1] for x in r), small)


def contained_by(small: Source, big: Source) -> Source:
    return Filtered(small, lambda i, r: any(x[0] <= i[0] and x[1] >= i[1] for x in r), big)


def not_contained_by(small: Source, big: Source) -> Source:
    return Filtered(small, lambda i, r: not any(x[0] <= i[0] and x[1] >= i[1] for x in r), big)


def overlapping(source: Source, ref: Source) -> Source:
    return Filtered(source, lambda i, r: any(x[0] <= i[1] and x[1] >= i[0] for x in r), ref)


def non_overlapping(source: Source, ref: Source) -> Source:
    return Filtered(source, lambda i, r: not any(x[0] <= i[1] and x[1] >= i[0] for x in r), ref)


def within(source: Source, n: int, ref: Source) -> Source:
    return Filtered(source, lambda i, r: any(x[0] - n <= i[1] and x[1] + n >= i[0] for x in r), ref)


def not_within(source: Source, n: int, ref: Source) -> Source:
    return Filtered(source, lambda i, r: not any(x[0] - n <= i[1] and x[1] + n >= i[0] for x in r), ref)


def before(source: Source, ref: Source) -> Source:
    return Filtered(source, lambda i, r: any(x[0] > i[1] for x in r), ref)


def after(source: Source, ref: Source) -> Source:
    return Filtered(source, lambda i, r: any(x[1] < i[0] for x in r), ref)


@dataclass(frozen=True)
class Extend(Compound):
    """Intervals grown on both sides."""

    source: Source
    before: int
    after: int

    @property
    def sources(self) -> tuple[Source, ...]:
        return (self.source,)

    def at(self, p: Positions) -> list[Interval]:
        return [(max(0, s - self.before), e + self.after, w + self.before + self.after) for s, e, w in self.source.at(p)]


@dataclass(frozen=True)
class FixField(Source):
    """A source on another field of the same documents."""

    field: str
    source: Source

    def at(self, p: Positions) -> list[Interval]:
        mark = self.field + "\0"
        return self.source.at({t[len(mark) :]: v for t, v in p.items() if t.startswith(mark)})


def fixed(source: Source) -> list[FixField]:
    """The sources on other fields within a source."""
    return [source] if isinstance(source, FixField) else [f for s in source.parts() for f in fixed(s)]


@dataclass(frozen=True)
class PayloadTerm(Source):
    """A term at positions whose payload passes: the index's analyzer gives terms as term|payload."""

    term: str
    accepts: Callable[[str], bool]

    def at(self, p: Positions) -> list[Interval]:
        return sorted((x, x, 1) for t, xs in p.items() if t.partition("|")[0] == self.term and self.accepts(t.partition("|")[2]) for x in xs)

    def patterns(self) -> list[Q.MultiTerm]:
        return [Q.Prefix("", prefix=self.term + "|")]


def analyzed(terms: list[str], gaps: int = 0, ordered: bool = True) -> Source:
    """Analyzed text in order (or not) with at most so many gaps; -1: any."""
    parts = tuple(Term(t) for t in terms)
    if not parts:
        return Nothing()
    if len(parts) == 1:
        return parts[0]
    if gaps == 0 and ordered:
        return Phrase(parts)
    s = Ordered(parts) if ordered else Unordered(parts)
    return s if gaps < 0 else max_gaps(s, gaps)


@dataclass(frozen=True)
class Intervals(Q.Query):
    """Documents with an interval of a source. The score saturates, w S / (S + k), or is sigmoid, w S^a / (S^a + k^a), in S, the sum of 1 / max(length - shortest + 1, 1)."""

    field: str
    source: Source
    pivot: float = 1.0
    exponent: float | None = None
    weight: float = 1.0

    def intervals(self, index: Index) -> DataFrame:
        """(doc_id, intervals): flat arrays of start and end."""
        return self._run(index, "array<int>", lambda found: [v for s, e, _ in found for v in (s, e)]).where(F.size("value") > 0).select("doc_id", F.col("value").alias("intervals"))

    def _run(self, index: Index, kind: str, out: Callable[[list[Interval]], object]) -> DataFrame:
        parts = []
        for name, mark, own in [(self.field, "", self.source), *((f.field, f.field + "\0", f.source) for f in fixed(self.source))]:
            tests: list[Column] = [q.accepts(F.col("term")) for q in own.patterns()]
            if own.terms():
                tests.append(F.col("term").isin(*sorted(own.terms())))
            if tests:
                rows = index.postings(name, functools.reduce(Column.__or__, tests))
                parts.append(rows.select("doc_id", F.concat(F.lit(mark), "term").alias("term"), "positions"))
        if not parts:
            return index.ids().where(F.lit(False)).select("doc_id", F.lit(None).cast(kind).alias("value"))
        rows = Q.union_all(parts)
        docs = rows.groupBy("doc_id").agg(F.collect_list("term").alias("t"), F.collect_list("positions").alias("p"))
        source = self.source

        @F.pandas_udf(kind)
        def udf(t: pd.Series, p: pd.Series) -> pd.Series:
            return pd.Series([out(source.at({a: list(b) for a, b in zip(x, y, strict=True)})) for x, y in zip(t, p, strict=True)])

        return docs.select("doc_id", udf("t", "p").alias("value"))

    def hits(self, index: Index) -> DataFrame:
        least = self.source.min_extent()
        s = self._run(index, "double", lambda found: float(sum(1 / max(e - a + 1 - least + 1, 1) for a, e, _ in found))).where("value > 0")
        v = F.col("value")
        score = v / (v + self.pivot) if self.exponent is None else F.pow(v, F.lit(self.exponent)) / (F.pow(v, F.lit(self.exponent)) + self.pivot**self.exponent)
        return s.select("doc_id", (self.weight * score).alias("score"))
