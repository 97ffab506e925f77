"""Phrases and spans.

Exact phrases join positions inside the JVM: the positions of each slot are shifted to the
phrase's start and intersected within the document. Sloppy phrases, unordered spans and spans
of spans work on a document's position arrays, which hold only the query's own terms.

A span is (s, e): the first position and the one after the last.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from . import query as Q
from .index import Index

SPANS = "array<struct<s:int,e:int>>"


def _slots(index: Index, name: str, slots: list[Callable[[Column], Column]]) -> DataFrame:
    """(doc_id, p0, p1, ...): the sorted positions of the terms each slot accepts, of documents with all."""
    any_ = functools.reduce(Column.__or__, [s(F.col("term")) for s in slots])
    rows = index.postings(name, any_)
    cols = [F.array_sort(F.flatten(F.collect_list(F.when(s(F.col("term")), F.col("positions"))))).alias(f"p{i}") for i, s in enumerate(slots)]
    out = rows.groupBy("doc_id").agg(*cols)
    return out.where(functools.reduce(Column.__and__, [F.size(f"p{i}") > 0 for i in range(len(slots))]))


def _equals(terms: list[str]) -> Callable[[Column], Column]:
    return lambda c: c.isin(*terms) if len(terms) > 1 else c == terms[0]


def _freq(index: Index, name: str, slots: list[Callable[[Column], Column]], offsets: list[int]) -> DataFrame:
    """(doc_id, freq): at how many places the slots' terms stand at their offsets."""
    docs = _slots(index, name, slots)
    starts = F.array_distinct(F.col("p0"))
    for i in range(1, len(slots)):
        starts = F.array_intersect(starts, _shifted(f"p{i}", offsets[i] - offsets[0]))
    return docs.select("doc_id", F.size(starts).cast("double").alias("freq")).where("freq > 0")


def _shifted(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def phrase_freq(index: Index, name: str, terms: list[str], offsets: list[int] | None = None) -> DataFrame:
    return _freq(index, name, [_equals([t]) for t in terms], offsets or list(range(len(terms))))


def multi_phrase_freq(index: Index, name: str, slots: list[list[str]], offsets: list[int] | None = None) -> DataFrame:
    """Any of several terms at each slot."""
    return _freq(index, name, [_equals(s) for s in slots], offsets or list(range(len(slots))))


def phrase_pattern_freq(index: Index, name: str, patterns: list[str]) -> DataFrame:
    """Wildcards at the slots."""
    slots = [(lambda c, p=p: c.rlike(Q.wildcard_regex(p))) if set(p) & set("*?") else _equals([p]) for p in patterns]
    return _freq(index, name, slots, list(range(len(slots))))


def ngram_phrase(n: int, terms: list[str]) -> tuple[list[str], list[int]]:
    """Only every n-th n-gram and the last are needed to tell a phrase of overlapping n-grams."""
    keep = [i for i in range(len(terms)) if i % n == 0 or i == len(terms) - 1]
    return [terms[i] for i in keep], keep


def sloppy_matches(positions: list[list[int]], offsets: list[int], terms: list[str], slop: int) -> list[tuple[int, int, int]]:
    """(distance, first, last) of each sloppy match: slots' positions, shifted to the phrase's start, lie within `slop`.

    The window advances at its smallest slot; a match is reported when the window can't be made
    smaller by that. Slots of the same term never use the same position.
    """
    slots = [[p - o for p in ps] for ps, o in zip(positions, offsets, strict=True)]
    n = len(slots)
    at = [0] * n
    same: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        same.setdefault(t, []).append(i)
    repeats = [g for g in same.values() if len(g) > 1]

    def settle() -> bool:
        """Moves repeats apart: of two slots on one position the later moves on."""
        moved = True
        while moved:
            moved = False
            for g in repeats:
                for a in range(len(g)):
                    for b in range(a + 1, len(g)):
                        i, j = g[a], g[b]
                        if slots[i][at[i]] + offsets[i] == slots[j][at[j]] + offsets[j]:
                            k = i if slots[i][at[i]] < slots[j][at[j]] or (slots[i][at[i]] == slots[j][at[j]] and offsets[i] < offsets[j]) else j
                            k = j if at[j] + 1 < len(slots[j]) else k
                            at[k] += 1
                            moved = True
                            if at[k] >= len(slots[k]):
                                return False
        return True

    out = []
    if any(not s for s in slots) or not settle():
        return out
    while True:
        low = min(range(n), key=lambda i: (slots[i][at[i]], offsets[i]))
        top = max(slots[i][at[i]] for i in range(n))
        nxt = min((slots[i][at[i]] for i in range(n) if i != low), default=top)
        best = top - slots[low][at[low]]
        span = (min(slots[i][at[i]] + offsets[i] for i in range(n)), max(slots[i][at[i]] + offsets[i] for i in range(n)))
        done = False
        while True:
            at[low] += 1
            if at[low] >= len(slots[low]) or not settle():
                done = True
                break
            now = slots[low][at[low]]
            if now > nxt:
                break
            top = max(slots[i][at[i]] for i in range(n))
            if top - now <= best:
                best = top - now
                span = (min(slots[i][at[i]] + offsets[i] for i in range(n)), max(slots[i][at[i]] + offsets[i] for i in range(n)))
        if best <= slop:
            out.append((best, *span))
        if done:
            return out


@dataclass(frozen=True)
class Phrase(Q.Query):
    """Terms at consecutive positions, or at `offsets`; with slop, within a total displacement. Scored as one term whose idf is the sum of the terms'."""

    field: str
    terms_: tuple[str, ...]
    offsets: tuple[int, ...] | None = None
    slop: int = 0

    def own_terms(self) -> set[tuple[str, str]]:
        return {(self.field, t) for t in self.terms_}

    def rewrite(self) -> Q.Query:
        if not self.terms_:
            return Q.MatchNone()
        return Q.Term(self.field, self.terms_[0]) if len(self.terms_) == 1 else self

    def freqs(self, index: Index) -> DataFrame:
        offsets = list(self.offsets or range(len(self.terms_)))
        if not self.slop:
            return phrase_freq(index, self.field, list(self.terms_), offsets)
        docs = _slots(index, self.field, [_equals([t]) for t in self.terms_])
        terms, slop = list(self.terms_), self.slop

        @F.pandas_udf("double")
        def freq(p: pd.Series) -> pd.Series:
            return pd.Series([sum(1 / (1 + d) for d, _, _ in sloppy_matches([list(x) for x in row], offsets, terms, slop)) for row in p])

        return docs.select("doc_id", freq(F.array(*[f"p{i}" for i in range(len(terms))])).alias("freq")).where("freq > 0")

    def hits(self, index: Index) -> DataFrame:
        simple = self.rewrite()
        if simple is not self:
            return simple.hits(index)
        n, total = index.stats(self.field)
        rows = index.postings(self.field, F.col("term").isin(*set(self.terms_))).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row a query term
        df = {r["term"]: r["df"] for r in rows}
        if any(t not in df for t in self.terms_):
            return Q.empty(index)
        weight = sum(sim.idf(n, df[t]) for t in self.terms_)
        tf, dl = F.col("freq"), F.col("dl")
        score = weight - weight / (1 + tf / (1.2 * (0.25 + 0.75 * dl / (total / n))))
        return self.freqs(index).join(index.lengths(self.field), "doc_id").select("doc_id", score.alias("score"))


# --- spans ----------------------------------------------------------------------------------------


class Span(Q.Query):
    """spans(index): (doc_id, spans), sorted by start and end."""

    def spans(self, index: Index) -> DataFrame:
        raise NotImplementedError

    def freqs(self, index: Index) -> DataFrame:
        """(doc_id, freq): the sum of 1 / (1 + width)."""
        width = lambda x: 1.0 / (1 + (x["e"] - x["s"]).cast("double"))
        return self.spans(index).select("doc_id", F.aggregate("spans", F.lit(0.0), lambda a, x: a + width(x)).alias("freq"))

    def hits(self, index: Index) -> DataFrame:
        """Span hits scored by their frequency."""
        return self.freqs(index).select("doc_id", F.col("freq").alias("score"))


def _sorted(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(spans))


def _one(p: Column) -> Column:
    return F.struct(p.cast("int").alias("s"), (p + 1).cast("int").alias("e"))


@dataclass(frozen=True)
class SpanTerm(Span):
    field: str
    term: str

    def own_terms(self) -> set[tuple[str, str]]:
        return {(self.field, self.term)}

    def spans(self, index: Index) -> DataFrame:
        return index.postings(self.field, F.col("term") == self.term).select("doc_id", F.transform("positions", _one).alias("spans"))


@dataclass(frozen=True)
class SpanMultiTerm(Span):
    """The terms of a prefix, wildcard, fuzzy or other multi-term query."""

    field: str
    query: Q.MultiTerm

    def spans(self, index: Index) -> DataFrame:
        rows = index.postings(self.field, self.query.accepts(F.col("term")))
        return rows.groupBy("doc_id").agg(F.flatten(F.collect_list("positions")).alias("p")).select("doc_id", _sorted(F.transform("p", _one)).alias("spans"))


@dataclass(frozen=True)
class SpanOr(Span):
    clauses: tuple[Span, ...]

    def children(self) -> list[Q.Query]:
        return list(self.clauses)

    def spans(self, index: Index) -> DataFrame:
        rows = Q.union_all([c.spans(index) for c in self.clauses])
        return rows.groupBy("doc_id").agg(_sorted(F.flatten(F.collect_list("spans"))).alias("spans"))


def SpanOrTerms(field: str, *terms: str) -> Span:  # noqa: N802
    return SpanOr(tuple(SpanTerm(field, t) for t in terms))


def _joined(index: Index, *clauses: Span, how: str = "inner") -> DataFrame:
    out = clauses[0].spans(index).withColumnRenamed("spans", "s0")
    for i, c in enumerate(clauses[1:], 1):
        out = out.join(c.spans(index).withColumnRenamed("spans", f"s{i}"), "doc_id", how)
    return out


def near_ordered(clauses: list[list[tuple[int, int]]], slop: int) -> list[tuple[int, int]]:
    """For each span of the first clause the earliest following span of every later one; gaps may sum to `slop`."""
    out = []
    for s, e in clauses[0]:
        end, gap = e, 0
        for c in clauses[1:]:
            nxt = next(((a, b) for a, b in c if a >= end), None)
            if nxt is None:
                break
            gap += nxt[0] - end
            end = nxt[1]
        else:
            if gap <= slop:
                out.append((s, end))
    return sorted(set(out))


def near_unordered(clauses: list[list[tuple[int, int]]], slop: int) -> list[tuple[int, int]]:
    """Windows of one span of each clause whose width without the spans' own is at most `slop`; the earliest span moves on."""
    at = [0] * len(clauses)
    out = []
    while all(i < len(c) for i, c in zip(at, clauses, strict=True)):
        now = [c[i] for i, c in zip(at, clauses, strict=True)]
        low, high = min(x[0] for x in now), max(x[1] for x in now)
        if high - low - sum(b - a for a, b in now) <= slop:
            out.append((low, high))
        first = min(range(len(now)), key=lambda i: now[i])
        at[first] += 1
    return sorted(set(out))


def _flat(spans: Column | str) -> Column:
    return F.flatten(F.transform(spans, lambda x: F.array(x["s"], x["e"])))


def _by_row(docs: DataFrame, names: list[str], fn: Callable[[list[list[tuple[int, int]]]], list[tuple[int, int]]]) -> DataFrame:
    """(doc_id, spans) by a function of each document's lists of spans, where there are any. Spans cross as flat arrays of numbers."""

    @F.pandas_udf("array<int>")
    def udf(rows: pd.Series) -> pd.Series:
        return pd.Series([[v for x in fn([list(zip(c[::2].tolist(), c[1::2].tolist(), strict=True)) for c in row]) for v in x] for row in rows])

    flat = docs.select("doc_id", udf(F.array(*[_flat(n) for n in names])).alias("f")).where(F.size("f") > 0)
    pair = F.transform(F.sequence(F.lit(0), F.size("f") - 1, F.lit(2)), lambda i: F.struct(F.get("f", i).alias("s"), F.get("f", i + 1).alias("e")))
    return flat.select("doc_id", pair.alias("spans"))


@dataclass(frozen=True)
class SpanNear(Span):
    clauses: tuple[Span, ...]
    slop: int
    ordered: bool = True

    def children(self) -> list[Q.Query]:
        return list(self.clauses)

    def spans(self, index: Index) -> DataFrame:
        docs = _joined(index, *self.clauses)
        slop, fn = self.slop, near_ordered if self.ordered else near_unordered
        return _by_row(docs, [f"s{i}" for i in range(len(self.clauses))], lambda c: fn(c, slop))


@dataclass(frozen=True)
class SpanGap(Span):
    """So many positions of anything, within a SpanNearGaps."""

    width: int


@dataclass(frozen=True)
class SpanNearGaps(Span):
    """An ordered near query with fixed gaps between some clauses."""

    clauses: tuple[Span, ...]
    slop: int = 0

    def spans(self, index: Index) -> DataFrame:
        real, shift, total = [], [], 0
        for c in self.clauses:
            if isinstance(c, SpanGap):
                total += c.width
            else:
                real.append(c)
                shift.append(total)
        slop, widths = self.slop, shift
        docs = _joined(index, *real)

        def fn(cs: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
            moved = [[(s - w, e - w) for s, e in c] for c, w in zip(cs, widths, strict=True)]
            return [(s, e + widths[-1]) for s, e in near_ordered(moved, slop)]

        return _by_row(docs, [f"s{i}" for i in range(len(real))], fn)


@dataclass(frozen=True)
class SpanNot(Span):
    """Spans that no excluded one touches within `pre` positions before or `post` after."""

    include: Span
    exclude: Span
    pre: int = 0
    post: int = 0

    def spans(self, index: Index) -> DataFrame:
        docs = _joined(index, self.include, self.exclude, how="left")
        touched = lambda x: F.exists(F.coalesce("s1", F.array().cast(SPANS)), lambda y: (y["s"] < x["e"] + self.post) & (y["e"] > x["s"] - self.pre))
        return docs.select("doc_id", F.filter("s0", lambda x: ~touched(x)).alias("spans")).where(F.size("spans") > 0)


@dataclass(frozen=True)
class SpanPositionRange(Span):
    query: Span
    start: int
    end: int

    def spans(self, index: Index) -> DataFrame:
        keep = F.filter("spans", lambda x: (x["s"] >= self.start) & (x["e"] <= self.end))
        return self.query.spans(index).select("doc_id", keep.alias("spans")).where(F.size("spans") > 0)


def SpanFirst(query: Span, end: int) -> Span:  # noqa: N802
    return SpanPositionRange(query, 0, end)


@dataclass(frozen=True)
class SpanContaining(Span):
    """Big spans that hold a little one."""

    big: Span
    little: Span

    def spans(self, index: Index) -> DataFrame:
        docs = _joined(index, self.big, self.little)
        keep = F.filter("s0", lambda b: F.exists("s1", lambda y: (y["s"] >= b["s"]) & (y["e"] <= b["e"])))
        return docs.select("doc_id", keep.alias("spans")).where(F.size("spans") > 0)


@dataclass(frozen=True)
class SpanWithin(Span):
    """Little spans that a big one holds."""

    little: Span
    big: Span

    def spans(self, index: Index) -> DataFrame:
        docs = _joined(index, self.little, self.big)
        keep = F.filter("s0", lambda x: F.exists("s1", lambda b: (x["s"] >= b["s"]) & (x["e"] <= b["e"])))
        return docs.select("doc_id", keep.alias("spans")).where(F.size("spans") > 0)


@dataclass(frozen=True)
class SpanPayload(Span):
    """Spans of a term at positions whose payload satisfies a predicate; `payloads` is a DataFrame (doc_id, pos, payload)."""

    term: SpanTerm
    payloads: DataFrame
    accepts: Callable[[Column], Column]

    def spans(self, index: Index) -> DataFrame:
        rows = self.term.spans(index).select("doc_id", F.explode("spans").alias("x"))
        ok = self.payloads.where(self.accepts(F.col("payload"))).select("doc_id", "pos")
        return rows.join(ok, (rows["doc_id"] == ok["doc_id"]) & (F.col("x.s") == ok["pos"])).groupBy(rows["doc_id"]).agg(F.array_sort(F.collect_list("x")).alias("spans"))


# --- token graphs -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class TermAutomaton(Q.Query):
    """Documents with a run of consecutive tokens that a graph of terms accepts, scored by how many places start one.

    transitions: (state, term or None for any term, next state); runs start at state 0 and end in an accepting state.
    """

    field: str
    transitions: tuple[tuple[int, str | None, int], ...]
    accept: tuple[int, ...]

    def own_terms(self) -> set[tuple[str, str]]:
        return {(self.field, t) for _, t, _ in self.transitions if t is not None}

    def hits(self, index: Index) -> DataFrame:
        terms = sorted({t for _, t, _ in self.transitions if t is not None})
        rows = index.postings(self.field, F.col("term").isin(*terms))
        docs = rows.groupBy("doc_id").agg(F.collect_list("term").alias("t"), F.collect_list("positions").alias("p")).join(index.lengths(self.field), "doc_id")
        edges, accept = self.transitions, set(self.accept)

        def count(terms: list[str], positions: list[list[int]], length: int) -> float:
            at = {p: t for t, ps in zip(terms, positions, strict=True) for p in ps}
            found = 0
            for start in range(length):
                states, p = {0}, start
                while states and p < length:
                    states = {n for s, t, n in edges if s in states and (t is None or at.get(p) == t)}
                    p += 1
                    if states & accept:
                        found += 1
                        break
            return float(found)

        @F.pandas_udf("double")
        def udf(t: pd.Series, p: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([count(list(a), [list(x) for x in b], int(c)) for a, b, c in zip(t, p, n, strict=True)])

        return docs.select("doc_id", udf("t", "p", "dl").alias("score")).where("score > 0")
