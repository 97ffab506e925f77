"""Reverse search: stored queries matched against arriving documents.

Every stored query is registered under one or more anchor terms, without which it can't match:
for alternatives one of each, for required clauses the one of most weight. Documents are joined
to queries by anchor (the presearcher), and only these candidates are verified on the
document's own positions.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import query as Q
from . import spans as S

ANY = "\0any"


@dataclass
class Memory:
    """An index of one document."""

    positions: dict[str, list[int]]

    @classmethod
    def of(cls, text: str | None, analyze: Callable[[str], list[str]]) -> Memory:
        out: dict[str, list[int]] = {}
        for i, t in enumerate(analyze(text or "")):
            out.setdefault(t, []).append(i)
        return cls(out)

    def score(self, q: Q.Query) -> float | None:
        """How often a query matches, or None. Scores add up term frequencies, without corpus statistics."""
        p = self.positions
        if isinstance(q, Q.MatchAll):
            return 1.0
        if isinstance(q, Q.MatchNone):
            return None
        if isinstance(q, (Q.Term, S.SpanTerm)):
            return float(len(p[q.term])) if q.term in p else None
        if isinstance(q, Q.Boost):
            s = self.score(q.query)
            return None if s is None else s * q.by
        if isinstance(q, Q.ConstantScore):
            return None if self.score(q.query) is None else q.score
        if isinstance(q, Q.DisjunctionMax):
            found = [s for s in map(self.score, q.queries) if s is not None]
            return max(found) + q.tie * (sum(found) - max(found)) if found else None
        if isinstance(q, Q.Boolean):
            total, should, required = 0.0, 0, False
            for occur, c in q.clauses:
                s = self.score(c)
                if occur in (Q.MUST, Q.FILTER):
                    required = True
                    if s is None:
                        return None
                    total += s if occur == Q.MUST else 0
                elif occur == Q.MUST_NOT:
                    if s is not None:
                        return None
                elif s is not None:
                    should += 1
                    total += s
            least = q.min_should or (0 if required else 1)
            return total if should >= least else None
        if isinstance(q, S.Phrase):
            lists = [p.get(t, []) for t in q.terms_]
            n = sum(1 / (1 + d) for d, _, _ in S.sloppy_matches(lists, list(q.offsets or range(len(lists))), list(q.terms_), q.slop)) if all(lists) else 0
            return float(n) if n else None
        if isinstance(q, Q.MultiTerm):
            test = _accepts(q)
            n = sum(len(v) for t, v in p.items() if test(t))
            return float(n) if n else None
        if isinstance(q, S.Span):
            n = len(self.spans(q))
            return float(n) if n else None
        raise TypeError(f"{type(q).__name__} can't be matched against single documents")

    def spans(self, q: S.Span) -> list[tuple[int, int]]:
        if isinstance(q, S.SpanTerm):
            return [(x, x + 1) for x in self.positions.get(q.term, [])]
        if isinstance(q, S.SpanMultiTerm):
            test = _accepts(q.query)
            return sorted((x, x + 1) for t, v in self.positions.items() if test(t) for x in v)
        if isinstance(q, S.SpanOr):
            return sorted({s for c in q.clauses for s in self.spans(c)})
        if isinstance(q, S.SpanNear):
            parts = [self.spans(c) for c in q.clauses]
            return (S.near_ordered if q.ordered else S.near_unordered)(parts, q.slop) if all(parts) else []
        raise TypeError(f"{type(q).__name__} can't be matched against single documents")


def _accepts(q: Q.MultiTerm) -> Callable[[str], bool]:
    from ..functions.strings import osa

    if isinstance(q, Q.Prefix):
        return lambda t: t.startswith(q.prefix)
    if isinstance(q, Q.Wildcard):
        return lambda t, r=re.compile(Q.wildcard_regex(q.pattern)): bool(r.match(t))
    if isinstance(q, Q.Regexp):
        return lambda t, r=re.compile(q.pattern): bool(r.fullmatch(t))
    if isinstance(q, Q.TermSet):
        return lambda t: t in q.values
    if isinstance(q, Q.TermRange):
        return lambda t: (q.low is None or t > q.low or (q.include_low and t == q.low)) and (q.high is None or t < q.high or (q.include_high and t == q.high))
    if isinstance(q, Q.Fuzzy):
        return lambda t: abs(len(t) - len(q.term)) <= q.max_edits and osa(t, q.term) <= q.max_edits
    raise TypeError(f"no test for {type(q).__name__}")


def length_weight(term: str) -> float:
    """Longer terms are rarer."""
    return float(len(term))


def frequency_weight(df: dict[str, int]) -> Callable[[str], float]:
    """Rarer terms weigh more; unknown ones most."""
    return lambda t: 1.0 / (1 + df.get(t, 0))


def combined_weight(*parts: Callable[[str], float]) -> Callable[[str], float]:
    return lambda t: functools.reduce(lambda a, w: a * w(t), parts, 1.0)


def anchors(q: Q.Query, weight: Callable[[str], float] = length_weight) -> set[str]:
    """Terms of which a matching document has at least one; ANY if that can't be told."""
    if isinstance(q, (Q.Term, S.SpanTerm)):
        return {q.term}
    if isinstance(q, (Q.Boost, Q.ConstantScore)):
        return anchors(q.query, weight)
    if isinstance(q, S.Phrase):
        return {max(q.terms_, key=lambda t: (weight(t), t))} if q.terms_ else {ANY}
    if isinstance(q, Q.TermSet):
        return set(q.values)
    if isinstance(q, Q.DisjunctionMax):
        return set().union(*(anchors(c, weight) for c in q.queries))
    if isinstance(q, S.SpanOr):
        return set().union(*(anchors(c, weight) for c in q.clauses))
    least = lambda sets: max(sets, key=lambda s: (ANY not in s, min((weight(t) for t in s), default=0)))
    if isinstance(q, S.SpanNear):
        return least([anchors(c, weight) for c in q.clauses])
    if isinstance(q, Q.Boolean):
        must = [anchors(c, weight) for o, c in q.clauses if o in (Q.MUST, Q.FILTER)]
        if must:
            return least(must)
        should = [anchors(c, weight) for o, c in q.clauses if o == Q.SHOULD]
        return set().union(*should) if should else {ANY}
    return {ANY}


def decompose(q: Q.Query) -> list[Q.Query]:
    """A disjunction's alternatives as queries of their own."""
    if isinstance(q, Q.Boolean) and q.clauses and all(o == Q.SHOULD for o, _ in q.clauses) and q.min_should <= 1:
        return [d for _, c in q.clauses for d in decompose(c)]
    if isinstance(q, Q.DisjunctionMax):
        return [d for c in q.queries for d in decompose(c)]
    return [q]


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


@dataclass
class Monitor:
    """Stored queries by name, and their matches in DataFrames of documents, static or streaming."""

    analyze: Callable[[str], list[str]] = words
    weight: Callable[[str], float] = length_weight
    passes: int = 1
    queries: dict[str, Q.Query] = field(default_factory=dict)

    def register(self, name: str, query: Q.Query) -> None:
        self.queries[name] = query

    def delete(self, *names: str) -> None:
        for n in names:
            self.queries.pop(n, None)

    def clear(self) -> None:
        self.queries.clear()

    def count(self) -> int:
        return len(self.queries)

    def anchor_table(self) -> list[tuple[str, str]]:
        """(term, name) pairs: a query's anchors."""
        return [(t, n) for n, q in self.queries.items() for d in decompose(q) for t in sorted(anchors(d, self.weight))]

    def match(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """(doc_id, query, score). Each document meets only the queries whose anchors it holds; works on streams."""
        by_term: dict[str, list[str]] = {}
        for t, n in self.anchor_table():
            by_term.setdefault(t, []).append(n)
        queries, analyze = dict(self.queries), self.analyze

        def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for b in batches:
                rows = []
                for k, t in zip(b["k"], b["t"], strict=True):
                    m = Memory.of(t, analyze)
                    names = set(by_term.get(ANY, ()))
                    for term in m.positions:
                        names.update(by_term.get(term, ()))
                    for n in sorted(names):
                        s = m.score(queries[n])
                        if s is not None:
                            rows.append((k, n, s))
                yield pd.DataFrame(rows, columns=["doc_id", "query", "score"])

        kind = docs.schema[key].dataType.simpleString()
        return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, query string, score double")

    def match_stored(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """As match(), with the presearch as a join of terms to anchors, for very many queries: documents are exploded, joined by term and verified."""
        spark = docs.sparkSession
        table = spark.createDataFrame(self.anchor_table() or [("", "")], "term string, query string")
        from ..functions.text import ascii_words

        # Words alone are exploded; a document's text is joined once, if some query may match it.
        terms = docs.select(F.col(key).alias("doc_id"), F.explode(F.array_append(F.array_distinct(ascii_words(F.col(text))), F.lit(ANY))).alias("term"))
        names = terms.join(table, "term").groupBy("doc_id").agg(F.collect_set("query").alias("names"))
        cand = names.join(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")), "doc_id")
        queries, analyze = dict(self.queries), self.analyze

        def run(batches):
            for b in batches:
                rows = []
                for k, t, names in zip(b["doc_id"], b["t"], b["names"], strict=True):
                    m = Memory.of(t, analyze)
                    rows += [(k, n, s) for n in names if n in queries and (s := m.score(queries[n])) is not None]
                yield pd.DataFrame(rows, columns=["doc_id", "query", "score"])

        return cand.mapInPandas(run, f"doc_id {docs.schema[key].dataType.simpleString()}, query string, score double")

    def explain(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """match() with the anchors that brought query and document together."""
        table = {}
        for t, n in self.anchor_table():
            table.setdefault(n, []).append(t)
        rows = docs.sparkSession.createDataFrame([(n, ",".join(t)) for n, t in table.items()] or [("", "")], "query string, anchors string")
        return self.match(docs, text, key).join(F.broadcast(rows), "query")  # one row a query

    def highlight(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """match() with the documents' text, terms of the query marked."""
        from .highlight import mark_all

        out = None
        for n, q in self.queries.items():
            terms = sorted({t for _, t in q.terms()})
            m = self.match(docs, text, key).where(F.col("query") == n).join(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")), "doc_id")
            m = m.select("doc_id", "query", (mark_all(F.col("t"), terms) if terms else F.col("t")).alias("highlighted"))
            out = m if out is None else out.union(m)
        return out
