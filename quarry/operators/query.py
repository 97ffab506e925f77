"""The query algebra: every query is a plan that yields hits, (doc_id, score).

Queries are plain values. `hits(index)` declares the DataFrame; nothing runs until an action.
Clauses of a boolean query are unioned and folded by one aggregation on doc_id, whatever their
number.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from .index import Index


class Query:
    """Base of all queries. score=False hits carry no meaningful score."""

    def hits(self, index: Index) -> DataFrame:
        raise NotImplementedError

    def rewrite(self) -> Query:
        """An equivalent simpler query, or itself."""
        return self

    def visit(self, fn: Callable[[Query], None]) -> None:
        """Calls fn on this query and all below it."""
        fn(self)
        for q in self.children():
            q.visit(fn)

    def children(self) -> list[Query]:
        return []

    def terms(self) -> set[tuple[str, str]]:
        """The (field, term) pairs of the tree."""
        out: set[tuple[str, str]] = set()

        def see(q: Query) -> None:
            out.update(q.own_terms())

        self.visit(see)
        return out

    def own_terms(self) -> set[tuple[str, str]]:
        return set()

    def boost(self, by: float) -> Query:
        return Boost(self, by)


def empty(index: Index) -> DataFrame:
    return index.ids().where(F.lit(False)).select("doc_id", F.lit(0.0).alias("score"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


@dataclass(frozen=True)
class MatchAll(Query):
    def hits(self, index: Index) -> DataFrame:
        return index.ids().select("doc_id", F.lit(1.0).alias("score"))


@dataclass(frozen=True)
class MatchNone(Query):
    def hits(self, index: Index) -> DataFrame:
        return empty(index)


@dataclass(frozen=True)
class Term(Query):
    field: str
    term: str

    def hits(self, index: Index) -> DataFrame:
        return index.scored(self.field, F.col("term") == self.term, most_terms=1).select("doc_id", "score")

    def own_terms(self) -> set[tuple[str, str]]:
        return {(self.field, self.term)}


MUST, SHOULD, MUST_NOT, FILTER = "must", "should", "must_not", "filter"


@dataclass(frozen=True)
class Boolean(Query):
    """Clauses (occur, query). MUST and SHOULD add scores, FILTER and MUST_NOT only decide. min_should counts SHOULD clauses."""

    clauses: tuple[tuple[str, Query], ...] = ()
    min_should: int = 0

    @classmethod
    def of(cls, must: Iterable[Query] = (), should: Iterable[Query] = (), must_not: Iterable[Query] = (), filter: Iterable[Query] = (), min_should: int = 0) -> Boolean:  # noqa: A002
        return cls((*((MUST, q) for q in must), *((FILTER, q) for q in filter), *((SHOULD, q) for q in should), *((MUST_NOT, q) for q in must_not)), min_should)

    def add(self, query: Query, occur: str) -> Boolean:
        return replace(self, clauses=(*self.clauses, (occur, query)))

    def children(self) -> list[Query]:
        return [q for o, q in self.clauses if o != MUST_NOT]

    def rewrite(self) -> Query:
        positive = [c for c in self.clauses if c[0] != MUST_NOT]
        if not positive:
            return MatchNone()
        if len(self.clauses) == 1 and self.min_should <= (self.clauses[0][0] == SHOULD):
            occur, q = self.clauses[0]
            return Boost(ConstantScore(q.rewrite()), 0.0) if occur == FILTER else q.rewrite()
        inner = tuple((o, q.rewrite()) for o, q in self.clauses)
        if any(o in (MUST, FILTER) and isinstance(q, MatchNone) for o, q in inner):
            return MatchNone()
        inner = tuple((o, q) for o, q in inner if not (o in (SHOULD, MUST_NOT) and isinstance(q, MatchNone)))
        return replace(self, clauses=inner)

    def hits(self, index: Index) -> DataFrame:
        required = [(o, q) for o, q in self.clauses if o in (MUST, FILTER)]
        should = [(o, q) for o, q in self.clauses if o == SHOULD]
        least = self.min_should or (0 if required else 1)
        if not required and not should or least > len(should):
            return empty(index)
        parts = []
        # Plain terms of one field are read in one pass; every other clause is a plan of its own.
        by_field: dict[str, dict[str, list[str]]] = {}
        for o, q in self.clauses:
            if isinstance(q, Term):
                by_field.setdefault(q.field, {}).setdefault(q.term, []).append(o)
            else:
                h = q.hits(index)
                parts.append(h.select("doc_id", (F.col("score") if o in (MUST, SHOULD) else F.lit(0.0)).alias("score"), *_flags(F.lit(o in (MUST, FILTER)).cast("int"), F.lit(o == SHOULD).cast("int"), F.lit(o == MUST_NOT).cast("int"))))
        for name, terms in by_field.items():
            rows = index.scored(name, F.col("term").isin(*terms), most_terms=len(terms))

            def times(*occurs: str, terms: dict[str, list[str]] = terms) -> Column:
                out = F.lit(0)
                for t, os in terms.items():
                    out = F.when(F.col("term") == t, sum(o in occurs for o in os)).otherwise(out)
                return out

            parts.append(rows.select("doc_id", (F.col("score") * times(MUST, SHOULD)).alias("score"), *_flags(times(MUST, FILTER), times(SHOULD), times(MUST_NOT))))
        folded = union_all(parts).groupBy("doc_id").agg(F.sum("score").alias("score"), F.sum("r").alias("r"), F.sum("s").alias("s"), F.sum("x").alias("x"))
        return folded.where((F.col("r") == len(required)) & (F.col("s") >= least) & (F.col("x") == 0)).select("doc_id", "score")


def _flags(r: Column, s: Column, x: Column) -> list[Column]:
    return [r.alias("r"), s.alias("s"), x.alias("x")]


@dataclass(frozen=True)
class ConstantScore(Query):
    query: Query
    score: float = 1.0

    def hits(self, index: Index) -> DataFrame:
        return self.query.hits(index).select("doc_id", F.lit(self.score).alias("score"))

    def children(self) -> list[Query]:
        return [self.query]


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    by: float

    def hits(self, index: Index) -> DataFrame:
        return self.query.hits(index).select("doc_id", (F.col("score") * float(self.by)).alias("score"))

    def children(self) -> list[Query]:
        return [self.query]


@dataclass(frozen=True)
class DisjunctionMax(Query):
    """The best of several scores, plus `tie` times the others."""

    queries: tuple[Query, ...]
    tie: float = 0.0

    def hits(self, index: Index) -> DataFrame:
        if not self.queries:
            return empty(index)
        h = union_all([q.hits(index) for q in self.queries]).groupBy("doc_id").agg(F.max("score").alias("m"), F.sum("score").alias("t"))
        return h.select("doc_id", (F.col("m") + self.tie * (F.col("t") - F.col("m"))).alias("score"))

    def children(self) -> list[Query]:
        return list(self.queries)


# --- terms chosen by a predicate -------------------------------------------------------------

#: Rewrites of queries that expand to terms.
CONSTANT, SCORING, TOP_TERMS, BLENDED, AUTO = "constant", "scoring", "top_terms", "blended", "auto"
#: An automatic rewrite names up to so many terms one by one; beyond, it is the terms' predicate.
AUTO_TERMS = 350


class TooManyClauses(ValueError):
    """A scoring rewrite expanded to more terms than allowed."""


@dataclass(frozen=True)
class MultiTerm(Query):
    """Documents with any term that accepts() takes.

    constant: every hit scores 1. scoring: the matching terms' scores are added, and more than
    max_clauses terms are an error. top_terms: as scoring, of the max_clauses terms of largest boost.
    blended: as constant; the postings of all terms are read in one pass, so that none need be
    merged one by one. auto: as constant; a few terms are named, so that stored postings are read
    by their row groups' bounds.
    """

    field: str = ""
    rewrite_as: str = CONSTANT
    max_clauses: int = 1024

    def accepts(self, term: Column) -> Column:
        raise NotImplementedError

    def term_boost(self, term: Column) -> Column:
        return F.lit(1.0)

    def expand(self, index: Index) -> DataFrame:
        """(term, boost), by falling boost and rising term."""
        t = index.terms(self.field).where(self.accepts(F.col("term")))
        return t.select("term", self.term_boost(F.col("term")).alias("boost")).orderBy(F.desc("boost"), "term")

    def hits(self, index: Index) -> DataFrame:
        if self.rewrite_as == AUTO:
            few = [r["term"] for r in self.expand(index).limit(AUTO_TERMS + 1).collect()]
            if len(few) <= AUTO_TERMS:
                return index.postings(self.field, F.col("term").isin(*few)).select("doc_id").distinct().select("doc_id", F.lit(1.0).alias("score")) if few else empty(index)
        if self.rewrite_as in (CONSTANT, BLENDED, AUTO):
            return index.postings(self.field, self.accepts(F.col("term"))).select("doc_id").distinct().select("doc_id", F.lit(1.0).alias("score"))
        if self.rewrite_as == SCORING:
            if len(self.expand(index).limit(self.max_clauses + 1).collect()) > self.max_clauses:
                raise TooManyClauses(f"more than {self.max_clauses} terms")
            return index.scored(self.field, self.accepts(F.col("term")), self.term_boost(F.col("term"))).groupBy("doc_id").agg(F.sum("score").alias("score"))
        chosen = {r["term"]: r["boost"] for r in self.expand(index).limit(self.max_clauses).collect()}  # at most max_clauses
        if not chosen:
            return empty(index)
        boost = F.element_at(F.create_map(*[F.lit(x) for kv in chosen.items() for x in kv]), F.col("term"))
        return index.scored(self.field, F.col("term").isin(*chosen), boost, most_terms=len(chosen)).groupBy("doc_id").agg(F.sum("score").alias("score"))


@dataclass(frozen=True)
class Prefix(MultiTerm):
    prefix: str = ""

    def accepts(self, term: Column) -> Column:
        return term.startswith(self.prefix)


def wildcard_regex(pattern: str) -> str:
    """A pattern of * (any run), ? (any character) and \\ (escape) as a regular expression."""
    out, escaped = [], False
    for c in pattern:
        if escaped or c not in "*?\\":
            out.append(re.escape(c))
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            out.append(".*" if c == "*" else ".")
    return "(?s)^" + "".join(out) + ("\\\\" if escaped else "") + "$"


@dataclass(frozen=True)
class Wildcard(MultiTerm):
    pattern: str = ""

    def accepts(self, term: Column) -> Column:
        return term.rlike(wildcard_regex(self.pattern))


@dataclass(frozen=True)
class Regexp(MultiTerm):
    """The whole term matches."""

    pattern: str = ""

    def accepts(self, term: Column) -> Column:
        return term.rlike(f"^(?:{self.pattern})$")


@dataclass(frozen=True)
class Automaton(Regexp):
    """Terms of a regular language, given as an expression."""


@dataclass(frozen=True)
class TermRange(MultiTerm):
    """Terms in byte order between bounds; None is open."""

    low: str | None = None
    high: str | None = None
    include_low: bool = True
    include_high: bool = True

    def accepts(self, term: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (term >= self.low if self.include_low else term > self.low)
        if self.high is not None:
            out = out & (term <= self.high if self.include_high else term < self.high)
        return out


@dataclass(frozen=True)
class TermSet(MultiTerm):
    values: tuple[str, ...] = ()

    def accepts(self, term: Column) -> Column:
        return term.isin(*sorted(set(self.values)))


@dataclass(frozen=True)
class Fuzzy(MultiTerm):
    """Terms within max_edits, of which the closest max_clauses count, each boosted by 1 - edits / (max_edits + 1).

    With transpositions, a swap of neighbours is one edit.
    """

    term: str = ""
    max_edits: int = 2
    prefix_length: int = 0
    transpositions: bool = True
    rewrite_as: str = TOP_TERMS
    max_clauses: int = 50

    def distance(self, term: Column) -> Column:
        from ..functions.strings import osa_distance

        plain = F.levenshtein(term, F.lit(self.term), self.max_edits + (self.max_edits if self.transpositions else 0))
        if not self.transpositions:
            return F.when(plain >= 0, plain)
        # A swap costs two plain edits, so at most twice max_edits pass to the exact distance.
        return F.when(plain < 0, F.lit(None)).when(plain <= 1, plain).otherwise(osa_distance(term, self.term))

    def accepts(self, term: Column) -> Column:
        out = F.coalesce(self.distance(term) <= self.max_edits, F.lit(False))
        near = F.length(term).between(len(self.term) - self.max_edits, len(self.term) + self.max_edits)
        return near & term.startswith(self.term[: self.prefix_length]) & out

    def term_boost(self, term: Column) -> Column:
        return F.lit(1.0) - self.distance(term) / float(self.max_edits + 1)


# --- predicates on columns -------------------------------------------------------------------


@dataclass(frozen=True)
class Where(Query):
    """Documents whose columns satisfy an SQL expression; null isn't a match. Constant score."""

    expr: str

    def hits(self, index: Index) -> DataFrame:
        return index.docs.where(F.expr(self.expr)).select(F.col(index.key).alias("doc_id"), F.lit(1.0).alias("score"))


class ColumnQuery(Query):
    """Documents whose columns satisfy predicate(); null isn't a match. The filter reaches the scan."""

    def predicate(self) -> Column:
        raise NotImplementedError

    def hits(self, index: Index) -> DataFrame:
        return index.docs.where(self.predicate()).select(F.col(index.key).alias("doc_id"), F.lit(1.0).alias("score"))


@dataclass(frozen=True)
class Range(ColumnQuery):
    """A value, or any of an array column's, between bounds; None is open."""

    field: str
    low: Any = None
    high: Any = None
    include_low: bool = True
    include_high: bool = True
    multi_valued: bool = False

    def _one(self, c: Column) -> Column:
        out = c.isNotNull()
        if self.low is not None:
            out = out & (c >= F.lit(self.low) if self.include_low else c > F.lit(self.low))
        if self.high is not None:
            out = out & (c <= F.lit(self.high) if self.include_high else c < F.lit(self.high))
        return out

    def predicate(self) -> Column:
        return F.exists(self.field, self._one) if self.multi_valued else self._one(F.col(self.field))


@dataclass(frozen=True)
class IndexOrValues(Query):
    """Two forms of one query, by index and by column values, with the same hits: the columns' where they are scanned anyway, that is, unless postings are stored."""

    index: Query
    values: Query

    def hits(self, index: Index) -> DataFrame:
        return (self.index if index.stored is not None else self.values).hits(index)

    def children(self) -> list[Query]:
        return [self.index]


@dataclass(frozen=True)
class PointRange(ColumnQuery):
    """An inclusive box over several columns."""

    fields: tuple[str, ...]
    low: tuple
    high: tuple

    def predicate(self) -> Column:
        return functools.reduce(Column.__and__, [F.col(f).between(F.lit(a), F.lit(b)) for f, a, b in zip(self.fields, self.low, self.high, strict=True)])


@dataclass(frozen=True)
class PointSet(ColumnQuery):
    """A value, or any of an array column's, in a set; of one value it is equality."""

    field: str
    values: tuple
    multi_valued: bool = False

    def predicate(self) -> Column:
        if self.multi_valued:
            return F.arrays_overlap(F.col(self.field), F.array(*[F.lit(v) for v in self.values]))
        return F.col(self.field).isin(*self.values)


INTERSECTS, WITHIN, CONTAINS, CROSSES = "intersects", "within", "contains", "crosses"


def range_relation(low: list[Column], high: list[Column], qlow: list, qhigh: list, relation: str) -> Column:
    """How stored ranges, by dimension, relate to a query's: within, that is, the stored range lies in the query's."""
    each = lambda f: functools.reduce(Column.__and__, [f(a, b, F.lit(p), F.lit(q)) for a, b, p, q in zip(low, high, qlow, qhigh, strict=True)])
    meets = each(lambda a, b, p, q: (a <= q) & (b >= p))
    within = each(lambda a, b, p, q: (a >= p) & (b <= q))
    contains = each(lambda a, b, p, q: (a <= p) & (b >= q))
    return {INTERSECTS: meets, WITHIN: within, CONTAINS: contains, CROSSES: meets & ~within}[relation]


@dataclass(frozen=True)
class RangeField(ColumnQuery):
    """Stored ranges in columns (lows, highs), a pair for each dimension, against a query's."""

    lows: tuple[str, ...]
    highs: tuple[str, ...]
    qlow: tuple
    qhigh: tuple
    relation: str = INTERSECTS

    def predicate(self) -> Column:
        return range_relation([F.col(c) for c in self.lows], [F.col(c) for c in self.highs], list(self.qlow), list(self.qhigh), self.relation)


@dataclass(frozen=True)
class MultiRange(ColumnQuery):
    """Any of several ranges."""

    field: str
    ranges: tuple[tuple[Any, Any], ...]

    def predicate(self) -> Column:
        return functools.reduce(Column.__or__, [F.col(self.field).between(F.lit(a), F.lit(b)) for a, b in self.ranges], F.lit(False))


@dataclass(frozen=True)
class Exists(ColumnQuery):
    field: str

    def predicate(self) -> Column:
        return F.col(self.field).isNotNull()


# --- several terms as one ---------------------------------------------------------------------


@dataclass(frozen=True)
class Synonym(Query):
    """Several terms scored as one: frequencies are added; df is the largest, ttf the sum."""

    field: str
    weights: tuple[tuple[str, float], ...]

    @classmethod
    def of(cls, name: str, *terms: str) -> Synonym:
        return cls(name, tuple((t, 1.0) for t in terms))

    def own_terms(self) -> set[tuple[str, str]]:
        return {(self.field, t) for t, _ in self.weights}

    def hits(self, index: Index) -> DataFrame:
        terms = dict(self.weights)
        p = index.postings(self.field, F.col("term").isin(*terms)).select("doc_id", "term", "tf")
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in terms.items() for x in kv]), F.col("term"))
        tf = p.groupBy("doc_id").agg(F.sum(F.col("tf") * weight).alias("tf"))
        stats = p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf")).agg(F.max("df").alias("df"), F.sum("ttf").alias("ttf"))
        n, total = index.stats(self.field)
        s = sim.Stats(F.col("tf"), F.col("dl"), F.col("df"), F.col("ttf"), n, total)
        return tf.join(index.lengths(self.field), "doc_id").crossJoin(F.broadcast(stats)).select("doc_id", sim.of_field(index.similarity, self.field)(s).alias("score"))  # one row


@dataclass(frozen=True)
class Blended(Query):
    """Terms of several fields, each scored with the largest df and the summed ttf of all."""

    terms_: tuple[tuple[str, str, float], ...]

    def own_terms(self) -> set[tuple[str, str]]:
        return {(f, t) for f, t, _ in self.terms_}

    def hits(self, index: Index) -> DataFrame:
        rows = []
        for f, t, b in self.terms_:
            n, total = index.stats(f)
            p = index.postings(f, F.col("term") == t).select("doc_id", "tf").join(index.lengths(f), "doc_id")
            rows.append(p.select("doc_id", "tf", "dl", F.lit(f).alias("f"), F.lit(t).alias("t"), F.lit(float(b)).alias("b"), F.lit(n).alias("n"), F.lit(total).alias("total")))
        p = union_all(rows)
        stats = p.groupBy("f", "t").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf")).agg(F.max("df").alias("df"), F.sum("ttf").alias("ttf"))
        fn = sim.of_field(index.similarity, self.terms_[0][0])
        s = sim.Stats(*(F.col(c) for c in ("tf", "dl", "df", "ttf", "n", "total", "b")))
        return p.crossJoin(F.broadcast(stats)).select("doc_id", fn(s).alias("score")).groupBy("doc_id").agg(F.sum("score").alias("score"))  # one row


@dataclass(frozen=True)
class CombinedFields(Query):
    """BM25F: weighted frequencies and lengths of several fields are added before scoring; a document has the field if it has any."""

    fields: tuple[tuple[str, float], ...]
    query_terms: tuple[str, ...]

    def own_terms(self) -> set[tuple[str, str]]:
        return {(f, t) for f, _ in self.fields for t in self.query_terms}

    def hits(self, index: Index) -> DataFrame:
        p = union_all([index.postings(f, F.col("term").isin(*self.query_terms)).select("doc_id", "term", (F.col("tf") * float(w)).alias("tf")) for f, w in self.fields])
        tf = p.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
        dl = union_all([index.lengths(f).select("doc_id", (F.col("dl") * float(w)).alias("dl")) for f, w in self.fields]).groupBy("doc_id").agg(F.sum("dl").alias("dl"))
        n, total = dl.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0.0))).first()
        stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
        s = sim.Stats(F.col("tf"), F.col("dl"), F.col("df"), F.col("ttf"), n, total)
        fn = sim.of_field(index.similarity, self.fields[0][0])
        return tf.join(stats, "term").join(dl, "doc_id").select("doc_id", fn(s).alias("score")).groupBy("doc_id").agg(F.sum("score").alias("score"))


@dataclass(frozen=True)
class CommonTerms(Query):
    """Terms split by document frequency: the rare ones decide, the common ones only add to the score.

    Above max_frequency (a share below 1, else a count) a term is common. Without rare terms all
    common ones must match. min_rare: how many rare ones must (0: by `rare_all` all or any).
    """

    field: str
    query_terms: tuple[str, ...]
    max_frequency: float = 0.01
    rare_all: bool = True
    min_rare: int = 0

    def own_terms(self) -> set[tuple[str, str]]:
        return {(self.field, t) for t in self.query_terms}

    def plan(self, index: Index) -> Query:
        rows = index.postings(self.field, F.col("term").isin(*self.query_terms)).groupBy("term").agg(F.count("*").alias("df")).collect()  # a row a query term
        df = {r["term"]: r["df"] for r in rows}
        limit = math.ceil(self.max_frequency * index.docs.count()) if self.max_frequency < 1 else self.max_frequency
        rare = [Term(self.field, t) for t in self.query_terms if df.get(t, 0) <= limit]
        common = [Term(self.field, t) for t in self.query_terms if df.get(t, 0) > limit]
        if not rare:
            return Boolean.of(must=common)
        low = Boolean.of(must=rare) if self.rare_all and not self.min_rare else Boolean.of(should=rare, min_should=self.min_rare)
        return Boolean.of(must=[low], should=[Boolean.of(should=common)] if common else [])

    def hits(self, index: Index) -> DataFrame:
        return self.plan(index).hits(index) if self.query_terms else empty(index)


@dataclass(frozen=True)
class Covering(Query):
    """Documents that match at least as many queries as their column says (at least one); scores are added."""

    queries: tuple[Query, ...]
    minimum: str

    def children(self) -> list[Query]:
        return list(self.queries)

    def hits(self, index: Index) -> DataFrame:
        h = union_all([q.hits(index) for q in self.queries]).groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("k"))
        need = index.docs.select(F.col(index.key).alias("doc_id"), F.greatest(F.lit(1), F.expr(self.minimum)).alias("need"))
        return h.join(need, "doc_id").where("k >= need").select("doc_id", "score")


@dataclass(frozen=True)
class FuzzyLikeThis(Query):
    """The best max_terms fuzzy expansions of all words of a text, as a disjunction."""

    field: str
    words: tuple[str, ...]
    max_edits: int = 1
    prefix_length: int = 0
    max_terms: int = 25

    def hits(self, index: Index) -> DataFrame:
        t = index.terms(self.field)
        found = union_all([t.where(q.accepts(F.col("term"))).select("term", q.term_boost(F.col("term")).alias("boost")) for w in self.words for q in [Fuzzy(self.field, term=w, max_edits=self.max_edits, prefix_length=self.prefix_length)]])
        best = {r["term"]: r["boost"] for r in found.groupBy("term").agg(F.max("boost").alias("boost")).orderBy(F.desc("boost"), "term").limit(self.max_terms).collect()}
        if not best:
            return empty(index)
        boost = F.element_at(F.create_map(*[F.lit(x) for kv in best.items() for x in kv]), F.col("term"))
        return index.scored(self.field, F.col("term").isin(*best), boost).groupBy("doc_id").agg(F.sum("score").alias("score"))


NearestFuzzy = FuzzyLikeThis


@dataclass(frozen=True)
class MoreLikeThis(Query):
    """Documents like a document or a list of words.

    Its terms weigh (1 + log10 tf) log10(n / (df + 1)); terms with fewer than min_tf occurrences
    or min_df documents, or in more than max_df_percent of all documents, don't count. The best
    max_terms make a disjunction of which `match_percent` must match. The document itself is a hit.
    """

    field: str
    like: int | tuple[str, ...]
    min_tf: int = 2
    min_df: int = 5
    max_df_percent: int = 95
    max_terms: int = 25
    match_percent: float = 0.0
    boost_terms: bool = False

    def interesting(self, index: Index) -> DataFrame:
        """(term, tf, df, weight), best first."""
        if isinstance(self.like, tuple):
            own = index.docs.sparkSession.createDataFrame([(w,) for w in self.like], "term string")
        else:
            own = index.tokens(self.field).where(F.col("doc_id") == self.like).select("term")
        own = own.groupBy("term").agg(F.count("*").alias("tf")).where(F.col("tf") >= self.min_tf)
        n = index.docs.count()
        t = index.terms(self.field).join(own, "term").where((F.col("df") >= self.min_df) & (F.col("df") <= n * self.max_df_percent // 100))
        w = (1 + F.log10("tf")) * F.log10(F.lit(float(n)) / (F.col("df") + 1))
        return t.select("term", "tf", "df", w.alias("weight")).orderBy(F.desc("weight"), "term").limit(self.max_terms)

    def plan(self, index: Index) -> Query:
        rows = self.interesting(index).collect()  # at most max_terms
        best = rows[0]["weight"] if rows else 1.0
        clauses = [Boost(Term(self.field, r["term"]), r["weight"] / best) if self.boost_terms else Term(self.field, r["term"]) for r in rows]
        return Boolean.of(should=clauses, min_should=math.ceil(self.match_percent * len(clauses)))

    def hits(self, index: Index) -> DataFrame:
        return self.plan(index).hits(index)


# --- scores from columns ------------------------------------------------------------------------


@dataclass(frozen=True)
class FunctionScore(Query):
    """A query's hits scored by an SQL expression over the document's columns and `score`."""

    query: Query
    expr: str
    multiply: bool = False

    def children(self) -> list[Query]:
        return [self.query]

    def hits(self, index: Index) -> DataFrame:
        h = self.query.hits(index).join(index.docs.withColumnRenamed(index.key, "doc_id"), "doc_id")
        value = F.expr(self.expr).cast("double")
        return h.select("doc_id", (F.col("score") * value if self.multiply else value).alias("score"))


@dataclass(frozen=True)
class FunctionQuery(Query):
    """All documents, scored by an SQL expression."""

    expr: str

    def hits(self, index: Index) -> DataFrame:
        return index.docs.select(F.col(index.key).alias("doc_id"), F.expr(self.expr).cast("double").alias("score"))


@dataclass(frozen=True)
class FunctionRange(Query):
    """Documents whose expression lies in a range, scored by it."""

    expr: str
    low: float | None = None
    high: float | None = None

    def hits(self, index: Index) -> DataFrame:
        h = FunctionQuery(self.expr).hits(index)
        return h.where(Range("score", self.low, self.high).predicate())


@dataclass(frozen=True)
class Feature(Query):
    """A feature's value as a score: raw, or saturated, logarithmic or sigmoid."""

    expr: str
    function: str = "saturation"
    pivot: float = 1.0
    weight: float = 1.0
    exponent: float = 1.0

    def hits(self, index: Index) -> DataFrame:
        v = F.expr(self.expr).cast("double")
        x = {"raw": v, "saturation": v / (v + self.pivot), "log": F.log(self.pivot + v), "sigmoid": F.pow(v, F.lit(self.exponent)) / (F.pow(v, F.lit(self.exponent)) + self.pivot**self.exponent)}[self.function]
        return index.docs.where(v > 0).select(F.col(index.key).alias("doc_id"), (self.weight * x).alias("score"))


@dataclass(frozen=True)
class DistanceFeature(Query):
    """weight * pivot / (pivot + |value - origin|)."""

    expr: str
    origin: float
    pivot: float
    weight: float = 1.0

    def hits(self, index: Index) -> DataFrame:
        v = F.expr(self.expr).cast("double")
        return index.docs.where(v.isNotNull()).select(F.col(index.key).alias("doc_id"), (self.weight * self.pivot / (self.pivot + F.abs(v - self.origin))).alias("score"))


@dataclass(frozen=True)
class DocAndScore(Query):
    """Hits computed elsewhere: a DataFrame (doc_id, score)."""

    frame: DataFrame = field(compare=False)

    def hits(self, index: Index) -> DataFrame:
        return self.frame.select("doc_id", F.col("score").cast("double").alias("score"))


@dataclass(frozen=True)
class RescoreTop(Query):
    """Only the best n hits, scored anew by a second query where it matches: first + weight * second."""

    query: Query
    second: Query
    n: int
    weight: float = 1.0

    def hits(self, index: Index) -> DataFrame:
        top = self.query.hits(index).orderBy(F.desc("score"), "doc_id").limit(self.n)
        s = self.second.hits(index).withColumnRenamed("score", "s2")
        return top.join(s, "doc_id", "left").select("doc_id", (F.col("score") + self.weight * F.coalesce("s2", F.lit(0.0))).alias("score"))


@dataclass(frozen=True)
class IndriAnd(Query):
    """Weighted mean of smoothed log-probabilities; a term the document lacks counts with what smoothing gives it. Documents with any term are hits."""

    field: str
    weights: tuple[tuple[str, float], ...]
    mu: float = 2000.0

    def hits(self, index: Index) -> DataFrame:
        terms = dict(self.weights)
        p = index.postings(self.field, F.col("term").isin(*terms)).select("doc_id", "term", "tf")
        _, total = index.stats(self.field)
        ttf = {r["term"]: r["ttf"] for r in p.groupBy("term").agg(F.sum("tf").alias("ttf")).collect()}  # a row a query term
        tf = p.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
        weight = sum(terms.values())
        score = F.lit(0.0)
        for i, (t, w) in enumerate(terms.items()):
            prob = (ttf.get(t, 0) + 1) / (total + 1)
            score = score + w / weight * F.log((F.col(f"tf{i}") + self.mu * prob) / (F.col("dl") + self.mu))
        return tf.join(index.lengths(self.field), "doc_id").select("doc_id", score.alias("score"))


def named_matches(index: Index, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, names): which named queries match a document, sorted."""
    rows = [q.hits(index).select("doc_id", F.lit(n).alias("name")) for n, q in queries.items()]
    return union_all(rows).groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def match_positions(index: Index, name: str, terms: Iterable[str]) -> DataFrame:
    """(doc_id, term, positions) of the terms."""
    return index.postings(name, F.col("term").isin(*terms)).select("doc_id", "term", "positions")


def explain(index: Index, name: str, term: str) -> DataFrame:
    """(doc_id, tf, dl, df, n, avgdl, idf, score): the parts of a BM25 term score."""
    n, total = index.stats(name)
    hits = index.postings(name, F.col("term") == term).select("doc_id", "tf")
    df = hits.count()
    s = sim.Stats(F.col("tf"), F.col("dl"), df, 0, n, total)
    return hits.join(index.lengths(name), "doc_id").select("doc_id", "tf", "dl", F.lit(df).alias("df"), F.lit(n).alias("n"), F.lit(total / max(1, n)).alias("avgdl"), F.lit(sim.idf(n, df)).alias("idf"), sim.bm25()(s).alias("score"))


# --- set operations on hits -----------------------------------------------------------------------


def union(*hits: DataFrame) -> DataFrame:
    """Documents of any, scores added."""
    return union_all(list(hits)).groupBy("doc_id").agg(F.sum("score").alias("score"))


def intersection(*hits: DataFrame) -> DataFrame:
    """Documents of all, scores added."""
    marked = [h.select("doc_id", "score", F.lit(i).alias("i")) for i, h in enumerate(hits)]
    return union_all(marked).groupBy("doc_id").agg(F.sum("score").alias("score"), F.count_distinct("i").alias("k")).where(F.col("k") == len(hits)).select("doc_id", "score")


def difference(required: DataFrame, excluded: DataFrame) -> DataFrame:
    return required.join(excluded.select("doc_id"), "doc_id", "left_anti")


def required_optional(required: DataFrame, optional: DataFrame) -> DataFrame:
    """Documents of the first; the second only adds to scores."""
    return required.join(optional.withColumnRenamed("score", "s2"), "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"))
