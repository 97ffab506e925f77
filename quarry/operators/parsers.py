"""Query-string parsers: classic, simple, multi-field, complex phrase, surround and XML, all to the query algebra."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from . import query as Q
from . import spans as S

SPECIAL = set('+-!():^[]"{}~*?\\/|&')


class ParseError(ValueError):
    """A query string that the grammar doesn't accept."""


def escape(text: str) -> str:
    """With a backslash before every character of the syntax."""
    return "".join("\\" + c if c in SPECIAL else c for c in text)


def unescape(text: str) -> str:
    return re.sub(r"\\u([0-9A-Fa-f]{4})|\\(.)", lambda m: chr(int(m[1], 16)) if m[1] else m[2], text, flags=re.S)


_TERM_CHAR = r'(?:\\u[0-9A-Fa-f]{4}|\\.|[^\s+\-!(){}\[\]^"~*?:\\/])'
_TERM = rf'(?:{_TERM_CHAR}|[*?])(?:{_TERM_CHAR}|[*?\-+])*'
_LEX = re.compile(
    rf"""(?P<ws>\s+)|(?P<and>AND(?![^\s()])|&&)|(?P<or>OR(?![^\s()])|\|\|)|(?P<not>NOT(?![^\s()])|!)|(?P<plus>\+)|(?P<minus>-)|(?P<lp>\()|(?P<rp>\))|(?P<colon>:)|(?P<boost>\^\d+(?:\.\d+)?)|(?P<fuzz>~(?:\d+(?:\.\d+)?)?)|(?P<quoted>"(?:\\.|[^"\\])*")|(?P<regex>/(?:\\.|[^/\\])+/)|(?P<range>[\[{{]\s*(?:"(?:\\.|[^"\\])*"|[^\s\]}}]+)\s+TO\s+(?:"(?:\\.|[^"\\])*"|[^\s\]}}]+)\s*[\]}}])|(?P<term>{_TERM})""",
    re.X,
)


@dataclass
class ClassicParser:
    """field:term, AND OR NOT && || !, + and -, "phrases"~slop, fuzzy~n, boosts^b, wildcards, [a TO b}, /expressions/ and groups."""

    default_field: str
    analyzer: Callable[[str], list[str]] = lambda s: [w for w in re.split(r"[^a-z0-9]+", s.lower()) if w]
    default_and: bool = False
    slop: int = 0
    allow_leading_wildcard: bool = False
    fuzzy_prefix: int = 0
    fuzzy_edits: int = 2
    precedence: bool = False
    extensions: dict[str, Callable[[str, str], Q.Query]] = field(default_factory=dict)

    def parse(self, text: str) -> Q.Query:
        self._tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ParseError(f"{text[at]!r} at {at} isn't expected in {text!r}")
            if m.lastgroup != "ws":
                self._tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self._at = 0
        out = self._query(self.default_field)
        if self._at < len(self._tokens):
            raise ParseError(f"{self._tokens[self._at][1]!r} isn't expected")
        return out

    def _peek(self, n: int = 0) -> str | None:
        return self._tokens[self._at + n][0] if self._at + n < len(self._tokens) else None

    def _next(self) -> tuple[str, str]:
        if self._at >= len(self._tokens):
            raise ParseError("the query ends too early")
        self._at += 1
        return self._tokens[self._at - 1]

    def _query(self, name: str) -> Q.Query:
        parts: list[tuple[str | None, str | None, Q.Query | None]] = []  # operator before, modifier, clause
        while self._peek() not in (None, "rp"):
            op = mod = None
            if self._peek() in ("and", "or"):
                if not parts:
                    raise ParseError("an operator stands first")
                op = self._next()[0]
            if self._peek() in ("not", "plus", "minus"):
                mod = self._next()[0]
            parts.append((op, mod, self._clause(name)))
        parts = [p for p in parts if p[2] is not None]
        if self.precedence and any(p[0] == "or" for p in parts) and any(p[0] == "and" for p in parts):
            groups, cur = [], [parts[0]]
            for p in parts[1:]:
                if p[0] == "and":
                    cur.append(p)
                else:
                    groups.append(cur)
                    cur = [(None, *p[1:])]
            groups.append(cur)
            return Q.Boolean(tuple((Q.SHOULD, self._fold(g)) for g in groups))
        return self._fold(parts)

    def _fold(self, parts: list[tuple[str | None, str | None, Q.Query]]) -> Q.Query:
        clauses: list[tuple[str, Q.Query]] = []
        for op, mod, q in parts:
            if op == "and" and clauses and clauses[-1][0] == Q.SHOULD:
                clauses[-1] = (Q.MUST, clauses[-1][1])
            if self.default_and and op == "or" and clauses and clauses[-1][0] == Q.MUST:
                clauses[-1] = (Q.SHOULD, clauses[-1][1])
            if mod in ("not", "minus"):
                occur = Q.MUST_NOT
            elif mod == "plus" or op == "and" or (self.default_and and op != "or"):
                occur = Q.MUST
            else:
                occur = Q.SHOULD
            clauses.append((occur, q))
        if not clauses:
            return Q.MatchNone()
        if len(clauses) == 1 and clauses[0][0] != Q.MUST_NOT:
            return clauses[0][1]
        return Q.Boolean(tuple(clauses))

    def _clause(self, name: str) -> Q.Query | None:
        if self._peek() == "term" and self._peek(1) == "colon":
            name = unescape(self._next()[1])
            self._next()
            if name == "*" and self._peek() == "term" and self._tokens[self._at][1] == "*":
                self._next()
                return self._boosted(Q.MatchAll())
        kind, value = self._next()
        if kind == "lp":
            inner = self._query(name)
            if self._next()[0] != "rp":
                raise ParseError("a group isn't closed")
            return self._boosted(inner)
        if kind == "quoted":
            text = unescape(value[1:-1])
            if name in self.extensions:
                return self._boosted(self.extensions[name](name, text))
            slop = self.slop
            if self._peek() == "fuzz":
                slop = int(float(self._next()[1][1:] or 0))
            return self._boosted(self.phrase(name, text, slop))
        if kind == "regex":
            return self._boosted(Q.Regexp(name, pattern=value[1:-1].replace("\\/", "/")))
        if kind == "range":
            return self._boosted(self._range(name, value))
        if kind != "term":
            raise ParseError(f"{value!r} isn't expected")
        if self._peek() == "fuzz":
            n = self._next()[1][1:]
            edits = self.fuzzy_edits if not n else int(float(n)) if float(n) >= 1 else min(2, int((1 - float(n)) * len(value)))
            return self._boosted(Q.Fuzzy(name, term=unescape(value).lower(), max_edits=min(2, edits), prefix_length=self.fuzzy_prefix))
        return self._boosted(self.word(name, value))

    def _boosted(self, q: Q.Query | None) -> Q.Query | None:
        if self._peek() == "boost":
            b = float(self._next()[1][1:])
            return Q.Boost(q, b) if q is not None else None
        return q

    def word(self, name: str, value: str) -> Q.Query | None:
        bare = re.sub(r"\\.", "", value)
        if "*" in bare or "?" in bare:
            if value == "*":
                return Q.MatchAll() if name == "*" else Q.Exists(name)
            if bare[0] in "*?" and not self.allow_leading_wildcard:
                raise ParseError("a wildcard stands first")
            if bare.endswith("*") and bare.count("*") == 1 and "?" not in bare:
                return Q.Prefix(name, prefix=unescape(value[:-1]).lower())
            return Q.Wildcard(name, pattern=value.lower())
        return self.phrase(name, unescape(value), self.slop, words=True)

    def phrase(self, name: str, text: str, slop: int, words: bool = False) -> Q.Query | None:
        terms = self.analyzer(text)
        if not terms:
            return None
        if len(terms) == 1:
            return Q.Term(name, terms[0])
        if words:  # one word that the analyzer cut
            return Q.Boolean(tuple((Q.MUST if self.default_and else Q.SHOULD, Q.Term(name, t)) for t in terms))
        return S.Phrase(name, tuple(terms), None, slop)

    def _range(self, name: str, value: str) -> Q.Query:
        m = re.match(r'[\[{]\s*("(?:\\.|[^"\\])*"|\S+)\s+TO\s+("(?:\\.|[^"\\])*"|[^\s\]}]+)\s*[\]}]', value)
        low, high = (None if x == "*" else unescape(x.strip('"')) for x in m.groups())
        return Q.TermRange(name, low=low, high=high, include_low=value[0] == "[", include_high=value[-1] == "]")


def parse(text: str, default_field: str = "text", **options) -> Q.Query:
    return ClassicParser(default_field, **options).parse(text)


def multi_field(text: str, fields: dict[str, float] | list[str], **options) -> Q.Query:
    """Each term in any of several fields, boosted; clauses that name a field stay."""
    boosts = fields if isinstance(fields, dict) else dict.fromkeys(fields, 1.0)
    return _spread(ClassicParser("\0any", **options).parse(text), boosts)


def _spread(q: Q.Query, boosts: dict[str, float]) -> Q.Query:
    from dataclasses import replace

    if isinstance(q, Q.Boolean):
        return replace(q, clauses=tuple((o, _spread(c, boosts)) for o, c in q.clauses))
    if isinstance(q, Q.Boost):
        return Q.Boost(_spread(q.query, boosts), q.by)
    if getattr(q, "field", None) == "\0any":
        each = [(f, replace(q, field=f)) for f in boosts]
        return Q.Boolean(tuple((Q.SHOULD, Q.Boost(x, boosts[f]) if boosts[f] != 1 else x) for f, x in each))
    return q


#: Operators of the simple syntax.
ALL_FLAGS = frozenset("and or not phrase prefix precedence fuzzy near whitespace escape".split())


def simple(text: str, fields: dict[str, float] | list[str], flags: frozenset[str] = ALL_FLAGS, default_and: bool = False, analyzer: Callable[[str], list[str]] | None = None) -> Q.Query:
    """+ | - "phrase"~n term~n pre* ( ): never an error; what makes no sense is left out."""
    boosts = fields if isinstance(fields, dict) else dict.fromkeys(fields, 1.0)
    analyze = analyzer or ClassicParser("").analyzer
    pos = 0

    def in_fields(make: Callable[[str], Q.Query]) -> Q.Query:
        qs = tuple((Q.SHOULD, Q.Boost(make(f), b) if b != 1 else make(f)) for f, b in boosts.items())
        return qs[0][1] if len(qs) == 1 else Q.Boolean(qs)

    def number() -> int | None:
        nonlocal pos
        m = re.match(r"~(\d+)", text[pos:])
        if m:
            pos += m.end()
            return int(m[1])
        return None

    def group(depth: int) -> Q.Query | None:
        nonlocal pos
        cur: Q.Query | None = None
        op = negated = None
        while pos < len(text):
            c = text[pos]
            if c.isspace() and "whitespace" in flags:
                pos += 1
                continue
            if c == ")" and "precedence" in flags:
                pos += 1
                if depth:
                    return cur
                continue
            if c == "+" and "and" in flags:
                op = op or Q.MUST
                pos += 1
                continue
            if c == "|" and "or" in flags:
                op = op or Q.SHOULD
                pos += 1
                continue
            if c == "-" and "not" in flags:
                negated = not negated
                pos += 1
                continue
            if c == "(" and "precedence" in flags:
                pos += 1
                q = group(depth + 1)
            elif c == '"' and "phrase" in flags:
                end = pos + 1
                while end < len(text) and text[end] != '"':
                    end += 2 if text[end] == "\\" else 1
                if end >= len(text):
                    pos += 1
                    continue
                terms = analyze(unescape(text[pos + 1 : end]))
                pos = end + 1
                slop = (number() if "near" in flags else None) or 0
                q = in_fields(lambda f, t=terms, s=slop: S.Phrase(f, tuple(t), None, s).rewrite()) if terms else None
            else:
                m = re.match(r'(?:\\.|[^\s+|"()])+', text[pos:]) or re.match(r".", text[pos:], re.S)
                word = m[0]
                pos += m.end()
                fuzz = re.fullmatch(r"(.+?)~(\d*)", word)
                terms = analyze(unescape(word.rstrip("*") if word.endswith("*") else word))
                if fuzz and "fuzzy" in flags:
                    edits = min(2, int(fuzz[2] or 2))
                    base = analyze(unescape(fuzz[1]))
                    q = in_fields(lambda f, b=base, e=edits: Q.Fuzzy(f, term=b[0], max_edits=e) if e else Q.Term(f, b[0])) if base else None
                elif word.endswith("*") and "prefix" in flags and len(word) > 1:
                    q = in_fields(lambda f, w=word: Q.Prefix(f, prefix=unescape(w[:-1]).lower()))
                else:
                    q = in_fields(lambda f, t=terms: Q.Term(f, t[0]) if len(t) == 1 else Q.Boolean(tuple((Q.SHOULD, Q.Term(f, x)) for x in t))) if terms else None
            if q is not None:
                if negated:
                    q = Q.Boolean(((Q.MUST_NOT, q), (Q.SHOULD, Q.MatchAll())))
                occur = op or (Q.MUST if default_and else Q.SHOULD)
                if cur is None:
                    cur = q
                elif isinstance(cur, Q.Boolean) and cur.clauses and all(o == occur for o, _ in cur.clauses):
                    cur = cur.add(q, occur)
                else:
                    cur = Q.Boolean(((occur, cur), (occur, q)))
            op = negated = None
        return cur

    return group(0) or Q.MatchNone()


def complex_phrase(text: str, default_field: str, slop: int = 0, ordered: bool = True, analyzer: Callable[[str], list[str]] | None = None) -> Q.Query:
    """A phrase whose slots may be wildcards, fuzzy words and alternatives in parentheses, as spans."""
    analyze = analyzer or ClassicParser("").analyzer
    m = re.fullmatch(r'\s*(?:(\w+):)?"(.*)"(?:~(\d+))?\s*', text, re.S)
    if not m:
        return ClassicParser(default_field).parse(text)
    name = m[1] or default_field

    def slot(word: str) -> S.Span | None:
        if word.startswith("("):
            inner = [s for s in (slot(w) for w in re.split(r"\s+(?:OR\s+)?", word[1:-1].strip())) if s]
            return S.SpanOr(tuple(inner)) if inner else None
        if word.endswith("~") or re.search(r"~\d$", word):
            base, _, n = word.partition("~")
            return S.SpanMultiTerm(name, Q.Fuzzy(name, term=base.lower(), max_edits=int(n or 2)))
        if "*" in word or "?" in word:
            return S.SpanMultiTerm(name, Q.Wildcard(name, pattern=word.lower()))
        terms = analyze(word)
        return S.SpanTerm(name, terms[0]) if terms else None

    slots = [s for s in (slot(w) for w in re.findall(r"\([^)]*\)|\S+", m[2])) if s]
    if not slots:
        return Q.MatchNone()
    return slots[0] if len(slots) == 1 else S.SpanNear(tuple(slots), int(m[3] or slop), ordered)


def surround(text: str, default_field: str) -> Q.Query:
    """2W(a, b) ordered and 3N(a, b) unordered within a distance, AND OR NOT before a list or between, trunca* and field:term."""
    toks = re.findall(r'\d*[WwNn](?=\s*\()|\d+[WwNn]\b|[()]|,|"[^"]*"|[^\s(),]+', text)
    at = 0

    def peek() -> str | None:
        return toks[at] if at < len(toks) else None

    def take(expected: str | None = None) -> str:
        nonlocal at
        if at >= len(toks) or (expected and toks[at] != expected):
            raise ParseError(f"{expected or 'more'} is expected in {text!r}")
        at += 1
        return toks[at - 1]

    def listed(name: str) -> list:
        take("(")
        out = [query(name)]
        while peek() == ",":
            take()
            out.append(query(name))
        take(")")
        return out

    def near(op: str, parts: list) -> S.Span:
        n = int(op[:-1] or 1)
        return S.SpanNear(tuple(_span(p) for p in parts), n - 1, op[-1] in "Ww")

    def primary(name: str) -> Q.Query:
        t = peek()
        if t is None:
            raise ParseError("the query ends too early")
        if re.fullmatch(r"\d*[WwNn]", t) and at + 1 < len(toks) and toks[at + 1] == "(":
            return near(take(), listed(name))
        if t.upper() in ("AND", "OR") and at + 1 < len(toks) and toks[at + 1] == "(":
            op = take().upper()
            parts = listed(name)
            return Q.Boolean(tuple((Q.MUST if op == "AND" else Q.SHOULD, p) for p in parts))
        if t == "(":
            take()
            out = query(name)
            take(")")
            return out
        take()
        if ":" in t and not t.startswith('"'):
            f, _, rest = t.partition(":")
            if not rest:
                return primary(f)
            name, t = f, rest
        t, _, boost = t.partition("^")
        bare = t.strip('"').lower()
        q: Q.Query = S.SpanMultiTerm(name, Q.Wildcard(name, pattern=bare)) if ("*" in t or "?" in t) and not t.startswith('"') else S.SpanTerm(name, bare)
        return Q.Boost(_plain(q), float(boost)) if boost else q

    def query(name: str) -> Q.Query:
        out = primary(name)
        while peek() and (peek().upper() in ("AND", "OR", "NOT") or re.fullmatch(r"\d*[WwNn]", peek())):
            op = take()
            right = primary(name)
            if op.upper() == "AND":
                out = Q.Boolean(((Q.MUST, _plain(out)), (Q.MUST, _plain(right))))
            elif op.upper() == "OR":
                out = S.SpanOr((out, right)) if isinstance(out, S.Span) and isinstance(right, S.Span) else Q.Boolean(((Q.SHOULD, _plain(out)), (Q.SHOULD, _plain(right))))
            elif op.upper() == "NOT":
                out = Q.Boolean(((Q.MUST, _plain(out)), (Q.MUST_NOT, _plain(right))))
            else:
                out = near(op, [out, right])
        return out

    def _span(q: Q.Query) -> S.Span:
        if isinstance(q, S.Span):
            return q
        if isinstance(q, Q.Boolean) and all(o == Q.SHOULD for o, _ in q.clauses):
            return S.SpanOr(tuple(_span(c) for _, c in q.clauses))
        raise ParseError("only words and alternatives may stand within a distance")

    def _plain(q: Q.Query) -> Q.Query:
        if isinstance(q, S.SpanTerm):
            return Q.Term(q.field, q.term)
        return q.query if isinstance(q, S.SpanMultiTerm) else q

    out = _plain(query(default_field))
    if at < len(toks):
        raise ParseError(f"{toks[at]!r} isn't expected")
    if isinstance(out, Q.Boolean):
        out = Q.Boolean(tuple((o, _plain(c)) for o, c in out.clauses), out.min_should)
    return out


def xml(text: str | ET.Element, default_field: str = "text", analyzer: Callable[[str], list[str]] | None = None) -> Q.Query:
    """Elements to queries: TermQuery, TermsQuery, BooleanQuery/Clause, ConstantScoreQuery, DisjunctionMaxQuery, MatchAllDocsQuery, RangeQuery, PointRangeQuery, PhraseQuery, FuzzyQuery, Span*, UserQuery, BoostingTermQuery and LikeThisQuery."""
    e = ET.fromstring(text) if isinstance(text, str) else text  # noqa: S314 (a query, no document type is read)
    analyze = analyzer or ClassicParser("").analyzer
    name = e.get("fieldName", default_field)
    body = (e.text or "").strip()
    sub = lambda x: xml(x, name, analyzer)
    kids = list(e)

    def build() -> Q.Query:
        t = e.tag
        if t == "TermQuery" or t == "BoostingTermQuery":
            return Q.Term(name, body)
        if t == "TermsQuery":
            return Q.Boolean(tuple((Q.SHOULD, Q.Term(name, x)) for x in analyze(body)), int(e.get("minimumNumberShouldMatch", 0)))
        if t == "BooleanQuery":
            occurs = {"must": Q.MUST, "should": Q.SHOULD, "mustnot": Q.MUST_NOT, "filter": Q.FILTER}
            return Q.Boolean(tuple((occurs[c.get("occurs", "should").lower()], sub(c[0])) for c in kids), int(e.get("minimumNumberShouldMatch", 0)))
        if t == "ConstantScoreQuery":
            return Q.ConstantScore(sub(kids[0]), 1.0)
        if t == "DisjunctionMaxQuery":
            return Q.DisjunctionMax(tuple(sub(k) for k in kids), float(e.get("tieBreaker", 0)))
        if t == "MatchAllDocsQuery":
            return Q.MatchAll()
        if t == "RangeQuery":
            yes = lambda k: e.get(k, "true") != "false"
            return Q.TermRange(name, low=e.get("lowerTerm"), high=e.get("upperTerm"), include_low=yes("includeLower"), include_high=yes("includeUpper"))
        if t == "PointRangeQuery":
            kind = float if e.get("type", "int") in ("float", "double") else int
            return Q.Range(name, *(kind(e.get(k)) if e.get(k) else None for k in ("lowerTerm", "upperTerm")))
        if t == "PhraseQuery":
            return S.Phrase(name, tuple(analyze(body)), None, int(e.get("slop", 0)))
        if t == "FuzzyQuery":
            return Q.Fuzzy(name, term=body, max_edits=int(e.get("maxEdits", 2)))
        if t == "UserQuery":
            return ClassicParser(name).parse(body)
        if t == "LikeThisQuery":
            return Q.MoreLikeThis(name, tuple(analyze(body)), int(e.get("minTermFrequency", 1)), int(e.get("minDocFreq", 1)))
        if t == "SpanTerm":
            return S.SpanTerm(name, body)
        if t == "SpanOr":
            return S.SpanOr(tuple(sub(k) for k in kids))
        if t == "SpanOrTerms":
            return S.SpanOrTerms(name, *analyze(body))
        if t == "SpanNear":
            return S.SpanNear(tuple(sub(k) for k in kids), int(e.get("slop", 0)), e.get("inOrder", "true") == "true")
        if t == "SpanFirst":
            return S.SpanFirst(sub(kids[0]), int(e.get("end", 1)))
        if t == "SpanNot":
            return S.SpanNot(sub(e.find("Include")[0]), sub(e.find("Exclude")[0]))
        raise ParseError(f"no query {t}")

    q = build()
    return Q.Boost(q, float(e.get("boost"))) if e.get("boost") else q


def date_bound(text: str) -> date:
    return date.fromisoformat(text)
