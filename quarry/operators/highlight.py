"""Highlighting: passages of stored text around matches, by Arrow batch."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sentences(text: str) -> list[tuple[int, int]]:
    """Ends after . ! ? with space behind, or at a line's end."""
    cuts = [m.end() for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s)\s*|\n+", text)]
    starts = [0, *cuts]
    return [(a, b) for a, b in zip(starts, [*cuts, len(text)], strict=True) if b > a]


def lengths(goal: int) -> Callable[[str], list[tuple[int, int]]]:
    """Sentences joined until they reach a length."""

    def run(text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sentences(text):
            if out and out[-1][1] - out[-1][0] < goal:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    return run


def separated(by: str) -> Callable[[str], list[tuple[int, int]]]:
    def run(text: str) -> list[tuple[int, int]]:
        out, at = [], 0
        for part in text.split(by):
            if part:
                out.append((at, at + len(part)))
            at += len(part) + len(by)
        return out

    return run


def whole(text: str) -> list[tuple[int, int]]:
    return [(0, len(text))] if text else []


@dataclass
class Passage:
    start: int
    end: int
    matches: list[tuple[int, int, str]] = field(default_factory=list)
    score: float = 0.0


def passage_score(p: Passage, total: int, counts: dict[str, int], k1: float = 1.2, b: float = 0.75, pivot: float = 87.0) -> float:
    """BM25 with passages as documents, a little more for early ones."""
    n = 1 + total / pivot
    tf: dict[str, int] = {}
    for _, _, t in p.matches:
        tf[t] = tf.get(t, 0) + 1
    norm = k1 * ((1 - b) + b * (p.end - p.start) / pivot)
    s = sum((k1 + 1) * math.log(1 + (n + 0.5) / (counts[t] + 0.5)) * f / (f + norm) for t, f in tf.items())
    return s * (1 + 1 / math.log(pivot + p.start))


@dataclass(frozen=True)
class Highlighter:
    """The best passages with their matches in tags.

    matcher: (start, end, term) of all matches in a text; by default words of `terms` after
    lower-casing. Without a match the first `fallback` passages are given.
    """

    terms: tuple[str, ...] = ()
    passages: int = 3
    fallback: int = 1
    breaks: Callable[[str], list[tuple[int, int]]] = sentences
    pre: str = "<b>"
    post: str = "</b>"
    ellipsis: str = "... "
    escape: bool = False
    phrases: tuple[tuple[str, ...], ...] = ()
    matcher: Callable[[str], list[tuple[int, int, str]]] | None = None

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        if self.matcher:
            return self.matcher(text)
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[a-z0-9]+", text.lower())] if len(text.lower()) == len(text) else [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[A-Za-z0-9]+", text)]
        known = set(self.terms)
        out = [w for w in words if w[2] in known]
        for p in self.phrases:  # the words of a phrase count only together
            for i in range(len(words) - len(p) + 1):
                if tuple(w[2] for w in words[i : i + len(p)]) == p:
                    out += words[i : i + len(p)]
        return sorted(set(out))

    def best(self, text: str) -> list[Passage]:
        found = self.matches(text)
        spans = self.breaks(text)
        if not found:
            return [Passage(a, b) for a, b in spans[: self.fallback]]
        counts: dict[str, int] = {}
        for _, _, t in found:
            counts[t] = counts.get(t, 0) + 1
        out, at = [], 0
        for a, b in spans:
            p = Passage(a, b)
            while at < len(found) and found[at][0] < b:
                p.matches.append(found[at])
                at += 1
            if p.matches:
                p.score = passage_score(p, len(text), counts)
                out.append(p)
        out = sorted(out, key=lambda p: (-p.score, p.start))[: self.passages]
        return sorted(out, key=lambda p: p.start)

    def format(self, text: str, passages: Iterable[Passage]) -> str:
        out, last = [], 0
        for p in passages:
            if p.start > last and last:
                out.append(self.ellipsis)
            at = p.start
            for a, b, _ in p.matches:
                if a < at:
                    continue
                out += [self._text(text[at:a]), self.pre, self._text(text[a : min(b, p.end)]), self.post]
                at = min(b, p.end)
            out.append(self._text(text[at : p.end]))
            last = p.end
        return "".join(out).strip()

    def _text(self, s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if self.escape else s

    def run(self, text: str | None) -> str | None:
        return None if text is None else self.format(text, self.best(text))

    def column(self, text: Column) -> Column:
        own = self

        @F.pandas_udf("string")
        def udf(s: pd.Series) -> pd.Series:
            return s.map(own.run)

        return udf(text)

    def regions(self, text: Column) -> Column:
        """Flat start and end offsets of all matches."""
        own = self

        @F.pandas_udf("array<int>")
        def udf(s: pd.Series) -> pd.Series:
            return s.map(lambda x: [] if x is None else [v for a, b, _ in own.matches(x) for v in (a, b)])

        return udf(text)


def mark_all(text: Column, terms: Iterable[str], pre: str = "<b>", post: str = "</b>") -> Column:
    """The whole text with every word of `terms` in tags, inside the JVM."""
    words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)(?<![A-Za-z0-9])({words})(?![A-Za-z0-9])", f"{pre}$1{post}")


def fragments(text: str, weights: dict[str, float], size: int = 100, n: int = 3) -> list[str]:
    """Fixed-size fragments by the weights of the distinct terms in them (the classic scorer)."""
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", text)]
    groups: dict[int, list] = {}
    for w in words:
        groups.setdefault(w[0] // size, []).append(w)
    scored = sorted(((sum(weights.get(t, 0) for t in {w[2] for w in ws}), -k) for k, ws in groups.items()), reverse=True)
    out = []
    for s, k in scored[:n]:
        if s > 0:
            ws = groups[-k]
            at, parts = ws[0][0], []
            for a, b, t in ws:
                parts += [text[at:a], f"<B>{text[a:b]}</B>" if t in weights else text[a:b]]
                at = b
            out.append("".join(parts))
    return out
