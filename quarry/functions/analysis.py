"""Text analysis: character filters, tokenizers and token filters over positional tokens.

A component is a plain function. A chain of them is an `Analyzer`, which runs in Arrow batches
(`tokens(column)`) as an array of (term, pos, start, end, type, length) structs, or on one
string (`analyze`). Components are registered by name, so that chains can be described as data.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import islice

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(slots=True)
class Token:
    """A term with its position increment and length, offsets into the text, type, payload, and whether stemmers leave it alone."""

    term: str
    start: int = 0
    end: int = 0
    inc: int = 1
    type: str = "word"  # noqa: A003
    length: int = 1
    payload: bytes | None = None
    keyword: bool = False
    boost: float = 1.0
    flags: int = 0


Tokens = Iterable[Token]
CharFilter = Callable[[str], str]
Tokenizer = Callable[[str], Iterator[Token]]
TokenFilter = Callable[[Tokens], Iterator[Token]]

CHAR_FILTERS: dict[str, Callable[..., CharFilter]] = {}
TOKENIZERS: dict[str, Callable[..., Tokenizer]] = {}
FILTERS: dict[str, Callable[..., TokenFilter]] = {}


def char_filter(fn):
    CHAR_FILTERS[fn.__name__] = fn
    return fn


def tokenizer(fn):
    TOKENIZERS[fn.__name__] = fn
    return fn


def token_filter(fn):
    FILTERS[fn.__name__] = fn
    return fn


def by_run(fn):
    """Marks a tokenizer whose words never reach across white space, or a filter that looks at each token's term, type and mark alone."""
    fn.by_run = True
    return fn


def each_term(fn: Callable[[str], str], stemming: bool = False) -> TokenFilter:
    """A filter that changes terms only; a stemming one leaves keywords alone, and no filter leaves an empty term."""

    @by_run
    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            if not (stemming and t.keyword):
                t.term = fn(t.term) or t.term
            yield t

    return run


def keeping(accept: Callable[[Token], bool]) -> TokenFilter:
    """A filter that drops tokens, by term or type, and leaves holes in the positions."""

    @by_run
    def run(tokens: Tokens) -> Iterator[Token]:
        skipped = 0
        for t in tokens:
            if accept(t):
                t.inc += skipped
                skipped = 0
                yield t
            else:
                skipped += t.inc

    return run


# --- character filters ------------------------------------------------------------------------


@char_filter
def html_strip() -> CharFilter:
    """Markup to spaces (block tags to line ends), references decoded."""
    block = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|table|tr|td|th|article|section|header|footer|nav|body|html|head|title|pre|blockquote)\b[^>]*>", re.I)

    def run(text: str) -> str:
        text = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<![^>]*>", " ", text)
        text = block.sub("\n", text)
        return html.unescape(re.sub(r"<[/?]?[A-Za-z][^>]*>", "", text))

    return run


@char_filter
def mapping(table: dict[str, str]) -> CharFilter:
    """The longest key at each place is replaced."""
    if not table:
        return lambda text: text
    keys = re.compile("|".join(re.escape(k) for k in sorted(table, key=len, reverse=True)))
    return lambda text: keys.sub(lambda m: table[m[0]], text)


@char_filter
def pattern_replace_chars(pattern: str, replacement: str = "") -> CharFilter:
    p = regex.compile(pattern)
    r = re.sub(r"\$(\d)", r"\\\1", replacement)
    return lambda text: p.sub(r, text)


@char_filter
def unicode_normalize(form: str = "NFKC", fold_case: bool = True) -> CharFilter:
    return lambda text: unicodedata.normalize(form, text.casefold() if fold_case else text)


@char_filter
def cjk_width_chars() -> CharFilter:
    return _width


@char_filter
def persian_chars() -> CharFilter:
    """Zero-width non-joiners to spaces."""
    return lambda text: text.replace("‌", " ")


@char_filter
def japanese_iteration_marks(kanji: bool = True, kana: bool = True) -> CharFilter:
    """Iteration marks to what they repeat, voiced if the mark is."""

    def run(text: str) -> str:
        out: list[str] = []
        i = 0
        while i < len(text):
            c = text[i]
            if (c == "々" and kanji) or (c in "ゝゞヽヾ" and kana):
                j = i
                while j < len(text) and (text[j] == "々" if c == "々" else text[j] in "ゝゞヽヾ"):
                    j += 1
                n = min(j - i, len(out))
                for k in range(j - i):
                    src = out[len(out) - n] if n else text[i + k]
                    if text[i + k] in "ゞヾ":
                        src = unicodedata.normalize("NFC", src + "゙")
                        src = src[0] if len(src) > 1 else src
                    elif text[i + k] in "ゝヽ":
                        src = unicodedata.normalize("NFD", src)[0]
                    out.append(src)
                i = j
            else:
                out.append(c)
                i += 1
        return "".join(out)

    return run


def _width(text: str) -> str:
    """Full-width ASCII to ASCII, half-width kana to full width."""
    out = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text)
    return regex.sub(r"[･-ﾟ]+", lambda m: unicodedata.normalize("NFKC", m[0]), out)


# --- tokenizers ---------------------------------------------------------------------------------

_WORD = regex.compile(r"\p{Script=Han}|\p{Script=Hiragana}|\p{Script=Katakana}+|\p{Script=Hangul}+|[\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}]+|\p{Emoji_Presentation}|[\p{Word_Break=ALetter}\p{Word_Break=Hebrew_Letter}\p{Word_Break=Numeric}\p{Word_Break=ExtendNumLet}][\p{M}‍]*(?:[\p{Word_Break=ALetter}\p{Word_Break=Hebrew_Letter}\p{Word_Break=Numeric}\p{Word_Break=ExtendNumLet}][\p{M}‍]*|(?<=\p{L}[\p{M}]*)[\p{Word_Break=MidLetter}\p{Word_Break=MidNumLet}'](?=\p{Word_Break=ALetter})|(?<=\p{N})[\p{Word_Break=MidNum}\p{Word_Break=MidNumLet}'](?=\p{N}))*")
_HAS_WORD = regex.compile(r"[\p{L}\p{N}\p{Emoji_Presentation}]")


def _type(term: str) -> str:
    if regex.match(r"\p{Script=Han}", term):
        return "<IDEOGRAPHIC>"
    if regex.match(r"\p{Script=Hiragana}", term):
        return "<HIRAGANA>"
    if regex.match(r"\p{Script=Katakana}", term):
        return "<KATAKANA>"
    if regex.match(r"\p{Script=Hangul}", term):
        return "<HANGUL>"
    if regex.match(r"[\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}]", term):
        return "<SOUTHEAST_ASIAN>"
    if regex.match(r"\p{Emoji_Presentation}", term):
        return "<EMOJI>"
    return "<NUM>" if regex.fullmatch(r"[\p{N}\p{P}_]+", term) else "<ALPHANUM>"


@tokenizer
def standard(max_length: int = 255) -> Tokenizer:
    """Words by Unicode's word boundaries; longer ones are cut into pieces of max_length."""

    @by_run
    def run(text: str) -> Iterator[Token]:
        for chunk in _CHUNK.finditer(text):
            at = chunk.start()
            for s, e, kind in _cut(chunk[0]):
                for k in range(s, e, max_length):
                    part = chunk[0][k : min(e, k + max_length)]
                    yield Token(part, at + k, at + k + len(part), type=kind)

    return run


_CHUNK = re.compile(r"\S+")


def _cut(chunk: str) -> Iterable[tuple[int, int, str]]:
    """(start, end, type) of the words of a run without white space; boundaries never reach across it. Short runs are kept."""
    word = chunk.rstrip(".,;:!?")
    if word.isalpha() and (word.isascii() or max(word) < "\u0250"):  # Latin letters
        return ((0, len(word), "<ALPHANUM>"),)
    return _cut_short(chunk) if len(chunk) <= 64 else _words(chunk)


def _words(chunk: str) -> Iterator[tuple[int, int, str]]:
    return ((m.start(), m.end(), _type(m[0])) for m in _WORD.finditer(chunk) if _HAS_WORD.search(m[0]))


@functools.lru_cache(100_000)
def _cut_short(chunk: str) -> tuple[tuple[int, int, str], ...]:
    return tuple(_words(chunk))


def _matches(pattern: str, kind: str = "word") -> Tokenizer:
    p = regex.compile(pattern)

    def run(text: str) -> Iterator[Token]:
        for m in p.finditer(text):
            if m[0]:
                yield Token(m[0], m.start(), m.end(), type=kind)

    return run


@tokenizer
def whitespace() -> Tokenizer:
    return _matches(r"[^\s]+")


@tokenizer
def unicode_whitespace() -> Tokenizer:
    return _matches(r"[^\p{White_Space}]+")


@tokenizer
def letter() -> Tokenizer:
    return by_run(_matches(r"\p{L}+"))


@tokenizer
def chars(accept: str) -> Tokenizer:
    """Runs of characters of a class, as a regular expression."""
    return _matches(f"(?:{accept})+")


@tokenizer
def keyword() -> Tokenizer:
    return lambda text: iter([Token(text, 0, len(text))] if text else [])


@tokenizer
def pattern(pattern: str, group: int = -1) -> Tokenizer:  # noqa: A001
    """group -1: what stands between matches; else the group of each match."""
    p = regex.compile(pattern)

    def run(text: str) -> Iterator[Token]:
        if group >= 0:
            for m in p.finditer(text):
                if m[group]:
                    yield Token(m[group], m.start(group), m.end(group))
            return
        at = 0
        for m in p.finditer(text):
            if m.start() > at:
                yield Token(text[at : m.start()], at, m.start())
            at = m.end()
        if at < len(text):
            yield Token(text[at:], at, len(text))

    return run


@tokenizer
def simple_pattern(pattern: str) -> Tokenizer:
    return _matches(pattern)


@tokenizer
def simple_pattern_split(pattern: str) -> Tokenizer:
    return TOKENIZERS["pattern"](pattern)


@tokenizer
def ngram(low: int = 1, high: int = 2) -> Tokenizer:
    def run(text: str) -> Iterator[Token]:
        for i in range(len(text)):
            for n in range(low, high + 1):
                if i + n <= len(text):
                    yield Token(text[i : i + n], i, i + n)

    return run


@tokenizer
def edge_ngram(low: int = 1, high: int = 1) -> Tokenizer:
    return lambda text: (Token(text[:n], 0, n) for n in range(low, min(high, len(text)) + 1))


@tokenizer
def path_hierarchy(separator: str = "/", replacement: str | None = None, skip: int = 0) -> Tokenizer:
    """a/b/c to a, a/b and a/b/c."""

    def run(text: str) -> Iterator[Token]:
        parts, start = [], 0
        for piece in regex.findall(f"{re.escape(separator)}?[^{re.escape(separator)}]+|{re.escape(separator)}", text):
            parts.append((start, piece))
            start += len(piece)
        first = parts[skip][0] if skip < len(parts) else len(text)
        for s, p in parts[skip:]:
            term = text[first : s + len(p)]
            yield Token(term.replace(separator, replacement or separator), first, s + len(p), inc=1 if s == first else 0)

    return run


@tokenizer
def reverse_path_hierarchy(separator: str = "/", replacement: str | None = None, skip: int = 0) -> Tokenizer:
    """a/b/c to a/b/c, b/c and c."""

    def run(text: str) -> Iterator[Token]:
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == separator and i + 1 < len(text)]
        end = len(text)
        for _ in range(skip):
            end = max(0, text.rfind(separator, 0, end - 1) + 1)
        for k, s in enumerate(x for x in starts if x < end):
            yield Token(text[s:end].replace(separator, replacement or separator), s, end, inc=1 if k == 0 else 0)

    return run


_URL = r"(?:https?|ftp)://[^\s<>\"]+[^\s<>\".,;:!?)\]]|(?:[a-z0-9-]+\.)+(?:com|org|net|edu|gov|io|info|biz|de|fr|uk|es|it|nl|eu)(?:/[^\s<>\"]*)?"
_EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"


@tokenizer
def uax29_url_email(max_length: int = 255) -> Tokenizer:
    """As standard, with URLs and addresses whole."""
    special = regex.compile(f"(?i)({_EMAIL})|({_URL})")
    inner = standard(max_length)

    def run(text: str) -> Iterator[Token]:
        at = 0
        for m in [*special.finditer(text), None]:
            end = m.start() if m else len(text)
            for t in inner(text[at:end]):
                yield replace(t, start=t.start + at, end=t.end + at)
            if m:
                yield Token(m[0], m.start(), m.end(), type="<EMAIL>" if m[1] else "<URL>")
                at = m.end()

    return run


@tokenizer
def classic(max_length: int = 255) -> Tokenizer:
    """Words with apostrophes, acronyms, companies (AT&T), hosts, addresses and numbers of a kind."""
    p = regex.compile(rf"(?P<EMAIL>{_EMAIL})|(?P<ACRONYM>\b(?:\p{{L}}\.){{2,}})|(?P<COMPANY>\p{{L}}+(?:&|@)\p{{L}}+)|(?P<APOSTROPHE>\p{{L}}+(?:'\p{{L}}+)+)|(?P<HOST>[\p{{L}}\p{{N}}]+(?:\.[\p{{L}}\p{{N}}]+)+)|(?P<NUM>(?=\S*\p{{N}})[\p{{L}}\p{{N}}]+(?:[-_/.,][\p{{L}}\p{{N}}]+)+)|(?P<CJ>[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}])|(?P<ALPHANUM>[\p{{L}}\p{{N}}]+)")

    def run(text: str) -> Iterator[Token]:
        for m in p.finditer(text):
            if len(m[0]) <= max_length:
                yield Token(m[0], m.start(), m.end(), type=f"<{m.lastgroup}>")

    return run


@tokenizer
def wikipedia() -> Tokenizer:
    """Words of wiki markup, typed by what they stand in."""
    p = regex.compile(r"\[\[Category:(?P<c>[^\]|]+)[^\]]*\]\]|\[\[(?P<il>[^\]|]+)(?:\|[^\]]*)?\]\]|\[(?P<el>https?://\S+)[^\]]*\]|'''(?P<b>.+?)'''|''(?P<i>.+?)''|={2,}(?P<h>[^=]+)={2,}|\{\{(?P<ci>[^}]+)\}\}|(?P<w>[\p{L}\p{N}]+(?:'[\p{L}]+)?)")
    words = regex.compile(r"[\p{L}\p{N}]+(?:'[\p{L}]+)?")

    def run(text: str) -> Iterator[Token]:
        for m in p.finditer(text):
            k = m.lastgroup
            if k == "el":
                yield Token(m[k], m.start(k), m.end(k), type="el")
                continue
            for w in words.finditer(m[k]):
                yield Token(w[0], m.start(k) + w.start(), m.start(k) + w.end(), type="<ALPHANUM>" if k == "w" else k)

    return run


@tokenizer
def cjk() -> Tokenizer:
    """Bigrams of CJK runs, and words of letters and digits."""

    def run(text: str) -> Iterator[Token]:
        for m in regex.finditer(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+)|[\p{L}\p{N}+#_]+", text):
            if m[1] is None or len(m[0]) == 1:
                yield Token(m[0], m.start(), m.end(), type="double" if m[1] else "single")
            else:
                for i in range(len(m[0]) - 1):
                    yield Token(m[0][i : i + 2], m.start() + i, m.start() + i + 2, type="double")

    return run


def dictionary_segmenter(words: dict[str, float] | Iterable[str], script: str) -> Tokenizer:
    """Cuts runs of a script into the cheapest sequence of dictionary words (a unigram lattice); unknown characters stand alone."""
    cost = {w: 1.0 for w in words} if not isinstance(words, dict) else words
    longest = max(map(len, cost), default=1)
    unknown = 1.5 * max(cost.values(), default=1.0) + 1
    base = standard()
    is_run = regex.compile(f"[{script}]+")

    def cut(run_: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for i in range(1, len(run_) + 1):
            options = [(best[i - 1][0] + unknown, i - 1)]
            options += [(best[j][0] + cost[run_[j:i]], j) for j in range(max(0, i - longest), i) if run_[j:i] in cost]
            best.append(min(options))
        out, i = [], len(run_)
        while i:
            j = best[i][1]
            out.append(run_[j:i])
            i = j
        return out[::-1]

    def run(text: str) -> Iterator[Token]:
        at = 0
        for m in [*is_run.finditer(text), None]:
            end = m.start() if m else len(text)
            for t in base(text[at:end]):
                yield replace(t, start=t.start + at, end=t.end + at)
            if m:
                s = m.start()
                for w in cut(m[0]):
                    yield Token(w, s, s + len(w), type=_type(w))
                    s += len(w)
                at = m.end()

    return run


@tokenizer
def japanese(words: Iterable[str] = ()) -> Tokenizer:
    return dictionary_segmenter(words, r"\p{Han}\p{Hiragana}\p{Katakana}ー")


@tokenizer
def korean(words: Iterable[str] = ()) -> Tokenizer:
    return dictionary_segmenter(words, r"\p{Hangul}")


@tokenizer
def hmm_chinese(words: Iterable[str] = ()) -> Tokenizer:
    return dictionary_segmenter(words, r"\p{Han}")


@tokenizer
def thai(words: Iterable[str] = ()) -> Tokenizer:
    return dictionary_segmenter(words, r"\p{Thai}")


@tokenizer
def icu() -> Tokenizer:
    """Word boundaries, with scripts kept apart."""
    inner = standard()
    scripts = regex.compile(r"\p{Latin}[\p{Latin}\p{M}]*|\p{Cyrillic}[\p{Cyrillic}\p{M}]*|\p{Greek}[\p{Greek}\p{M}]*|\p{N}+|.", regex.S)

    def run(text: str) -> Iterator[Token]:
        for t in inner(text):
            parts = scripts.findall(t.term)
            mixed = sum(bool(regex.match(r"\p{Latin}|\p{Cyrillic}|\p{Greek}", p)) for p in parts) > 1
            if not mixed:
                yield t
                continue
            s = t.start
            for p in parts:
                yield replace(t, term=p, start=s, end=s + len(p))
                s += len(p)

    return run


# --- case, letters, spelling -----------------------------------------------------------------------


@token_filter
def lowercase() -> TokenFilter:
    return each_term(lambda s: s.lower() if s.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c.lower()[0] for c in s))


@token_filter
def uppercase() -> TokenFilter:
    return each_term(lambda s: "".join(c.upper() if len(c.upper()) == 1 else c for c in s))


@token_filter
def turkish_lowercase() -> TokenFilter:
    return each_term(lambda s: s.replace("İ", "i").replace("İ", "i").replace("I", "ı").lower())


@token_filter
def greek_lowercase() -> TokenFilter:
    """Without accents, final sigma as sigma."""
    return each_term(lambda s: regex.sub(r"[́̈]", "", unicodedata.normalize("NFD", s.lower())).replace("ς", "σ"))


@token_filter
def irish_lowercase() -> TokenFilter:
    """nAthair to n-athair."""
    return each_term(lambda s: (s[0] + "-" + s[1:].lower()) if len(s) > 1 and s[0] in "nt" and s[1] in "AEIOUÁÉÍÓÚ" else s.lower())


@token_filter
def ascii_folding(preserve: bool = False) -> TokenFilter:
    """Letters of Latin script to ASCII. preserve: the unfolded token as well, at its place."""
    special = dict(zip("ßæœøđðþłıŋÆŒØĐÐÞŁŊẞ", ("ss", "ae", "oe", "o", "d", "d", "th", "l", "i", "n", "AE", "OE", "O", "D", "D", "TH", "L", "N", "SS"), strict=True))

    def fold(s: str) -> str:
        s = "".join(special.get(c, c) for c in s)
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            f = fold(t.term)
            if preserve and f != t.term:
                yield replace(t, term=f)
                yield replace(t, inc=0)
            else:
                t.term = f
                yield t

    return run


@token_filter
def icu_folding() -> TokenFilter:
    """Case, accents, widths and presentation forms folded."""
    return each_term(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c)))


@token_filter
def icu_normalizer(form: str = "NFKC") -> TokenFilter:
    return each_term(lambda s: unicodedata.normalize(form, s.casefold()))


@token_filter
def icu_transform(table: dict[str, str]) -> TokenFilter:
    """A transliteration, given as a table."""
    return each_term(mapping(table))


@token_filter
def cjk_width() -> TokenFilter:
    return each_term(_width)


@token_filter
def decimal_digit() -> TokenFilter:
    return each_term(lambda s: "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in s))


@token_filter
def reverse_string() -> TokenFilter:
    return each_term(lambda s: s[::-1])


@token_filter
def trim() -> TokenFilter:
    return each_term(str.strip)


@token_filter
def truncate(n: int = 10) -> TokenFilter:
    return each_term(lambda s: s[:n])


@token_filter
def pattern_replace(pattern: str, replacement: str = "", every: bool = True) -> TokenFilter:
    p, r = regex.compile(pattern), re.sub(r"\$(\d)", r"\\\1", replacement)
    return each_term(lambda s: p.sub(r, s, 0 if every else 1))


@token_filter
def elision(articles: Iterable[str] = ("l", "m", "t", "qu", "n", "s", "j", "d", "c", "jusqu", "quoiqu", "lorsqu", "puisqu")) -> TokenFilter:
    known = set(articles)

    def cut(s: str) -> str:
        m = regex.match(r"([^'’]+)['’](.+)", s)
        return m[2] if m and m[1].lower() in known else s

    return each_term(cut)


@token_filter
def apostrophe() -> TokenFilter:
    """What follows an apostrophe goes, with it."""
    return each_term(lambda s: regex.split("['’]", s)[0])


@token_filter
def english_possessive() -> TokenFilter:
    return each_term(lambda s: regex.sub("['’＇][sS]$", "", s))


@token_filter
def classic_filter() -> TokenFilter:
    """'s from words with apostrophes, dots from acronyms."""

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            if t.type == "<APOSTROPHE>":
                t.term = regex.sub("'[sS]$", "", t.term)
            elif t.type == "<ACRONYM>":
                t.term = t.term.replace(".", "")
            yield t

    return run


# --- choosing tokens --------------------------------------------------------------------------------


@token_filter
def stop(words: Iterable[str], ignore_case: bool = False) -> TokenFilter:
    known = {w.lower() for w in words} if ignore_case else set(words)
    return keeping(lambda t: (t.term.lower() if ignore_case else t.term) not in known)


@token_filter
def keep_words(words: Iterable[str], ignore_case: bool = False) -> TokenFilter:
    known = {w.lower() for w in words} if ignore_case else set(words)
    return keeping(lambda t: (t.term.lower() if ignore_case else t.term) in known)


@token_filter
def length(low: int = 0, high: int = 1 << 30) -> TokenFilter:
    """Also the window on code points: a Python string's length counts them."""
    return keeping(lambda t: low <= len(t.term) <= high)


codepoint_count = token_filter(lambda low=0, high=1 << 30: length(low, high))
FILTERS["codepoint_count"] = length


@token_filter
def types(names: Iterable[str], keep: bool = False) -> TokenFilter:
    """Drops tokens of some types, or keeps only these."""
    known = set(names)
    return keeping(lambda t: (t.type in known) == keep)


@token_filter
def date_recognizer(formats: Iterable[str] = ("%Y-%m-%d", "%m/%d/%Y", "%d.%m.%Y")) -> TokenFilter:
    """Keeps tokens that are dates."""
    from datetime import datetime

    fs = list(formats)

    def is_date(s: str) -> bool:
        for f in fs:
            try:
                datetime.strptime(s, f)
                return True
            except ValueError:
                pass
        return False

    return keeping(lambda t: is_date(t.term))


@token_filter
def limit_count(n: int) -> TokenFilter:
    def run(tokens: Tokens) -> Iterator[Token]:
        for i, t in enumerate(tokens):
            if i >= n:
                return
            yield t

    return run


@token_filter
def limit_offset(n: int) -> TokenFilter:
    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            if t.start > n:
                return
            yield t

    return run


@token_filter
def limit_position(n: int) -> TokenFilter:
    def run(tokens: Tokens) -> Iterator[Token]:
        at = 0
        for t in tokens:
            at += t.inc
            if at > n:
                return
            yield t

    return run


@token_filter
def remove_duplicates() -> TokenFilter:
    """Of equal terms at one position the first stays."""

    def run(tokens: Tokens) -> Iterator[Token]:
        seen: set[str] = set()
        for t in tokens:
            if t.inc > 0:
                seen.clear()
            if t.term not in seen:
                seen.add(t.term)
                yield t

    return run


@token_filter
def keyword_marker(words: Iterable[str] = (), pattern: str | None = None) -> TokenFilter:
    """Marks terms that stemmers leave alone, by a set or a pattern."""
    known, p = set(words), regex.compile(pattern) if pattern else None

    @by_run
    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            t.keyword = t.keyword or t.term in known or bool(p and p.fullmatch(t.term))
            yield t

    return run


FILTERS["set_keyword_marker"] = FILTERS["pattern_keyword_marker"] = keyword_marker


@token_filter
def keyword_repeat() -> TokenFilter:
    """Each token twice, first as a keyword."""

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            yield replace(t, keyword=True)
            yield replace(t, inc=0, keyword=False)

    return run


@token_filter
def conditional(filter_: TokenFilter, accept: Callable[[Token], bool]) -> TokenFilter:
    """A filter only for some tokens."""

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            yield from filter_([t]) if accept(t) else [t]

    return run


@token_filter
def fix_broken_offsets() -> TokenFilter:
    """Offsets never go back."""

    def run(tokens: Tokens) -> Iterator[Token]:
        last = 0
        for t in tokens:
            t.start = max(t.start, last)
            t.end = max(t.end, t.start)
            last = t.start
            yield t

    return run


@token_filter
def caching() -> TokenFilter:
    """Reads all tokens once; the list can be read again."""
    return lambda tokens: iter(list(tokens))


@token_filter
def tee(sinks: list[Callable[[Token], bool]]) -> TokenFilter:
    """Copies tokens that a sink accepts into its list `sink.tokens`."""

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            for s in sinks:
                if s(t):
                    s.tokens.append(replace(t))
            yield t

    return run


@token_filter
def flatten_graph() -> TokenFilter:
    """Tokens that span several positions are made to span one."""

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            t.length = 1
            yield t

    return run


# --- n-grams, shingles, compounds ----------------------------------------------------------------


@token_filter
def ngrams(low: int = 1, high: int = 2, preserve: bool = False) -> TokenFilter:
    """All n-grams of each term, at its position."""

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            found = [t.term[i : i + n] for i in range(len(t.term)) for n in range(low, high + 1) if i + n <= len(t.term)]
            if preserve and not low <= len(t.term) <= high:
                found.append(t.term)
            for k, g in enumerate(found):
                yield replace(t, term=g, inc=t.inc if k == 0 else 0)

    return run


@token_filter
def edge_ngrams(low: int = 1, high: int = 1, preserve: bool = False) -> TokenFilter:
    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            found = [t.term[:n] for n in range(low, min(high, len(t.term)) + 1)]
            if preserve and not low <= len(t.term) <= high:
                found.append(t.term)
            for k, g in enumerate(found):
                yield replace(t, term=g, inc=t.inc if k == 0 else 0)

    return run


@token_filter
def shingles(low: int = 2, high: int = 2, unigrams: bool = True, separator: str = " ", filler: str = "_") -> TokenFilter:
    """Runs of low to high tokens, joined; holes are filled."""

    def run(tokens: Tokens) -> Iterator[Token]:
        flat: list[Token | None] = []
        for t in tokens:
            flat += [None] * (t.inc - 1) + [t]
        for i, t in enumerate(flat):
            first = True
            if unigrams and t is not None:
                yield replace(t, inc=1)
                first = False
            for n in range(low, high + 1):
                part = flat[i : i + n]
                if len(part) < n or all(p is None for p in part):
                    continue
                real = [p for p in part if p is not None]
                yield Token(separator.join(filler if p is None else p.term for p in part), real[0].start, real[-1].end, inc=1 if first else 0, type="shingle", length=n)
                first = False

    return run


@token_filter
def fixed_shingles(n: int = 2, separator: str = " ", filler: str = "_") -> TokenFilter:
    return shingles(n, n, False, separator, filler)


@token_filter
def common_grams(words: Iterable[str], ignore_case: bool = False) -> TokenFilter:
    """Bigrams with an underscore beside frequent words."""
    known = {w.lower() for w in words} if ignore_case else set(words)
    is_common = lambda t: (t.term.lower() if ignore_case else t.term) in known

    def run(tokens: Tokens) -> Iterator[Token]:
        before = None
        for t in tokens:
            if before is not None and (is_common(before) or is_common(t)):
                yield Token(f"{before.term}_{t.term}", before.start, t.end, inc=0, type="gram", length=2)
            yield t
            before = t

    return run


@token_filter
def common_grams_query(words: Iterable[str], ignore_case: bool = False) -> TokenFilter:
    """Only the bigrams where there are any."""
    inner = common_grams(words, ignore_case)

    def run(tokens: Tokens) -> Iterator[Token]:
        found = list(inner(tokens))
        covered = set()
        singles = [t for t in found if t.type != "gram"]
        for g in (t for t in found if t.type == "gram"):
            covered |= {s.start for s in singles if s.start >= g.start and s.end <= g.end}
        out = [replace(t, inc=1) for t in found if t.type == "gram" or t.start not in covered]
        yield from sorted(out, key=lambda t: t.start)

    return run


@token_filter
def cjk_bigrams(unigrams: bool = False) -> TokenFilter:
    """Bigrams of adjoining CJK tokens; a lone one stays."""
    kinds = {"<IDEOGRAPHIC>", "<HIRAGANA>", "<KATAKANA>", "<HANGUL>"}

    def flush(run_: list[Token]) -> Iterator[Token]:
        cs = [Token(c, t.start + i, t.start + i + 1, type=t.type) for t in run_ for i, c in enumerate(t.term)]
        if len(cs) == 1:
            yield replace(cs[0], type="<SINGLE>")
            return
        for i, c in enumerate(cs):
            if unigrams:
                yield replace(c, type="<SINGLE>")
            if i + 1 < len(cs):
                yield Token(c.term + cs[i + 1].term, c.start, cs[i + 1].end, inc=0 if unigrams else 1, type="<DOUBLE>", length=2 if unigrams else 1)

    def run(tokens: Tokens) -> Iterator[Token]:
        held: list[Token] = []
        for t in tokens:
            if held and (t.type not in kinds or t.start != held[-1].end):
                yield from flush(held)
                held = []
            if t.type in kinds:
                held.append(t)
            else:
                yield t
        if held:
            yield from flush(held)

    return run


@token_filter
def dictionary_compounds(words: Iterable[str], min_word: int = 5, min_part: int = 2, max_part: int = 15, longest: bool = False) -> TokenFilter:
    """Compounds with the dictionary words in them, at their position."""
    known = {w.lower() for w in words}

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            yield t
            if len(t.term) < min_word:
                continue
            low = t.term.lower()
            for i in range(len(low) - min_part + 1):
                found = [n for n in range(min_part, min(max_part, len(low) - i) + 1) if low[i : i + n] in known]
                for n in found[-1:] if longest else found:
                    yield replace(t, term=t.term[i : i + n], inc=0)

    return run


@token_filter
def hyphenation_compounds(hyphenate: Callable[[str], list[int]], words: Iterable[str] | None = None, min_word: int = 5, min_part: int = 2, max_part: int = 15) -> TokenFilter:
    """Compounds with their parts between points where a word may be hyphenated, if a dictionary has them."""
    known = {w.lower() for w in words} if words is not None else None

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            yield t
            if len(t.term) < min_word:
                continue
            points = [0, *hyphenate(t.term.lower()), len(t.term)]
            for i, a in enumerate(points):
                for b in points[i + 1 :]:
                    if min_part <= b - a <= max_part and b - a < len(t.term) and (known is None or t.term[a:b].lower() in known):
                        yield replace(t, term=t.term[a:b], inc=0)

    return run


@token_filter
def word_delimiter(parts: bool = True, numbers: bool = True, catenate_words: bool = False, catenate_numbers: bool = False, catenate_all: bool = False, on_case: bool = True, on_numerics: bool = True, preserve: bool = False, possessive: bool = True) -> TokenFilter:
    """Splits at delimiters, changes of case and between letters and digits."""

    def split(s: str) -> list[tuple[int, str]]:
        if possessive:
            s = regex.sub("['’][sS](?=$|[^\\p{L}\\p{N}])", lambda m: " " * len(m[0]), s)
        p = r"\p{Lu}?\p{Ll}+|\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}+|\p{Lo}+" if on_case else r"\p{L}+"
        p = rf"(?:{p})|\p{{N}}+" if on_numerics else (rf"\p{{N}}+|(?:{p})" if on_case else r"[\p{L}\p{N}]+")
        return [(m.start(), m[0]) for m in regex.finditer(p, s)]

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            found = split(t.term)
            if t.keyword or not found or (len(found) == 1 and found[0][1] == t.term):
                if found or t.keyword:
                    yield t
                continue
            out = []
            if preserve:
                out.append((0, t.term))
            if catenate_all:
                out.append((0, "".join(w for _, w in found)))
            runs: list[list[tuple[int, str]]] = []
            for x in found:
                if runs and runs[-1][0][1][0].isdigit() == x[1][0].isdigit():
                    runs[-1].append(x)
                else:
                    runs.append([x])
            for r in runs:
                number = r[0][1][0].isdigit()
                if len(r) > 1 and (catenate_numbers if number else catenate_words):
                    out.append((r[0][0], "".join(w for _, w in r)))
            out += [(s, w) for s, w in found if (numbers if w[0].isdigit() else parts)]
            seen: set[str] = set()
            where = {s: i for i, (s, _) in enumerate(found)}
            last, first = -1, True
            for s, w in sorted(out, key=lambda x: (where.get(x[0], 0), -len(x[1]))):
                if (k := f"{s} {w}") in seen:
                    continue
                seen.add(k)
                at = where.get(s, 0)
                yield replace(t, term=w, start=t.start + s, end=t.start + s + len(w) if w in t.term else t.end, inc=t.inc if first else at - last)
                last, first = at, False

    return run


@token_filter
def pattern_capture(patterns: Iterable[str], preserve: bool = True) -> TokenFilter:
    """Each group of each pattern as a token at the same place."""
    ps = [regex.compile(p) for p in patterns]

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            out = [t.term] if preserve else []
            for p in ps:
                for m in p.finditer(t.term):
                    out += [g for g in (m.groups() if p.groups else (m[0],)) if g and g not in out]
            for i, w in enumerate(out or [t.term]):
                yield replace(t, term=w, inc=t.inc if i == 0 else 0)

    return run


@token_filter
def pattern_typing(rules: Iterable[tuple[str, str]]) -> TokenFilter:
    """The type of the first pattern that matches; $1 stands for a group."""
    rs = [(regex.compile(p), re.sub(r"\$(\d)", r"\\\1", name)) for p, name in rules]

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            for p, name in rs:
                if m := p.match(t.term):
                    t.type = m.expand(name)
                    break
            yield t

    return run


# --- synonyms, payloads, fingerprints -----------------------------------------------------------------


@token_filter
def synonyms(table: dict[str, list[str]], ignore_case: bool = True, keep: bool = True) -> TokenFilter:
    """Phrases (words joined by spaces) to others at their place; the longest match counts."""
    rules = {tuple((k.lower() if ignore_case else k).split()): v for k, v in table.items()}
    longest = max(map(len, rules), default=1)

    def run(tokens: Tokens) -> Iterator[Token]:
        ts = list(tokens)
        i = 0
        while i < len(ts):
            for n in range(min(longest, len(ts) - i), 0, -1):
                key = tuple((t.term.lower() if ignore_case else t.term) for t in ts[i : i + n])
                if key in rules:
                    first = True
                    for s in rules[key]:
                        for j, w in enumerate(s.split()):
                            yield Token(w, ts[i].start, ts[i + n - 1].end, inc=(ts[i].inc if first else 0) if j == 0 else 1, type="SYNONYM", length=n if len(s.split()) == 1 else 1)
                            first = False
                    if keep:
                        for j, t in enumerate(ts[i : i + n]):
                            yield replace(t, inc=0 if j == 0 else t.inc)
                    i += n
                    break
            else:
                yield ts[i]
                i += 1

    return run


@token_filter
def type_as_synonym(prefix: str = "") -> TokenFilter:
    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            yield t
            yield replace(t, term=prefix + t.type, inc=0)

    return run


@token_filter
def word2vec_synonyms(vectors: dict[str, list[float]], k: int = 3, least: float = 0.8) -> TokenFilter:
    """The nearest words of a table of vectors, at a token's place, boosted by their cosine."""
    import numpy as np

    names = list(vectors)
    m = np.array([vectors[n] for n in names], float).reshape(len(names), -1)
    m = m / np.maximum(1e-12, np.linalg.norm(m, axis=1, keepdims=True))
    at = {n: i for i, n in enumerate(names)}

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            yield t
            if t.term in at:
                s = m @ m[at[t.term]]
                for i in sorted((i for i in range(len(names)) if names[i] != t.term and s[i] >= least), key=lambda i: (-s[i], names[i]))[:k]:
                    yield replace(t, term=names[i], inc=0, type="SYNONYM", boost=float(s[i]))

    return run


@token_filter
def delimited_payload(delimiter: str = "|", encode: Callable[[str], bytes] = str.encode) -> TokenFilter:
    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            term, d, payload = t.term.partition(delimiter)
            yield replace(t, term=term, payload=encode(payload)) if d else t

    return run


@token_filter
def delimited_boost(delimiter: str = "|") -> TokenFilter:
    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            term, d, boost = t.term.partition(delimiter)
            yield replace(t, term=term, boost=float(boost)) if d else t

    return run


@token_filter
def numeric_payload(value: float, of_type: str) -> TokenFilter:
    import struct

    def run(tokens: Tokens) -> Iterator[Token]:
        for t in tokens:
            yield replace(t, payload=struct.pack(">f", value)) if t.type == of_type else t

    return run


@token_filter
def type_as_payload() -> TokenFilter:
    return lambda tokens: (replace(t, payload=t.type.encode()) for t in tokens)


@token_filter
def offset_payload() -> TokenFilter:
    return lambda tokens: (replace(t, payload=t.start.to_bytes(4, "big") + t.end.to_bytes(4, "big")) for t in tokens)


@token_filter
def min_hash(hashes: int = 1, buckets: int = 512, size: int = 1, rotate: bool = True) -> TokenFilter:
    """The smallest hash of each bucket, as terms; rotate fills empty buckets from the next."""
    import xxhash

    def run(tokens: Tokens) -> Iterator[Token]:
        terms = [t.term for t in tokens]
        for k in range(hashes):
            best: dict[int, list[int]] = {}
            for w in terms:
                h = xxhash.xxh64_intdigest(w, k)
                b = best.setdefault(h * buckets >> 64, [])
                if h not in b:
                    b.append(h)
                    b.sort()
                    del b[size:]
            for b in range(buckets):
                own = best.get(b)
                if own is None and rotate and best:
                    own = next(best[(b + d) % buckets] for d in range(1, buckets + 1) if (b + d) % buckets in best)
                for h in own or ():
                    yield Token(f"{k:x}:{b:x}:{h:016x}", inc=0)

    return run


# --- analyzers ---------------------------------------------------------------------------------------

TOKEN_TYPE = "array<struct<term:string,pos:int,start:int,end:int,type:string,length:int>>"


@dataclass(frozen=True)
class Analyzer:
    """char filters, a tokenizer and token filters."""

    tokenizer: Tokenizer
    filters: tuple[TokenFilter, ...] = ()
    char_filters: tuple[CharFilter, ...] = ()
    name: str = ""

    @property
    def by_run(self) -> bool:
        """Whether the terms of a text are those of its runs without white space, each analysed alone."""
        return not self.char_filters and all(getattr(f, "by_run", False) for f in (self.tokenizer, *self.filters))

    def stream(self, text: str | None) -> Iterable[Token]:
        if text is None:
            return ()
        for c in self.char_filters:
            text = c(text)
        tokens: Tokens = self.tokenizer(text)
        for f in self.filters:
            tokens = f(tokens)
        return tokens

    def analyze(self, text: str | None) -> list[Token]:
        return list(self.stream(text))

    def terms(self, text: str | None) -> list[str]:
        return [t.term for t in self.analyze(text)]

    def positions(self, text: str | None) -> list[tuple[int, Token]]:
        at, out = -1, []
        for t in self.analyze(text):
            at += t.inc
            out.append((at, t))
        return out

    def tokens(self, text: Column) -> Column:
        """TOKEN_TYPE, computed by Arrow batch."""
        own = self

        @F.pandas_udf(TOKEN_TYPE)
        def udf(s: pd.Series) -> pd.Series:
            return s.map(lambda x: [{"term": t.term, "pos": p, "start": t.start, "end": t.end, "type": t.type, "length": t.length} for p, t in own.positions(x)])

        return udf(text)

    def __call__(self, text: Column) -> Column:
        return self.tokens(text)


#: Bytes of an Arrow batch where the session doesn't bound them. What term_counts() holds at most: characters of texts, runs or terms.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
HELD_CHARS, HELD = 1 << 25, 300_000


def _runs(text: str) -> Iterator[list[str]]:
    """The runs without white space, in lists of bounded size."""
    if len(text) <= 1 << 20:
        yield text.split()
        return
    found = (m[0] for m in _CHUNK.finditer(text))
    while some := list(islice(found, 100_000)):
        yield some


def term_counts(rows: DataFrame, text: str, analyzers: dict[str, Analyzer], weight: str | None = None) -> DataFrame:
    """(analyzer, term, n): how often each term occurs in all rows' texts under each analyzer; a row counts `weight` times.

    Nothing is kept of a token but its term. A task counts runs without white space and analyses each different one once, where
    chains go by runs; other chains get whole texts. What it holds is bounded: beyond that it gives out what it has counted.
    """
    whole = {n: a for n, a in analyzers.items() if not a.by_run}
    cut = {n: a for n, a in analyzers.items() if a.by_run}
    columns = [F.col(text).alias("x"), *([F.col(weight).cast("bigint").alias("n")] if weight else [])]
    if rows.sparkSession.conf.get(BATCH_CONF, None) is None:
        rows.sparkSession.conf.set(BATCH_CONF, BATCH_BYTES)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: Counter[str] = Counter()
        terms: dict[str, Counter[str]] = {n: Counter() for n in analyzers}
        chars, most = 0, HELD // len(terms)

        def out(least: int) -> Iterator[pa.RecordBatch]:
            for name, c in terms.items():
                if len(c) > least:
                    items = iter(c.items())
                    while some := list(islice(items, 50_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array([t for t, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], ["analyzer", "term", "n"])
                    c.clear()

        def add(x: str, n: int, chains: dict[str, Analyzer]) -> Iterator[pa.RecordBatch]:
            for name, a in chains.items():
                c = terms[name]
                for t in a.stream(x):
                    c[t.term] += n
                    if len(c) > most:
                        yield from out(most)

        def words(a: Analyzer) -> Iterator[Token]:
            """The runs' different tokens; flags: how often."""
            found: Counter[tuple[str, str]] = Counter()
            for x, n in runs.items():
                for t in a.tokenizer(x):
                    found[t.term, t.type] += n
            for (term, kind), n in found.items():
                yield Token(term, type=kind, flags=n)

        def analyzed() -> Iterator[pa.RecordBatch]:
            for name, a in cut.items():
                c, tokens = terms[name], words(a)
                for f in a.filters:
                    tokens = f(tokens)
                for t in tokens:
                    c[t.term] += t.flags
                    if len(c) > most:
                        yield from out(most)
            runs.clear()

        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                for x, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist() if weight else [1] * part.num_rows, strict=True):
                    if x is None:
                        continue
                    yield from add(x, n, whole)
                    for some in _runs(x) if cut else ():
                        if n == 1:
                            runs.update(some)
                        else:
                            for r in some:
                                runs[r] += n
                        chars += sum(map(len, some))
                        if len(runs) > HELD or chars > HELD_CHARS:
                            yield from analyzed()
                            chars = 0
        yield from analyzed()
        yield from out(0)

    return rows.select(*columns).mapInArrow(counted, "analyzer string, term string, n bigint").groupBy("analyzer", "term").agg(F.sum("n").alias("n"))


def build(tokenizer: str | tuple, filters: Iterable[str | tuple] = (), char_filters: Iterable[str | tuple] = (), name: str = "") -> Analyzer:
    """An analyzer from names, or (name, keyword arguments) pairs."""

    def make(table: dict, spec: str | tuple):
        key, options = (spec, {}) if isinstance(spec, str) else spec
        if key not in table:
            raise ValueError(f"no component {key}")
        return table[key](**options)

    return Analyzer(make(TOKENIZERS, tokenizer), tuple(make(FILTERS, f) for f in filters), tuple(make(CHAR_FILTERS, c) for c in char_filters), name)


@dataclass(frozen=True)
class PerField:
    """An analyzer for each field."""

    default: Analyzer
    fields: dict[str, Analyzer] = field(default_factory=dict)

    def of(self, name: str) -> Analyzer:
        return self.fields.get(name, self.default)
