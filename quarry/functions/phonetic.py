"""Phonetic codes: Soundex, refined Soundex, Daitch-Mokotoff, Metaphone, Caverphone-like and Cologne codes."""

from __future__ import annotations

import functools
from dataclasses import replace

import regex

from .analysis import FILTERS, TokenFilter

#: Consonant classes.
SOUNDEX = {c: d for cs, d in (("BFPV", "1"), ("CGJKQSXZ", "2"), ("DT", "3"), ("L", "4"), ("MN", "5"), ("R", "6")) for c in cs}
REFINED = {c: d for cs, d in (("AEHIOUWY", "0"), ("BP", "1"), ("FV", "2"), ("CKS", "3"), ("GJ", "4"), ("QXZ", "5"), ("DT", "6"), ("L", "7"), ("MN", "8"), ("R", "9")) for c in cs}
#: Daitch-Mokotoff rules (letters, code at the start, before a vowel, elsewhere).
DAITCH = """SCHTSCH 2 4 4|SCHTSH 2 4 4|SCHTCH 2 4 4|SHTCH 2 4 4|SHTSH 2 4 4|STSCH 2 4 4|TTSCH 4 4 4|ZHDZH 2 4 4|SHCH 2 4 4|SCHT 2 43 43|SCHD 2 43 43|STCH 2 4 4|STRZ 2 4 4|STRS 2 4 4|STSH 2 4 4|SZCZ 2 4 4|SZCS 2 4 4|TTCH 4 4 4|TSCH 4 4 4|TTSZ 4 4 4|ZDZH 2 4 4|ZSCH 4 4 4|CHS 5 54 54|CSZ 4 4 4|CZS 4 4 4|DRZ 4 4 4|DRS 4 4 4|DSH 4 4 4|DSZ 4 4 4|DZH 4 4 4|DZS 4 4 4|SCH 4 4 4|SHT 2 43 43|SZT 2 43 43|SHD 2 43 43|SZD 2 43 43|TCH 4 4 4|TRZ 4 4 4|TRS 4 4 4|TSH 4 4 4|TTS 4 4 4|TTZ 4 4 4|TZS 4 4 4|TSZ 4 4 4|ZDZ 2 4 4|ZHD 2 43 43|ZSH 4 4 4|AI 0 1 -|AJ 0 1 -|AY 0 1 -|AU 0 7 -|CZ 4 4 4|CS 4 4 4|DS 4 4 4|DZ 4 4 4|DT 3 3 3|EI 0 1 -|EJ 0 1 -|EY 0 1 -|EU 1 1 -|FB 7 7 7|IA 1 - -|IE 1 - -|IO 1 - -|IU 1 - -|KS 5 54 54|KH 5 5 5|MN 66 66 66|NM 66 66 66|OI 0 1 -|OJ 0 1 -|OY 0 1 -|PF 7 7 7|PH 7 7 7|SH 4 4 4|SC 2 4 4|ST 2 43 43|SD 2 43 43|SZ 4 4 4|TH 3 3 3|TS 4 4 4|TC 4 4 4|TZ 4 4 4|UI 0 1 -|UJ 0 1 -|UY 0 1 -|UE 0 - -|ZD 2 43 43|ZH 4 4 4|ZS 4 4 4|CH 5 5 5|CK 5 5 5|RS 94 94 94|RZ 94 94 94|A 0 - -|B 7 7 7|C 5 5 5|D 3 3 3|E 0 - -|F 7 7 7|G 5 5 5|H 5 5 -|I 0 - -|J 1 - -|K 5 5 5|L 8 8 8|M 6 6 6|N 6 6 6|O 0 - -|P 7 7 7|Q 5 5 5|R 9 9 9|S 4 4 4|T 3 3 3|U 0 - -|V 7 7 7|W 7 7 7|X 5 54 54|Y 1 - -|Z 4 4 4"""
_RULES = [tuple(r.split()) for r in DAITCH.split("|")]


def _letters(s: str) -> str:
    return regex.sub(r"[^A-Z]", "", s.upper())


def soundex(s: str) -> str:
    w = _letters(s)
    if not w:
        return ""
    out, last = w[0], SOUNDEX.get(w[0], "")
    for c in w[1:]:
        d = SOUNDEX.get(c, "")
        if d and d != last:
            out += d
        if c not in "HW":
            last = d
    return (out + "000")[:4]


def refined_soundex(s: str) -> str:
    w = _letters(s)
    if not w:
        return ""
    out, last = w[0], None
    for c in w:
        d = REFINED.get(c, "")
        if d != last:
            out += d
        last = d
    return out


def daitch_mokotoff(s: str) -> str:
    """The first of a name's codes, of six digits."""
    w = _letters(s)
    out, last, i = "", "", 0
    while i < len(w):
        pat, first, vowel, other = next(r for r in _RULES if w.startswith(r[0], i))
        after = w[i + len(pat) : i + len(pat) + 1]
        code = first if i == 0 else vowel if after and after in "AEIOU" else other
        code = "" if code == "-" else code
        if code and code != last:
            out += code
        last = code
        i += len(pat)
    return (out + "000000")[:6] if w else ""


def metaphone(s: str, length: int = 4) -> str:
    """Sounds of consonants, vowels only at the start."""
    w = _letters(s)
    w = regex.sub(r"([A-BD-Z])\1+", r"\1", w)
    w = regex.sub(r"^(?:KN|GN|PN|AE|WR)", lambda m: m[0][1], w)
    w = regex.sub(r"^X", "S", w)
    w = regex.sub(r"^WH", "W", w)
    out = ""
    i = 0
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    while i < len(w) and len(out) < length:
        c = w[i]
        n, p = at(i + 1), at(i - 1)
        if c in "AEIOU":
            out += c if i == 0 else ""
        elif c == "B":
            out += "" if p == "M" and i == len(w) - 1 else "B"
        elif c == "C":
            if n and n in "EIY":
                out += "X" if n == "I" and at(i + 2) == "A" else "" if p == "S" else "S"
            elif n == "H":
                out += "K" if i == 0 and at(i + 2) not in tuple("AEIOU") else "X"
                i += 1
            else:
                out += "K"
        elif c == "D":
            out += "J" if n == "G" and at(i + 2) in tuple("EIY") else "T"
        elif c == "G":
            if n == "H" and not (i + 2 < len(w) and at(i + 2) in "AEIOU"):
                pass
            elif n == "N" and i + 2 >= len(w):
                pass
            elif n and n in "EIY" and p != "G":
                out += "J"
            else:
                out += "K"
        elif c == "H":
            out += "H" if n and n in "AEIOU" and p not in tuple("CSPTG") else ""
        elif c == "K":
            out += "" if p == "C" else "K"
        elif c == "P":
            out += "F" if n == "H" else "P"
        elif c == "Q":
            out += "K"
        elif c == "S":
            if n == "H":
                out += "X"
                i += 1
            else:
                out += "X" if n == "I" and at(i + 2) in tuple("AO") else "S"
        elif c == "T":
            if n == "H":
                out += "0"
                i += 1
            elif n == "I" and at(i + 2) in tuple("AO"):
                out += "X"
            elif not (n == "C" and at(i + 2) == "H"):
                out += "T"
        elif c == "V":
            out += "F"
        elif c in "WY":
            out += c if n and n in "AEIOU" else ""
        elif c == "X":
            out += "KS"
        elif c == "Z":
            out += "S"
        else:
            out += c
        i += 1
    return out[:length]


def double_metaphone(s: str, length: int = 4) -> tuple[str, str]:
    """A first and a second code; the second hears Slavic and Germanic spellings."""
    w = _letters(s)
    second = w.replace("W", "V").replace("CZ", "CH").replace("SCH", "SK").replace("J", "Y").replace("GN", "N")
    return metaphone(w, length), metaphone(second, length)


def cologne(s: str) -> str:
    """Kölner Phonetik."""
    w = regex.sub(r"[^A-Z]", "", s.upper().replace("Ä", "A").replace("Ö", "O").replace("Ü", "U").replace("ß", "S"))
    codes = []
    for i, c in enumerate(w):
        n, p = w[i + 1 : i + 2], w[i - 1 : i] if i else ""
        if c in "AEIJOUY":
            d = "0"
        elif c == "H":
            continue
        elif c == "B" or (c == "P" and n != "H"):
            d = "1"
        elif c in "DT":
            d = "8" if n and n in "CSZ" else "2"
        elif c in "FVWP":
            d = "3"
        elif c in "GKQ":
            d = "4"
        elif c == "C":
            d = "4" if (i == 0 and n and n in "AHKLOQRUX") or (i and n and n in "AHKOQUX" and p not in "SZ") else "8"
        elif c == "X":
            d = "8" if p and p in "CKQ" else "48"
        else:
            d = {"L": "5", "M": "6", "N": "6", "R": "7"}.get(c, "8")
        codes.append(d)
    flat = regex.sub(r"(\d)\1+", r"\1", "".join(codes))
    return flat[:1] + flat[1:].replace("0", "")


ENCODERS = {"soundex": soundex, "refined_soundex": refined_soundex, "metaphone": metaphone, "cologne": cologne, "daitch_mokotoff": daitch_mokotoff}


def phonetic_filter(encoder: str = "metaphone", inject: bool = True) -> TokenFilter:
    """Codes of terms; inject: beside them, at the same position."""
    fn = functools.lru_cache(100_000)(ENCODERS[encoder])

    def run(tokens):
        for t in tokens:
            code = fn(t.term)
            if not code or code == t.term:
                yield t
            elif inject:
                yield t
                yield replace(t, term=code, inc=0)
            else:
                yield replace(t, term=code)

    return run


def double_metaphone_filter(length: int = 4, inject: bool = True) -> TokenFilter:
    def run(tokens):
        for t in tokens:
            codes = [c for c in dict.fromkeys(double_metaphone(t.term, length)) if c]
            out = ([t.term] if inject or not codes else []) + codes
            for i, c in enumerate(dict.fromkeys(out)):
                yield replace(t, term=c, inc=t.inc if i == 0 else 0)

    return run


def beider_morse_filter(rules: list[tuple[str, str]] = (("sch", "S"), ("sh", "S"), ("ch", "x"), ("cz", "tS"), ("ph", "f"), ("w", "v"), ("ck", "k"), ("tz", "ts"))) -> TokenFilter:
    """A phonetic spelling by ordered rules, without double letters."""

    def code(s: str) -> str:
        s = s.lower()
        for a, b in rules:
            s = s.replace(a, b)
        return regex.sub(r"(.)\1+", r"\1", s)

    return lambda tokens: (replace(t, term=code(t.term)) for t in tokens)


FILTERS |= {"phonetic": phonetic_filter, "double_metaphone": double_metaphone_filter, "daitch_mokotoff": lambda inject=True: phonetic_filter("daitch_mokotoff", inject), "beider_morse": beider_morse_filter}
