"""Orthographic normalisation by language, as token filters."""

from __future__ import annotations

import functools
import unicodedata

import regex

from .analysis import FILTERS, each_term


def _table(pairs: str) -> dict[int, str]:
    return {ord(p[0]): p[1:] for p in pairs.split()}


def _translate(pairs: str, drop: str = ""):
    t = _table(pairs) | {ord(c): "" for c in drop}
    return lambda s: s.translate(t)


_GERMAN = _table("äa öo üu")
_GERMAN_E = regex.compile(r"(?<![aeiouq])ue|(?<=^|[^aeiou])(?:ae|oe)")


def german(s: str) -> str:
    """Umlauts and their spellings with e to plain vowels, except after q or a vowel; sharp s to ss."""
    if not s.isascii():
        s = s.replace("ß", "ss").translate(_GERMAN)
    return _GERMAN_E.sub(lambda m: m[0][0], s) if "ue" in s or "ae" in s or "oe" in s else s


def scandinavian(s: str) -> str:
    """Interchangeable letters to åæø and their capitals."""
    s = s.translate(_table("äæ ÄÆ öø ÖØ"))
    return regex.sub(r"aa|AA|Aa|ae|AE|Ae|ao|AO|Ao|oe|OE|Oe|oo|OO|Oo", lambda m: {"a": "å", "e": "æ", "o": "å"}[m[0][1].lower()] if m[0][0] == "a" else {"a": "Å", "e": "Æ", "o": "Å"}[m[0][1].lower()] if m[0][0] == "A" else ("ø" if m[0][0] == "o" else "Ø"), s)


def scandinavian_folding(s: str) -> str:
    """åäæ to a and öø to o; aa, ae, ao and oe, oo as well."""
    s = s.translate(_table("åa äa æa ÅA ÄA ÆA öo øo ÖO ØO"))
    return regex.sub(r"(?i)a[aeo]|o[eo]", lambda m: m[0][0], s)


def norwegian(s: str) -> str:
    """Spellings without the letters to åæø."""
    return regex.sub(r"aa|ae|oe", lambda m: {"aa": "å", "ae": "æ", "oe": "ø"}[m[0]], s)


#: Letters of Serbian Cyrillic and their Latin spellings.
SERBIAN = "аa бb вv гg дd ђđ еe жž зz иi јj кk лl љlj мm нn њnj оo пp рr сs тt ћć уu фf хh цc чč џdž шš"


def serbian(s: str) -> str:
    """Cyrillic to bald Latin."""
    s = s.lower().translate(_table(SERBIAN)).replace("đ", "dj")
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


_INDIC = ((0x0900, 0x097F), (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0A80, 0x0AFF), (0x0B00, 0x0B7F), (0x0B80, 0x0BFF), (0x0C00, 0x0C7F), (0x0C80, 0x0CFF), (0x0D00, 0x0D7F))


def indic(s: str) -> str:
    """Decomposed vowels and nuktas of Indic scripts composed, joiners dropped."""
    s = unicodedata.normalize("NFC", s.replace("‌", "").replace("‍", ""))
    for old, new in (("अा", "आ"), ("अो", "ओ"), ("अौ", "औ"), ("আা", "আ"), ("ఒౌ", "ఔ")):
        s = s.replace(old, new)
    return s


def hindi(s: str) -> str:
    """Nuktas, chandrabindus and long vowels to their plain forms."""
    s = unicodedata.normalize("NFD", s).replace("़", "").replace("ँ", "ं").replace("ऀ", "ं")
    s = unicodedata.normalize("NFC", s).replace("न्", "ं").replace("‍", "").replace("‌", "").replace("्", "")
    return s.translate(_table("ऍए ऎए ऐए ॅे ॆे ैे ऑओ ऒओ औओ ॉो ॊो ौो आअ ईइ ऊउ ॠऋ ॡऌ ीि ूु ॄृ ॣॢ"))


NORMALIZERS = {
    "arabic": _translate("آا أا إا ىي ةه", "ًٌٍَُِّْـ"),
    "persian": _translate("یي ےي کك هٔه ۀه ەه ہه", "ٔـ"),
    "sorani": lambda s: regex.sub("ه‌", "ە", regex.sub("ه$", "ە", s.translate(_table("يی ىی كک ةە ھه ڕر ڒر"))))
    .translate({ord(c): "" for c in "ًٌٍَُِّْـ‌"}),
    "bengali": lambda s: indic(s).translate(_table("ীি ূু ঐই ঈই ঊউ শস ষস ণন ৎত")).replace("্য", "").replace("ঁ", ""),
    "telugu": lambda s: indic(s).translate(_table("ఔఒ ఐఏ ఆఅ ఈఇ ఊఉ ఓఒ ఏఎ ీి ూు ేె ోొ")),
    "hindi": hindi,
    "indic": indic,
    "romanian": _translate("ţț şș ŢȚ ŞȘ"),
    "german": german,
    "scandinavian": scandinavian,
    "scandinavian_folding": scandinavian_folding,
    "norwegian": norwegian,
    "serbian": serbian,
    "ukrainian": _translate("’' ґг", "̀́"),
    "hiragana_uppercase": _translate("ぁあ ぃい ぅう ぇえ ぉお っつ ゃや ゅゆ ょよ ゎわ ゕか ゖけ"),
    "katakana_uppercase": _translate("ァア ィイ ゥウ ェエ ォオ ッツ ャヤ ュユ ョヨ ヮワ ヵカ ヶケ"),
    "katakana_stem": lambda s: s[:-1] if len(s) >= 4 and s.endswith("ー") and regex.fullmatch(r"[\p{Katakana}ー]+", s) else s,
}

#: Digits and units of Japanese and Korean numerals.
DIGITS = dict(zip("〇一二三四五六七八九零영일이삼사오육칠팔구", [*range(10), 0, *range(10)], strict=True))
UNITS = {"十": 10, "百": 100, "千": 1000, "십": 10, "백": 100, "천": 1000}
MYRIADS = {"万": 10**4, "億": 10**8, "兆": 10**12, "京": 10**16, "만": 10**4, "억": 10**8, "조": 10**12, "경": 10**16}


def numeral(s: str) -> str:
    """A numeral of digits, units and myriads as an ASCII number; anything else as it is."""
    plain = unicodedata.normalize("NFKC", s).replace(",", "")
    if not plain or not all(c in DIGITS or c in UNITS or c in MYRIADS or c.isdecimal() or c == "." for c in plain):
        return s
    if regex.fullmatch(r"[\d.]+", plain):
        return plain
    total, part, digits = 0, 0, ""
    for c in plain:
        if c in DIGITS or c.isdecimal() or c == ".":
            digits += str(DIGITS.get(c, c))
            continue
        value = float(digits) if digits else 1
        digits = ""
        if c in UNITS:
            part += value * UNITS[c]
        else:
            total += (part + (value if value != 1 or not part else 0)) * MYRIADS[c]
            part = 0
    total += part + (float(digits) if digits else 0)
    return str(int(total)) if total == int(total) else str(total)


NORMALIZERS["japanese_number"] = NORMALIZERS["korean_number"] = numeral


def _filter(name: str):
    return each_term(NORMALIZERS[name])


for _name in NORMALIZERS:
    FILTERS[f"{_name}_normalization"] = functools.partial(_filter, _name)
