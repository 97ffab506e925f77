"""Snowball stemmers from the algorithms' published descriptions: English, German, Swedish, Norwegian and Danish.

All work on regions: R1 begins behind the first consonant that follows a vowel, R2 is R1 of R1.
A step takes the longest of its suffixes that ends the word, or the region where the description
says so, and changes it on its condition.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable


def region(word: str, vowels: str, start: int = 0) -> int:
    """Where the region begins that follows the first non-vowel after a vowel, from `start`."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def longest(word: str, suffixes: Iterable[str], since: int = 0) -> str:
    """The longest suffix of a word that begins at `since` or later; an empty string if there is none."""
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= since), key=len, default="")


# --- English ----------------------------------------------------------------------------------------------

EN_VOWELS = "aeiouy"
#: Fixed values of the English algorithm.
EN_DOUBLES = "bb dd ff gg mm nn pp rr tt".split()
EN_LI = "cdeghkmnrt"
EN_PREFIXES = "gener commun arsen".split()
EN_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
EN_AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())
EN_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _short_end(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in EN_VOWELS and w[1] not in EN_VOWELS
    return len(w) > 2 and w[-3] not in EN_VOWELS and w[-2] in EN_VOWELS and w[-1] not in EN_VOWELS + "wxY"


@functools.lru_cache(200_000)
def english(word: str) -> str:
    if word in EN_EXCEPTIONS:
        return EN_EXCEPTIONS[word]
    if len(word) < 3:
        return word
    w = word.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in EN_VOWELS) else c for i, c in enumerate(w))
    prefix = next((p for p in EN_PREFIXES if w.startswith(p)), "")
    r1 = len(prefix) or region(w, EN_VOWELS)
    r2 = region(w, EN_VOWELS, r1)
    has_vowel = lambda s: any(c in EN_VOWELS for c in s)

    w = w[: len(w) - len(longest(w, ("'", "'s", "'s'")))]
    s = longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and has_vowel(w[:-2]):
        w = w[:-1]
    if w in EN_AFTER_1A:
        return w

    s = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in EN_DOUBLES:
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in EN_VOWELS:
        w = w[:-1] + "i"

    s = longest(w, EN_STEP2)
    if s and len(w) - len(s) >= r1:
        before = w[: -len(s)]
        if not (s == "ogi" and not before.endswith("l")) and not (s == "li" and before[-1:] not in tuple(EN_LI)):
            w = before + EN_STEP2[s]
    s = longest(w, EN_STEP3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + EN_STEP3[s]
    s = longest(w, EN_STEP4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# --- German -----------------------------------------------------------------------------------------------

DE_VOWELS = "aeiouyäöü"
#: Fixed values of the German algorithm: letters before an s and an st that go.
DE_S, DE_ST = "bdfghklmnrt", "bdfghklmnt"


@functools.lru_cache(200_000)
def german(word: str) -> str:
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in DE_VOWELS and w[i + 1] in DE_VOWELS else c for i, c in enumerate(w))
    first = region(w, DE_VOWELS)
    r1, r2 = max(first, 3), region(w, DE_VOWELS, first)

    s = longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1 and (s != "s" or w[-2:-1] in tuple(DE_S)):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = longest(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or (len(w) > 5 and w[-3] in DE_ST)):
        w = w[: -len(s)]
    s = longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2:
        cut = w[: -len(s)]
        if s in ("end", "ung"):
            w = cut[:-2] if cut.endswith("ig") and len(cut) - 2 >= r2 and not cut.endswith("eig") else cut
        elif s in ("ig", "ik", "isch"):
            w = w if cut.endswith("e") else cut
        elif s in ("lich", "heit"):
            w = cut[:-2] if cut.endswith(("er", "en")) and len(cut) - 2 >= r1 else cut
        else:
            more = longest(cut, ("lich", "ig"))
            w = cut[: -len(more)] if more and len(cut) - len(more) >= r2 else cut
    return w.lower().replace("ä", "a").replace("ö", "o").replace("ü", "u")


# --- Swedish, Norwegian, Danish -----------------------------------------------------------------------------

#: Fixed values of the three algorithms.
SV_VOWELS, NO_VOWELS = "aeiouyäåö", "aeiouyæåø"
SV_S, NO_S, DA_S = "bcdfghjklmnoprtvy", "bcdfghjlmnoprtvyz", "abcdfghjklmnoprtvyzå"
SV_STEP1 = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()
SV_STEP2 = "dd gd nn dt gt kt tt".split()
NO_STEP1 = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()
NO_STEP3 = "leg eleg ig eig lig elig els lov elov slov hetslov".split()
DA_STEP1 = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()
DA_STEP2 = "gd dt gt kt".split()


def _r1(word: str, vowels: str) -> int:
    return max(region(word, vowels), 3)


@functools.lru_cache(200_000)
def swedish(w: str) -> str:
    r1 = _r1(w, SV_VOWELS)
    s = longest(w, [*SV_STEP1, "s"], r1)
    if s and (s != "s" or w[-2:-1] in tuple(SV_S)):
        w = w[: -len(s)]
    if longest(w, SV_STEP2, r1):
        w = w[:-1]
    s = longest(w, ("lig", "ig", "els", "löst", "fullt"), r1)
    return w[:-1] if s in ("löst", "fullt") else w[: len(w) - len(s)]


@functools.lru_cache(200_000)
def norwegian(w: str) -> str:
    r1 = _r1(w, NO_VOWELS)
    s = longest(w, [*NO_STEP1, "s", "erte", "ert"], r1)
    if s in ("erte", "ert"):
        w = w[: -len(s)] + "er"
    elif s and (s != "s" or w[-2:-1] in tuple(NO_S) or (w[-2:-1] == "k" and w[-3:-2] not in tuple(NO_VOWELS))):
        w = w[: -len(s)]
    if longest(w, ("dt", "vt"), r1):
        w = w[:-1]
    return w[: len(w) - len(longest(w, NO_STEP3, r1))]


@functools.lru_cache(200_000)
def danish(w: str) -> str:
    r1 = _r1(w, NO_VOWELS)
    s = longest(w, [*DA_STEP1, "s"], r1)
    if s and (s != "s" or w[-2:-1] in tuple(DA_S)):
        w = w[: -len(s)]
    pair = lambda x: x[:-1] if longest(x, DA_STEP2, r1) else x
    w = pair(w)
    w = w[:-2] if w.endswith("igst") else w
    s = longest(w, ("ig", "lig", "elig", "els", "løst"), r1)
    w = w[:-1] if s == "løst" else pair(w[: -len(s)]) if s else w
    return w[:-1] if len(w) > r1 + 0 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in NO_VOWELS and len(w) - 1 >= r1 else w


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "german": german, "swedish": swedish, "norwegian": norwegian, "danish": danish}
