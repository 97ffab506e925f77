"""Stemmers: Porter's for English, and rule tables for other languages."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import regex

from . import snowball
from .analysis import FILTERS, TokenFilter, each_term

VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    """The number of vowel-consonant sequences."""
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(regex.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


#: Suffixes of the algorithm's second, third and fourth steps.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@functools.lru_cache(200_000)
def porter(w: str) -> str:
    """The Porter stemmer."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((len(s) for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for s, r in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(s):
                w = w[: -len(s)] + r if _measure(w[: -len(s)]) > 0 else w
                break
    for s in sorted(STEP4, key=len, reverse=True):
        if w.endswith(s):
            stem = w[: -len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or (m == 1 and not _cvc(w[:-1])) else w
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


class SuffixStemmer:
    """A stemmer by groups of suffixes: of each group in turn the longest that fits goes, if so many characters remain; a > b puts b in its place."""

    def __init__(self, groups: tuple[tuple[int, str], ...], fold: Callable[[str], str] | None, prefixes: tuple[int, str] | None):
        parse = lambda words: sorted((tuple(w.partition(">")[::2]) for w in words.split()), key=lambda x: -len(x[0]))
        self.rules = [(least, parse(words)) for least, words in groups]
        self.before = (prefixes[0], parse(prefixes[1])) if prefixes else None
        self.fold = fold
        self.known: dict[str, str] = {}

    def __call__(self, w: str) -> str:
        if (out := self.known.get(w)) is None:
            if len(self.known) > 100_000:
                self.known.clear()
            out = self.known[w] = self._stem(w)
        return out

    def _stem(self, w: str) -> str:
        w = self.fold(w) if self.fold else w
        if self.before:
            w = next((new + w[len(old) :] for old, new in self.before[1] if w.startswith(old) and len(w) - len(old) >= self.before[0]), w)
        for least, suffixes in self.rules:
            for old, new in suffixes:
                if w.endswith(old) and len(w) - len(old) >= least:
                    w = w[: len(w) - len(old)] + new
                    break
        return w


def suffix_stemmer(*groups: tuple[int, str], fold: Callable[[str], str] | None = None, prefixes: tuple[int, str] | None = None) -> SuffixStemmer:
    return SuffixStemmer(groups, fold, prefixes)


def _plain(table: str) -> Callable[[str], str]:
    """Folds the letters of pairs such as 'áa'."""
    t = {ord(p[0]): p[1:] for p in table.split()}
    return lambda w: w.translate(t)


def _unaccent(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def _undouble(w: str) -> str:
    return regex.sub(r"(\p{L})\1", r"\1", w)


#: Light stemmers: plural, case and gender endings.
STEMMERS: dict[str, Callable[[str], str]] = {
    "porter": porter,
    "k": lambda w: porter(w) if not w.endswith(("ss", "us", "is")) else w,
    "english_minimal": suffix_stemmer((1, "ies>y es>e s> ss>ss us>us")),
    "french_light": suffix_stemmer((4, "issements issement atrices atrice ateurs ateur euses>eux euse>eux ives>if ive>if ements ement ité ités eaux>eau aux>al ations ation"), (3, "es s e é ée ées és er x"), fold=_plain("ôo ûu ùu îi êe èe àa âa")),
    "french_minimal": suffix_stemmer((3, "aux>al x s"), (3, "r"), (3, "e"), (3, "é")),
    "german_light": suffix_stemmer((3, "ern em er en es e st>s>st s"), (3, "est er en st"), fold=_plain("äa áa àa âa öo óo òo ôo üu úu ùu ûu ïi íi ìi îi")),
    "german_minimal": suffix_stemmer((4, "nen ern en er e n s"), fold=_plain("äa öo üu")),
    "german": suffix_stemmer((4, "ern em er nd en es e s t"), fold=_plain("äa öo üu ßss")),
    "spanish_light": suffix_stemmer((3, "eses>es ces>z os as es o a e"), fold=_plain("àa áa âa äa òo óo ôo öo èe ée êe ëe ùu úu ûu üu ìi íi îi ïi")),
    "spanish_plural": suffix_stemmer((3, "eses>és ces>z nes>n res>r les>l des>d jes>je es>e os>o as>a is>i us>u")),
    "italian_light": suffix_stemmer((4, "ie he ii a e i o"), (4, "h i"), fold=_plain("àa áa âa äa òo óo ôo öo èe ée êe ëe ùu úu ûu üu ìi íi îi ïi")),
    "portuguese_light": suffix_stemmer((3, "ões>ão ães>ão ais>al éis>el eis>el óis>ol is>il ns>m res>r ses>s zes>z s"), (3, "inha inho"), (3, "a e o"), fold=_unaccent),
    "portuguese_minimal": suffix_stemmer((3, "ões>ão ães>ão ais>al éis>el eis>el óis>ol is>il ns>m res>r s")),
    "portuguese": suffix_stemmer((3, "ões>ão ães>ão ais>al éis>el eis>el óis>ol is>il ns>m res>r s"), (3, "mente"), (3, "ona>ão ora>or na>no inha>inho osa>oso íaca>íaco ica>ico ada>ado ida>ido iva>ivo eira>eiro ã>ão"), (3, "díssimo íssimo zinho inho ão"), (3, "mento amento imento ador edor idor ação ição ncia ante ável ível idade ista ismo"), (3, "aria eria iria ando endo indo aram eram iram ava ado ido ar er ir ou ei eu iu am em"), (3, "a e o"), fold=_unaccent),
    "galician_minimal": suffix_stemmer((3, "ns>n éis>el ais>al óis>ol res>r ces>z s")),
    "galician": suffix_stemmer((3, "ns>n éis>el ais>al óis>ol res>r ces>z s"), (3, "mente"), (3, "iño iña azo aza ón"), (3, "ción mento dade idade ista ismo"), (3, "ando endo indo ar er ir ou eu iu"), (3, "a e o"), fold=_unaccent),
    "brazilian": suffix_stemmer((3, "mente idade ivas ivos ância encia logia ução uções icos icas"), (3, "aram aria ando endo indo eria iria adas ados idas idos ada ado ida ido ar er ir am em ei ou"), (3, "os as is a e i o s"), fold=_unaccent),
    "russian_light": suffix_stemmer((3, "иями оями оиями ями ами иям иях ого ему ому ыми ими иях ах ях ам ям ов ев ей ий ый ой ая яя ое ее ую юю ом ем ию ие ия а я о е и ы у ю й ь"), (3, "нн>н ь и")),
    "swedish_light": suffix_stemmer((3, "elser heten arens erns arna erna orna ande else aste aren are ast het ar er or en at te et ern a e s t n")),
    "swedish_minimal": suffix_stemmer((3, "arna erna orna arens aren are ar er or en et a e s n")),
    "norwegian_light": suffix_stemmer((3, "hetens hetene heten heter elser elsen endes ende elsene ande ene ets ens ers en et er ar ane ene a e s")),
    "norwegian_minimal": suffix_stemmer((3, "enes ene ers ets ane en et er ar a e s")),
    "danish_light": suffix_stemmer((3, "erendes erende hedens erede ernes erets ethed eren erer heder erne heds hed ende enes eres eret ered ens ene ers ets en er es et e s"), fold=None),
    "dutch_light": suffix_stemmer((3, "heden>heid lijk baar ingen ing en es s e"), fold=_undouble),
    "dutch": suffix_stemmer((3, "heden>heid ene en se s"), (3, "e"), (3, "heid"), (3, "end ing ig lijk baar bar"), fold=lambda w: _undouble(_plain("äa ëe ïi öo üu")(w))),
    "finnish_light": suffix_stemmer((3, "kin kaan kään ko kö han hän pa pä"), (3, "lla llä lta ltä lle ssa ssä sta stä ksi tta ttä na nä ta tä n t"), (2, "ni si nsa nsä mme nne"), (2, "i j a ä e"), fold=_plain("äa åa öo")),
    "hungarian_light": suffix_stemmer((3, "okkal ekkel ökkel kkal kkel oknak eknek nak nek ban ben ból ből ról ről tól től hoz hez höz val vel nál nél ért ként kor ba be ra re on en ön ot et öt at ig ul ül ok ek ök ak t k"), (3, "aim eim aid eid ai ei jai jei unk ünk uk ük ja je em om am öm od ed ad öd a e i"), fold=_plain("áa ëe ée íi óo őo öo õo ôo úu ûu űu üu")),
    "bulgarian": suffix_stemmer((3, "ият ът то те та ия ят ове еве ища я а о е и у"), (3, "я а о е")),
    "czech": suffix_stemmer((3, "atech ětem etem atům ách ích ého ěmi emi ému ete eti iho ího ími imu ým ech ovi ové ými em es ém ím ům at ám os us ata aty e i í ě u y ů a o á é ý"), (3, "ov in ův")),
    "polish": suffix_stemmer((3, "owego owemu ością iami ach ami ego emu ych ymi imi ich owi ów om em ie ej ą ę y i a e o u")),
    "slovak": suffix_stemmer((3, "ovia ami och iach ého ému ých ými ov om mi ám ách a e i o u y á é í ý ú")),
    "greek": suffix_stemmer((3, "ουσ οντασ ομαστε ιεσ εισ εων ων ου οσ ησ ασ ησ οι α η ο ω ε ι υ ν σ"), fold=_unaccent),
    "greek_light": suffix_stemmer((3, "εισ οσ ησ ασ ου ων οι εσ α η ο ι")),
    "arabic": suffix_stemmer((2, "ها ان ات ون ين يه ية ه ة ي"), prefixes=(2, "وال بال كال فال لل ال و")),
    "persian": suffix_stemmer((2, "هایی های ات ان ترین تر ها ام ای ی م ت ش")),
    "sorani": suffix_stemmer((3, "ەکانمان ەکانتان ەکانیان ەکان ەوە دا نا وە مان تان یان یەک ێک ەکە کە ان ە ی ێ")),
    "hindi": suffix_stemmer((1, "ाएंगी ाएंगे ाऊंगी ाऊंगा ाइयाँ ाइयों ाइयां ाएगी ाएगा ाओगी ाओगे एंगी ेंगी एंगे ेंगे ूंगी ूंगा ातीं नाओं नाएं ताओं ताएं ियाँ ियों ियां कर ाओ िए ाई ाए ने नी ना ते ीं ती ता ाँ ां ों ें ो े ू ु ी ि ा")),
    "bengali": suffix_stemmer((2, "গুলোর গুলির গুলো গুলি দেরকে েরা দের টির টার টি টা কে রা ের ে র ই ও া ি ী ু")),
    "telugu": suffix_stemmer((2, "లను లకు లలో లతో లు ను కు లో తో ని పై గా")),
    "tamil": suffix_stemmer((2, "களுக்கு களில் களின் களை கள் க்கு ில் ின் ை")),
    "nepali": suffix_stemmer((2, "हरूले हरूको हरूलाई हरू ले को का की लाई मा बाट")),
    "indonesian": suffix_stemmer((2, "lah kah tah pun"), (2, "ku mu nya"), (2, "kan an i"), prefixes=(3, "meng>k meny mem men me peng peny pem pen pe di ter ke ber per se")),
    "latvian": suffix_stemmer((3, "ajiem ajai ajam ajām ajos ajās iem ajā ais ai ei ām am ēm īm im um us as es os ij īs ēs is ie ā ē ī ū a e i u o s š")),
    "lithuanian": suffix_stemmer((3, "uose iuose yje ėje oje iai ams ems ais omis ius ius as is ys us os es ai ei ų į ą ę a e i o u ė")),
    "estonian": suffix_stemmer((3, "dest dele tele dega sse des le st ga ks id de te d t a e i u")),
    "romanian": suffix_stemmer((3, "ilor ului elor iile ilor iei ile ele ul le lui ei ii ea ua a e i ă u")),
    "catalan": suffix_stemmer((3, "acions acio ments ment itats itat es os as s"), (3, "a e i o"), fold=_unaccent),
    "basque": suffix_stemmer((3, "etako arekin aren ari etan ean tik ren rik ak ek en an a k")),
    "irish": suffix_stemmer((3, "achta anna eanna aigh acht anna aí ta te a e")),
    "armenian": suffix_stemmer((3, "ներից ներով ներում ները ների ներն ներ երից երով ում ից ով երի եր ը ն ի")),
    "turkish": suffix_stemmer((3, "larından lerinden larının lerinin larda lerde lardan lerden ların lerin ları leri lar ler dan den tan ten nın nin da de ta te ın in un ün ı i u ü a e")),
    "serbian": suffix_stemmer((3, "ovima evima ama ima om em og oj ih im a e i o u")),
    "ukrainian": suffix_stemmer((3, "ового овому ами ями ах ях ів ий ого ому ими ою ею ої ій ам ям а я о е и і у ю ї ь")),
    "stempel": suffix_stemmer((3, "owego ach ami ego emu ych ymi ów om em ą ę y i a e o u")),
}


def hunspell(words: dict[str, str], suffixes: list[tuple[str, str, str, str]], prefixes: list[tuple[str, str, str, str]] = ()) -> Callable[[str], list[str]]:
    """Stems by affix rules (flag, strip, add, condition) over a dictionary of words and their flags."""
    sfx = [(f, strip, add, regex.compile(f"{cond}$" if cond not in ("", ".") else "")) for f, strip, add, cond in suffixes]
    pfx = [(f, strip, add, regex.compile(f"^{cond}" if cond not in ("", ".") else "")) for f, strip, add, cond in prefixes]

    def stems(w: str) -> list[str]:
        out = [w] if w in words else []
        for f, strip, add, cond in sfx:
            if add and w.endswith(add):
                base = w[: len(w) - len(add)] + strip
                if base in words and f in words[base] and cond.search(base) and base not in out:
                    out.append(base)
        for f, strip, add, cond in pfx:
            if add and w.startswith(add):
                base = strip + w[len(add) :]
                if base in words and f in words[base] and cond.search(base) and base not in out:
                    out.append(base)
        return out

    return stems


def stem_filter(name: str) -> TokenFilter:
    return each_term(STEMMERS[name], stemming=True)


def hunspell_filter(words, suffixes, prefixes=()) -> TokenFilter:
    from dataclasses import replace

    fn = hunspell(words, suffixes, prefixes)

    def run(tokens):
        for t in tokens:
            found = [] if t.keyword else fn(t.term)
            for i, s in enumerate(found or [t.term]):
                yield replace(t, term=s, inc=t.inc if i == 0 else 0)

    return run


def dictionary_filter(table: dict[str, str | list[str]]) -> TokenFilter:
    """Lemmas from a table; several stand at one place."""
    from dataclasses import replace

    def run(tokens):
        for t in tokens:
            found = table.get(t.term) or table.get(t.term.lower()) or t.term
            for i, s in enumerate([found] if isinstance(found, str) else found):
                yield replace(t, term=s, inc=t.inc if i == 0 else 0)

    return run


for _name in STEMMERS:
    FILTERS[f"{_name}_stem"] = functools.partial(stem_filter, _name)
for _name, _fn in snowball.STEMMERS.items():
    STEMMERS[f"snowball_{_name}"] = _fn


def snowball_filter(language: str = "english") -> TokenFilter:
    """The Snowball stemmer of a language; `porter` is the older one of English. Others have the language's suffix table."""
    return stem_filter(next(n for n in (f"snowball_{language}", language, f"{language}_light") if n in STEMMERS))


FILTERS["snowball"] = snowball_filter
FILTERS["hunspell"] = hunspell_filter
FILTERS["morfologik"] = FILTERS["dictionary_lemmas"] = FILTERS["opennlp_lemmatizer"] = dictionary_filter
