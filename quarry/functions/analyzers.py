"""Ready-made analyzers by name."""

from __future__ import annotations

from collections.abc import Iterable

from . import normalizers, phonetic, stemmers  # noqa: F401 (they register components)
from .analysis import Analyzer, build

#: The default English stop words.
ENGLISH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Frequent function words of other languages; longer lists are a parameter.
STOP: dict[str, list[str]] = {
    "english": ENGLISH_STOP,
    "french": "au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y".split(),
    "german": "aber alle als also am an auch auf aus bei bin bis bist da damit dann der den des dem die das dass du er es ein eine einem einen einer eines für hat ich ihr im in ist ja mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur".split(),
    "spanish": "a al algo ante como con de del desde donde e el ella ellos en entre es esta este la las le les lo los más me mi muy no nos o para pero por que se sin sobre su sus te tu un una y ya".split(),
    "italian": "a ad al alla alle anche che chi ci come con da dal dalla del della delle di e ed è gli i il in io la le lo ma mi ne nei nel nella non o per più se si su sul sulla ti tra tu un una uno".split(),
    "portuguese": "a ao aos as com como da das de do dos e ela ele em entre é isso já mais mas me na nas no nos não o os ou para pela pelo por que se sem seu sua são também te um uma".split(),
    "dutch": "aan al als bij dat de den der des die dit door een en er het hij ik in is je met na naar niet nog of om ook op over te tot uit van voor was wat we zij zijn".split(),
    "swedish": "att av de den det du där en ett från för han har hon i inte jag kan man med men när och om på sig som så till var vi är".split(),
    "norwegian": "alle at av bare da de den det du en er et for fra han har hun i ikke jeg kan man med men når og om på som så til var vi".split(),
    "danish": "af alle at da de den der det du en er et for fra han har hun i ikke jeg kan man med men når og om på som så til var vi".split(),
    "finnish": "ei että hän ja jos joka kun mutta myös minä mitä ne niin nyt on ole oli ovat se sen sinä tai tämä vain".split(),
    "russian": "а без более бы был была были было быть в вам вас весь во вот все всех вы где да для до его ее если есть еще же за и из или им их к как ко когда кто ли мне мы на не него нет ни но о об он она они от по при с со так то только у что это я".split(),
    "hungarian": "a az és egy hogy nem is ez azt de csak meg ki mint már volt van".split(),
    "turkish": "acaba ama bir bu çok da de en gibi hem her için ile ise ki mi ne o şu ve veya ya".split(),
    "arabic": "من في على و فى يا عن مع ان هو علي ما اللا هذا التي كان قد".split(),
    "persian": "و در به از که این را با است برای آن یک".split(),
    "greek": "ο η το οι τα του τησ των τον την και κι κ ειμαι ειναι στο στη που δεν να θα με σε απο για".split(),
    "hindi": "और का की के को में है से यह वह पर ने एक हैं था भी".split(),
    "romanian": "al ale am are au ca că ce cu de din e este fi în la mai nu o pe pentru și s sau să un una".split(),
    "czech": "a aby ale ani by co do i jak jako je jeho již k kde když na nebo o od po pro s se si tak to u v ve z za že".split(),
    "bulgarian": "а ако без беше в вече да до е за и или има как като ли на не но от по при с са се си със така те то че".split(),
    "indonesian": "ada adalah agar akan atau bagi dan dari dengan di ini itu ke oleh pada untuk yang".split(),
    "irish": "a an agus ar as do go i is le na ní nó sa ó".split(),
    "catalan": "a al amb de del dels el els en és i la les no o per que un una".split(),
    "galician": "a ao as con da das de do dos e en o os para por que se un unha".split(),
    "basque": "al da dira eta ez ere hau hori du baina edo".split(),
    "armenian": "այդ այլ այն այս դու դուք եմ են է և թե ի ին իսկ մեջ".split(),
    "latvian": "aiz ap ar bet es gan ir ja kā kas ko no par pie tas un uz".split(),
    "lithuanian": "ar bei bet iki ir iš jau kad kaip ne o per su tai yra už".split(),
    "estonian": "aga ei et ja jah kas kui ma me mis oli on see ta või".split(),
    "polish": "a ale bo być co czy dla do i jak jest już ma na nie o od po się tak to w z za że".split(),
    "slovak": "a aby ale ako by čo do i je k na nie o po pre s sa tak to v z za že".split(),
    "slovenian": "a ali da do in iz je kaj ki ko na ne o od po pri s se so tako to v z za".split(),
    "croatian": "a ali bi da do i iz je kao li na ne o od po s se su što to u za".split(),
    "serbian": "a ali bi da do i iz je kao li na ne o od po s se su šta to u za".split(),
    "ukrainian": "а але без був в від вони для до є з за і їх й його на не ні о по та то у що як".split(),
    "bengali": "এই ও এবং না যে করে এক কি থেকে জন্য".split(),
    "nepali": "र छ को मा पनि यो भएको लागि हो गर्न".split(),
    "tamil": "ஒரு என்று மற்றும் இந்த இது என்ற".split(),
    "telugu": "ఈ ఒక మరియు అని ఆ కి లో".split(),
    "thai": "ที่ และ ใน ของ เป็น มี ได้ ไม่ จะ ให้".split(),
    "sorani": "و لە بۆ بە کە ئەو ئەم".split(),
    "cjk": "a and are as at be but by for if in into is it no not of on or s such t that the their then there these they this to was will with www".split(),
}

#: Chains: tokenizer, filters before and after the stop words.
_STD = "standard"
_CHAINS: dict[str, tuple[str, list, list]] = {
    "arabic": (_STD, ["lowercase", "decimal_digit"], ["arabic_normalization", "arabic_stem"]),
    "armenian": (_STD, ["lowercase"], ["armenian_stem"]),
    "basque": (_STD, ["lowercase"], ["basque_stem"]),
    "bengali": (_STD, ["lowercase", "decimal_digit", "indic_normalization", "bengali_normalization"], ["bengali_stem"]),
    "brazilian": (_STD, ["lowercase"], ["brazilian_stem"]),
    "bulgarian": (_STD, ["lowercase"], ["bulgarian_stem"]),
    "catalan": (_STD, ["lowercase", ("elision", {"articles": ["d", "l", "m", "n", "s", "t"]})], ["catalan_stem"]),
    "chinese": (_STD, ["lowercase"], []),
    "cjk": (_STD, ["cjk_width", "lowercase", "cjk_bigrams"], []),
    "croatian": (_STD, ["lowercase"], []),
    "czech": (_STD, ["lowercase"], ["czech_stem"]),
    "danish": (_STD, ["lowercase"], ["danish_light_stem"]),
    "dutch": (_STD, ["lowercase"], ["dutch_light_stem"]),
    "english": (_STD, ["lowercase"], ["porter_stem"]),
    "estonian": (_STD, ["lowercase"], ["estonian_stem"]),
    "finnish": (_STD, ["lowercase"], ["finnish_light_stem"]),
    "french": (_STD, ["elision", "lowercase"], ["french_light_stem"]),
    "galician": (_STD, ["lowercase"], ["galician_stem"]),
    "german": (_STD, ["lowercase"], ["german_normalization", "german_light_stem"]),
    "greek": (_STD, ["greek_lowercase"], ["greek_light_stem"]),
    "hindi": (_STD, ["lowercase", "decimal_digit", "indic_normalization", "hindi_normalization"], ["hindi_stem"]),
    "hungarian": (_STD, ["lowercase"], ["hungarian_light_stem"]),
    "indonesian": (_STD, ["lowercase"], ["indonesian_stem"]),
    "irish": (_STD, ["irish_lowercase"], ["irish_stem"]),
    "italian": (_STD, [("elision", {"articles": ["c", "l", "all", "dall", "dell", "nell", "sull", "coll", "pell", "gl", "agl", "dagl", "degl", "negl", "sugl", "un", "m", "t", "s", "v", "d"]}), "lowercase"], ["italian_light_stem"]),
    "latvian": (_STD, ["lowercase"], ["latvian_stem"]),
    "lithuanian": (_STD, ["lowercase"], ["lithuanian_stem"]),
    "nepali": (_STD, ["lowercase", "decimal_digit", "indic_normalization"], ["nepali_stem"]),
    "norwegian": (_STD, ["lowercase"], ["norwegian_light_stem"]),
    "persian": (_STD, ["lowercase", "decimal_digit", "arabic_normalization", "persian_normalization"], ["persian_stem"]),
    "polish": (_STD, ["lowercase"], ["stempel_stem"]),
    "portuguese": (_STD, ["lowercase"], ["portuguese_light_stem"]),
    "romanian": (_STD, ["lowercase", "romanian_normalization"], ["romanian_stem"]),
    "russian": (_STD, ["lowercase"], ["russian_light_stem"]),
    "serbian": (_STD, ["lowercase"], ["serbian_normalization"]),
    "slovak": (_STD, ["lowercase"], ["slovak_stem"]),
    "slovenian": (_STD, ["lowercase"], []),
    "sorani": (_STD, ["sorani_normalization", "lowercase", "decimal_digit"], ["sorani_stem"]),
    "spanish": (_STD, ["lowercase"], ["spanish_light_stem"]),
    "swedish": (_STD, ["lowercase"], ["swedish_light_stem"]),
    "tamil": (_STD, ["lowercase", "decimal_digit", "indic_normalization"], ["tamil_stem"]),
    "telugu": (_STD, ["lowercase", "decimal_digit", "indic_normalization", "telugu_normalization"], ["telugu_stem"]),
    "thai": ("thai", ["lowercase", "decimal_digit"], []),
    "turkish": (_STD, ["apostrophe", "turkish_lowercase"], ["turkish_stem"]),
    "ukrainian": (_STD, ["lowercase", "ukrainian_normalization"], ["ukrainian_stem"]),
    "smart_chinese": ("hmm_chinese", ["lowercase", "porter_stem"], []),
    "japanese": ("japanese", ["cjk_width", "lowercase"], ["katakana_stem_normalization"]),
    "japanese_completion": ("japanese", ["lowercase"], [("edge_ngrams", {"low": 1, "high": 20})]),
    "korean": ("korean", ["lowercase"], []),
    "morfologik": (_STD, ["lowercase"], [("morfologik", {"table": {}})]),
    "classic": ("classic", ["classic_filter", "lowercase"], []),
    "uax29_url_email": ("uax29_url_email", ["lowercase"], []),
    "standard": (_STD, ["lowercase"], []),
    "simple": ("letter", ["lowercase"], []),
    "stop": ("letter", ["lowercase"], []),
    "whitespace": ("whitespace", [], []),
    "lowercase_whitespace": ("whitespace", ["lowercase"], []),
    "unicode_whitespace": ("unicode_whitespace", [], []),
    "keyword": ("keyword", [], []),
}
_STOPPED = {"classic": ENGLISH_STOP, "uax29_url_email": ENGLISH_STOP, "stop": ENGLISH_STOP, "brazilian": STOP["portuguese"]}
NAMES = sorted(_CHAINS)


def analyzer(name: str, stop: Iterable[str] | None = None, keywords: Iterable[str] = ()) -> Analyzer:
    """An analyzer by name. stop: its stop words (None: the default list); keywords: terms that aren't stemmed."""
    tok, before, after = _CHAINS[name]
    words = list(stop) if stop is not None else _STOPPED.get(name, STOP.get(name, []))
    filters = [*before, *([("stop", {"words": words})] if words else [])]
    filters += [("keyword_marker", {"words": list(keywords)})] if keywords else []
    return build(tok, [*filters, *after], name=name)


def limit_tokens(inner: Analyzer, n: int) -> Analyzer:
    """An analyzer's first n tokens."""
    from dataclasses import replace

    from .analysis import FILTERS

    return replace(inner, filters=(*inner.filters, FILTERS["limit_count"](n)))


def auto_stop(inner: Analyzer, frequent: Iterable[str]) -> Analyzer:
    """An analyzer for queries without an index's most frequent terms."""
    from dataclasses import replace

    from .analysis import FILTERS

    return replace(inner, filters=(*inner.filters, FILTERS["stop"](list(frequent))))


def collation_key(strength: str = "primary") -> Analyzer:
    """The whole text as a key that sorts without regard to case and accents (primary) or to case (secondary)."""
    fold = ["icu_folding"] if strength == "primary" else [("icu_normalizer", {"form": "NFKC"})]
    return build("keyword", fold, name=f"collation_{strength}")
