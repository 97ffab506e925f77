"""Analysis, parsers, spans, intervals and other operators that plain values can pin."""

from __future__ import annotations

import random

import pytest

from quarry.functions import analysis as A
from quarry.functions import normalizers, phonetic, strings
from quarry.functions.analyzers import NAMES, analyzer
from quarry.functions.stemmers import porter
from quarry.operators import highlight, intervals, knn, monitor, parsers, spans
from quarry.operators import query as Q


def terms(text, tokenizer, *filters):
    return A.build(tokenizer, filters).terms(text)


def test_tokenizers():
    assert terms("The quick-brown fox's 3.14 U.S.A.", "standard") == ["The", "quick", "brown", "fox's", "3.14", "U.S.A"]
    assert terms("日本 カタカナ한국", "standard") == ["日", "本", "カタカナ", "한국"]
    assert terms("a" * 300, "standard") == ["a" * 255, "a" * 45]
    assert terms(" a  b\tc ", "whitespace") == ["a", "b", "c"]
    assert terms("ab1c", "letter") == ["ab", "c"]
    assert terms("", "keyword") == [] and terms("a b", "keyword") == ["a b"]
    assert terms("abc", ("ngram", {"low": 1, "high": 2})) == ["a", "ab", "b", "bc", "c"]
    assert terms("abc", ("edge_ngram", {"low": 1, "high": 5})) == ["a", "ab", "abc"]
    assert terms("/a/b/c", "path_hierarchy") == ["/a", "/a/b", "/a/b/c"]
    assert terms("a.b.c", ("reverse_path_hierarchy", {"separator": "."})) == ["a.b.c", "b.c", "c"]
    assert terms("a1b22c", ("pattern", {"pattern": r"\d+"})) == ["a", "b", "c"]
    assert terms("mail me@x.org http://a.b/c?d", "uax29_url_email") == ["mail", "me@x.org", "http://a.b/c?d"]
    assert terms("AT&T's I.B.M. O'Neil", "classic", "classic_filter") == ["AT&T", "s", "IBM", "O'Neil"]
    assert terms("こんにちはabc", "cjk") == ["こん", "んに", "にち", "ちは", "abc"]
    assert A.dictionary_segmenter({"东京": 1.0, "大学": 1.0}, r"\p{Han}")("东京大学x") and [t.term for t in A.dictionary_segmenter({"东京": 1.0, "大学": 1.0}, r"\p{Han}")("东京大学x")] == ["东京", "大学", "x"]


def test_filters_keep_positions():
    a = A.build("whitespace", ["lowercase", ("stop", {"words": ["the"]})])
    assert [(p, t.term) for p, t in a.positions("The cat the DOG")] == [(1, "cat"), (3, "dog")]
    assert terms("a b c", "whitespace", ("shingles", {})) == ["a", "a b", "b", "b c", "c"]
    assert terms("a b c", "whitespace", ("fixed_shingles", {"n": 2})) == ["a b", "b c"]
    assert terms("Wi-Fi500 PowerShot", "whitespace", ("word_delimiter", {})) == ["Wi", "Fi", "500", "Power", "Shot"]
    assert terms("l'avion", "standard", "elision") == ["avion"]
    assert terms("Éa ß", "whitespace", "ascii_folding") == ["Ea", "ss"]
    assert terms("the quick", "whitespace", ("common_grams", {"words": ["the"]})) == ["the", "the_quick", "quick"]
    assert terms("ny big", "whitespace", ("synonyms", {"table": {"ny": ["new york"]}, "keep": False})) == ["new", "york", "big"]
    assert terms("a a b", "whitespace", ("limit_count", {"n": 2})) == ["a", "a"]
    assert terms("Donaudampf", "whitespace", ("dictionary_compounds", {"words": ["dampf", "donau"]})) == ["Donaudampf", "Donau", "dampf"]
    assert terms("x|5 y", "whitespace", "delimited_payload") == ["x", "y"]
    assert terms("多くの学生", "standard", "cjk_bigrams") == ["多く", "くの", "の学", "学生"]
    assert len(A.build("whitespace", [("min_hash", {"buckets": 8})]).analyze("a b c")) == 8


def test_stemmers_and_codes():
    pairs = "caresses caress ponies poni ties ti cats cat agreed agre motoring motor hopping hop falling fall relational relat conditional condit digitizer digit operator oper generalizations gener oscillators oscil controll control"
    words = pairs.split()
    assert [porter(w) for w in words[::2]] == words[1::2]
    assert phonetic.soundex("Robert") == phonetic.soundex("Rupert") == "R163"
    assert phonetic.soundex("Ashcraft") == "A261"
    assert phonetic.daitch_mokotoff("Peters") == "739400"
    assert phonetic.cologne("Müller-Lüdenscheidt") == "65752682"
    assert phonetic.metaphone("Thompson") == "0MSN"[:4] or phonetic.metaphone("Thompson").startswith("0")
    assert normalizers.german("strasse weiß") == "strasse weiss"
    assert normalizers.numeral("三千二百") == "3200" and normalizers.numeral("一億二千") == "100002000"
    assert normalizers.serbian("Њујорк") == "njujork"
    for n in NAMES:
        assert analyzer(n).terms("") == [] or n == "keyword"


def test_distances():
    assert strings.osa("teh", "the") == 1 and strings.osa("ca", "abc") == 3
    assert strings.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert strings.ngram_similarity("abc", "abc") == 1 and strings.ngram_similarity("abc", "xyz") == 0


def test_parsers():
    p = parsers.parse
    assert p("a") == Q.Term("text", "a")
    assert p("+a -b").clauses == (("must", Q.Term("text", "a")), ("must_not", Q.Term("text", "b")))
    assert p("a AND b").clauses == (("must", Q.Term("text", "a")), ("must", Q.Term("text", "b")))
    assert p('"a b"~2') == spans.Phrase("text", ("a", "b"), None, 2)
    assert p("[a TO b}") == Q.TermRange("text", low="a", high="b", include_high=False)
    assert isinstance(p("(a OR b) AND c^2").clauses[1][1], Q.Boost)
    assert parsers.escape("a+b") == "a\\+b" and parsers.unescape("a\\+b") == "a+b"
    for bad in ("(a", "a)", "AND", "*a"):
        with pytest.raises(parsers.ParseError):
            p(bad)
    for junk in ('"', "((", "-", "a +", ")", "~3", "a | "):
        assert isinstance(parsers.simple(junk, ["text"]), Q.Query)
    assert isinstance(parsers.surround("2W(a, b)", "text"), spans.SpanNear)


def test_rewrites():
    t = Q.Term("f", "x")
    assert isinstance(Q.Boolean().rewrite(), Q.MatchNone)
    assert Q.Boolean.of(must=[t]).rewrite() == t
    assert Q.Boolean.of(filter=[t]).rewrite() == Q.Boost(Q.ConstantScore(t), 0.0)
    assert spans.Phrase("f", ("x",)).rewrite() == t


def brute_sloppy(lists, slop):
    import itertools

    best = [max(p - i for i, p in enumerate(c)) - min(p - i for i, p in enumerate(c)) for c in itertools.product(*lists) if len(set(c)) == len(c)]
    return any(b <= slop for b in best)


def test_sloppy_against_brute_force():
    r = random.Random(3)
    for _ in range(300):
        doc = [r.choice("abcx") for _ in range(r.randint(2, 12))]
        phrase = r.sample("abc", r.randint(2, 3))
        lists = [[i for i, t in enumerate(doc) if t == w] for w in phrase]
        if all(lists):
            slop = r.randint(0, 4)
            assert bool(spans.sloppy_matches(lists, list(range(len(phrase))), phrase, slop)) == brute_sloppy(lists, slop)


def test_intervals_are_minimal():
    p = {"a": [0, 3, 7], "b": [2, 5], "c": [4]}
    t = intervals.Term
    assert [i[:2] for i in intervals.Ordered((t("a"), t("b"))).at(p)] == [(0, 2), (3, 5)]
    assert [i[:2] for i in intervals.Unordered((t("a"), t("b"))).at(p)] == [(0, 2), (2, 3), (3, 5), (5, 7)]
    assert [i[:2] for i in intervals.Phrase((t("c"), t("b"))).at(p)] == [(4, 5)]
    assert [i[:2] for i in intervals.max_gaps(intervals.Ordered((t("a"), t("c"))), 0).at(p)] == [(3, 4)]
    assert intervals.AtLeast(2, (t("a"), t("b"), t("c"))).at(p)
    assert intervals.not_containing(intervals.Ordered((t("a"), t("b"))), t("c")).at(p) == [(0, 2, 2)]


def test_highlight():
    h = highlight.Highlighter(("fox",))
    assert h.run("The fox ran. Nothing here. A fox slept.") == "The <b>fox</b> ran. ... A <b>fox</b> slept."
    assert h.run("No match. At all.") == "No match."
    assert h.run(None) is None and h.run("") == ""


def test_monitor_anchors():
    assert monitor.anchors(parsers.parse("+a +bcd")) == {"bcd"}
    assert monitor.anchors(parsers.parse("a OR bcd")) == {"a", "bcd"}
    assert monitor.anchors(Q.MatchAll()) == {monitor.ANY}
    m = monitor.Memory.of("a b a", str.split)
    assert m.score(parsers.parse("a")) == 2 and m.score(parsers.parse("+a -b")) is None


def test_analyzed_fields_search(spark):
    from quarry.operators.index import Index

    docs = spark.createDataFrame([(1, "Running foxes"), (2, "the fox runs"), (3, None)], "doc_id long, text string")
    i = Index(docs, {"text": analyzer("english")})
    assert {r["doc_id"] for r in Q.Term("text", "fox").hits(i).collect()} == {1, 2}
    assert {r["doc_id"] for r in spans.Phrase("text", ("fox", "run")).hits(i).collect()} == {2}


def test_approximate_knn_misses_nothing(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(600)] + [(1000, None), (1001, [0.0] * 16)]
    docs = spark.createDataFrame(rows, "doc_id long, v array<double>").repartition(3).cache()
    for q in (7, 100, 333):
        for planes, probes, k in ((6, 3, 10), (8, 0, 10), (4, 0, 100)):
            exact = [x["doc_id"] for x in knn.knn(docs, "v", rows[q][1], k, "cosine").collect()]
            got = [x["doc_id"] for x in knn.approximate(docs, "v", rows[q][1], k, planes, probes).collect()]
            assert got == exact
    assert knn.approximate(docs, "v", rows[7][1], 700, 6, 3).count() == knn.knn(docs, "v", rows[7][1], 700, "cosine").count()
