"""Expressions, value sources, dates, parsers, highlighting, suggestions, spelling, classification, reverse search and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import analysis, analyzers, dates, strings
from ..functions import text as T
from ..functions import values as V
from ..functions.expressions import compile_expression
from ..operators import classify as K
from ..operators import highlight as H
from ..operators import intervals as I
from ..operators import monitor as M
from ..operators import parsers as P
from ..operators import query as Q
from ..operators import suggest as S
from ..sources import store
from ..streaming import search as streaming
from .base import BM25, TOK, Registry, documents, rounded, table

R = Registry()


def _parts(s, d):
    return table(s, d, "part").withColumnRenamed("p_partkey", "doc_id")


# --- expressions and value sources -------------------------------------------------------------------

_EXPR = {
    "arithmetic": ("p_size * 2 + p_retailprice / 100 - 7 % 4", "p_size * 2 + p_retailprice / 100 - 3"),
    "conditional": ("p_size > 20 && p_retailprice < 1200 ? sqrt(p_size) : -p_size", "case when p_size > 20 and p_retailprice < 1200 then sqrt(p_size) else -p_size end"),
    "bits": ("(p_size & 12) | 3 ^ 1", "((p_size & 12) | xor(3, 1))::double"),
    "shift": ("p_size << 2", "(p_size << 2)::double"),
    "functions": ("max(ln(p_size), 2) + pow(p_size, 0.5) * abs(min(-1, p_size)) + floor(p_retailprice / 7)", "greatest(ln(p_size), 2) + pow(p_size, 0.5) * abs(least(-1, p_size)) + floor(p_retailprice / 7)"),
    "trigonometry": ("sin(p_size) + cos(p_size) * tan(0.5) + atan2(p_size, 3) + tanh(0.1)", "sin(p_size) + cos(p_size) * tan(0.5) + atan2(p_size, 3) + tanh(0.1)"),
    "logic": ("!(p_size == 5) + (p_size != 3 || p_size < 2)", "(case when p_size = 5 then 0 else 1 end) + (case when p_size <> 3 or p_size < 2 then 1 else 0 end)::double"),
    "literals": ("p_size + 0x10 + 010 + 1.5e1", "p_size + 16 + 8 + 15.0"),
    "haversin": ("haversin(40, 10, p_size, 20)", "2 * 6371008.7714 * asin(sqrt(least(1, pow(sin((radians(p_size) - radians(40)) / 2), 2) + cos(radians(40)) * cos(radians(p_size)) * pow(sin(radians(20 - 10) / 2), 2))))"),
}
for _n, (_e, _s) in _EXPR.items():
    R.add(f"expression_{_n}", f"select p_partkey as doc_id, round(({_s})::double, 5) as value from part")(lambda s, d, e=_e: _parts(s, d).select("doc_id", F.round(compile_expression(e), 5).alias("value")))
R.add("expression_custom_function", "select p_partkey as doc_id, (p_size * 3 + 1)::double as value from part")(lambda s, d: _parts(s, d).select("doc_id", compile_expression("triple(size) + one", {"size": F.col("p_size"), "one": 1}, {"triple": (1, lambda x: x * 3)}).alias("value")))


def _value(name, build, sql):
    R.add(f"value_{name}", f"select p_partkey as doc_id, round(({sql})::double, 6) as value from part")(lambda s, d: _parts(s, d).select("doc_id", F.round(build().cast("double"), 6).alias("value")))


_size, _price = (lambda: F.col("p_size")), (lambda: F.col("p_retailprice"))
_value("constant", lambda: V.constant(2.5), "2.5")
_value("field", lambda: V.field("p_size"), "p_size")
_value("sum", lambda: V.total(_size(), _price(), F.lit(1)), "p_size + p_retailprice + 1")
_value("product", lambda: V.product(_size(), _price()), "p_size * p_retailprice")
_value("max", lambda: V.largest(_size(), F.lit(25)), "greatest(p_size, 25)")
_value("min", lambda: V.smallest(_size(), F.lit(25)), "least(p_size, 25)")
_value("div", lambda: V.quotient(_price(), _size()), "p_retailprice / p_size")
_value("pow", lambda: V.power(_size(), F.lit(1.5)), "pow(p_size, 1.5)")
_value("linear", lambda: V.linear(_size(), 2.0, 3.0), "2 * p_size + 3")
_value("reciprocal", lambda: V.reciprocal(_size(), 2.0, 100.0, 1.0), "100 / (2 * p_size + 1)")
_value("range_map", lambda: V.range_map(_size().cast("double"), 10, 20, 1, 0), "case when p_size between 10 and 20 then 1 else 0 end")
_value("if", lambda: V.if_(V.compare(_size(), ">", F.lit(30)), _price(), F.lit(0.0)), "case when p_size > 30 then p_retailprice else 0 end")
_value("boolean", lambda: V.if_(V.all_of(_size() > 10, V.none_of(_size() == 12, _size() == 14)), F.lit(1), F.lit(0)), "case when p_size > 10 and p_size not in (12, 14) then 1 else 0 end")
_value("enum", lambda: V.enum_field("p_brand", {"Brand#11": 1, "Brand#22": 2}), "case p_brand when 'Brand#11' then 1 when 'Brand#22' then 2 end")
R.add("value_scale", "select p_partkey as doc_id, round((p_size - lo) * 9.0 / (hi - lo) + 1, 6) as value from part, (select min(p_size) as lo, max(p_size) as hi from part)")(lambda s, d: V.scale(_parts(s, d), "p_size", 1.0, 10.0, "value").select("doc_id", F.round("value", 6).alias("value")))
R.add("value_multi_field", "select l_orderkey as doc_id, max(l_quantity) as value from lineitem group by 1")(lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list("l_quantity").alias("q")).select("doc_id", V.multi_field("q", "max").alias("value")))
R.add("payload_function", "select l_orderkey as doc_id, round(avg(l_quantity), 6) as value from lineitem group by 1")(lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list("l_quantity").alias("q")).select("doc_id", F.round(V.payload_value(F.col("q")), 6).alias("value")))

# --- dates, strings -------------------------------------------------------------------------------------

R.add("date_resolution", "select event_id, strftime(ts, '%Y%m%d') as day, strftime(ts, '%Y%m%d%H%M') as minute from events")(lambda s, d: table(s, d, "events").select("event_id", dates.to_string(F.col("ts"), "day").alias("day"), dates.to_string(F.col("ts"), "minute").alias("minute")))
R.add("date_range", "select event_id from events where ts >= (select min(ts) from events) + interval 1 hour and ts < (select min(ts) from events) + interval 5 hour")(lambda s, d: _date_range(s, d))
R.add("date_cells", "select strftime(ts, '%Y%m%d%H') as cell, count(*)::bigint as n from events group by 1")(lambda s, d: table(s, d, "events").select(F.get(dates.cells(F.col("ts")), 3).alias("cell")).groupBy("cell").agg(F.count("*").alias("n")))
R.add("inet_range", "select p_partkey as doc_id from part where p_partkey % 256 between 16 and 31")(lambda s, d: _parts(s, d).where(dates.in_network(F.concat(F.lit("10.1.2."), (F.col("doc_id") % 256).cast("string")), "10.1.2.16/28")).select("doc_id"))


def _date_range(s, d):
    e = table(s, d, "events")
    lo = e.agg(F.min("ts").alias("lo"))
    return e.crossJoin(F.broadcast(lo)).where("ts >= lo + interval 1 hour and ts < lo + interval 5 hour").select("event_id")


_W = f"with {TOK} select term, "
R.add("distance_levenshtein", _W + "round(1 - levenshtein(term, 'stupid')::double / greatest(length(term), 6), 6) as score from df where df >= 10")(lambda s, d: documents(s, d).terms("text").where("df >= 10").select("term", F.round(strings.levenshtein_similarity(F.col("term"), "stupid"), 6).alias("score")))
R.add("distance_osa", _W + "round(1 - damerau_levenshtein(term, 'teh')::double / greatest(length(term), 3), 6) as score from df where length(term) <= 3 and df >= 10")(lambda s, d: documents(s, d).terms("text").where("df >= 10 and length(term) <= 3").select("term", F.round(strings.osa_similarity(F.col("term"), "teh"), 6).alias("score")))
R.add("distance_jaro_winkler", _W + "round(jaro_winkler_similarity(term, 'worth'), 4) as score from df where df >= 10 and length(term) <= 10")(lambda s, d: documents(s, d).terms("text").where("df >= 10 and length(term) <= 10").select("term", F.round(strings.jaro_winkler_similarity(F.col("term"), "worth"), 4).alias("score")))
R.add("distance_ngram")(lambda s, d: documents(s, d).terms("text").where("df >= 20").select("term", F.round(strings.ngram_distance(F.col("term"), "stupid"), 6).alias("score")))

# --- column analysis ------------------------------------------------------------------------------------

R.add("tokenize_whitespace", "select doc_id, len([x for x in regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') if x <> ''])::int as n from documents")(lambda s, d: table(s, d, "documents").select("doc_id", F.size(T.whitespace(F.col("text"))).alias("n")))
R.add("tokenize_keyword", "select c_mktsegment as term, count(*)::bigint as df from customer group by 1")(lambda s, d: table(s, d, "customer").select(F.explode(T.keyword(F.col("c_mktsegment"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
R.add("tokenize_path", "select path, count(*)::bigint as n from (select unnest([array_to_string(p[1:i], '/') for i in range(1, len(p) + 1)]) as path from (select string_split(regexp_replace(url, '^[a-z]+://', ''), '/') as p from pages)) group by 1")(lambda s, d: table(s, d, "pages").select(F.explode(T.path_prefixes(F.regexp_replace("url", "^[a-z]+://", ""))).alias("path")).groupBy("path").agg(F.count("*").alias("n")))
R.add("shingles", f"with {TOK} select t1 || ' ' || t2 as shingle, count(*)::bigint as n from (select doc_id, term as t1, lead(term) over (partition by doc_id order by pos) as t2 from tok) where t2 is not null group by 1")(lambda s, d: table(s, d, "documents").select(F.explode(T.shingles(T.ascii_words(F.col("text")), 2)).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")))
R.add("ngrams", "select g as gram, count(*)::bigint as n from (select unnest([substring(p_type, i, 3) for i in range(1, greatest(length(p_type) - 1, 1))]) as g from part) group by 1")(lambda s, d: table(s, d, "part").select(F.explode(T.ngrams(F.col("p_type"), 3, 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))
R.add("edge_ngrams", "select g as gram, count(*)::bigint as n from (select unnest([substring(p_type, 1, i) for i in range(2, least(length(p_type), 5) + 1)]) as g from part) group by 1")(lambda s, d: table(s, d, "part").select(F.explode(T.edge_ngrams(F.col("p_type"), 2, 5)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")))
R.add("analyze_standard")(lambda s, d: _analyzed(s, d, "standard"))
R.add("analyze_english")(lambda s, d: _analyzed(s, d, "english"))
R.add("analyze_german")(lambda s, d: _analyzed(s, d, "german"))
R.add("analyze_all")(lambda s, d: _every_analyzer(s, d))


def _every_analyzer(s, d):
    """(analyzer, term, n): the terms of part names and of the documents' languages under every chain, each different text analysed once."""
    names = table(s, d, "part").select(F.col("p_name").alias("x")).union(table(s, d, "documents").select(F.concat_ws(" ", "lang", "source")))
    return analysis.term_counts(names.groupBy("x").agg(F.count("*").alias("times")), "x", {n: analyzers.analyzer(n) for n in analyzers.NAMES}, "times")


def _analyzed(s, d, name):
    return analysis.term_counts(table(s, d, "documents"), "text", {name: analyzers.analyzer(name)}).select("term", "n")


# --- parsers --------------------------------------------------------------------------------------------

R.add("parse_classic", f"with {TOK} select doc_id, round(sum(case when term = 'clown' then 2 else 1 end * {BM25}), 6) as score from s where term in ('idiot', 'clown') and doc_id not in (select doc_id from tf where term = 'moron') group by doc_id having count(*) filter (term = 'idiot') > 0")(lambda s, d: rounded(P.parse("+idiot clown^2 -moron").hits(documents(s, d))))
R.add("parse_classic_groups", f"with {TOK} select doc_id, round(sum({BM25}), 6) as score from s where term in ('idiot', 'clown', 'the') group by doc_id having count(*) filter (term <> 'the') > 0 and count(*) filter (term = 'the') > 0")(lambda s, d: rounded(P.parse("(idiot OR clown) AND text:the").hits(documents(s, d))))
R.add("parse_simple", f"with {TOK} select doc_id, round(sum({BM25}), 6) as score from s where term in ('idiot', 'clown') group by doc_id having count(*) = 2")(lambda s, d: rounded(P.simple("idiot + clown", ["text"]).hits(documents(s, d))))
R.add("parse_surround", f"with {TOK} select distinct a.doc_id from tok a join tok b using (doc_id) where a.term = 'of' and b.term = 'the' and b.pos > a.pos and b.pos - a.pos <= 2")(lambda s, d: P.surround("2W(of, the)", "text").hits(documents(s, d)).select("doc_id"))
R.add("parse_complex_phrase", f"with {TOK} select distinct a.doc_id from tok a join tok b using (doc_id) where a.term = 'of' and starts_with(b.term, 'th') and b.pos = a.pos + 1")(lambda s, d: P.complex_phrase('"of th*"', "text").hits(documents(s, d)).select("doc_id"))
R.add("parse_xml", f"with {TOK} select doc_id, round(sum({BM25}), 6) as score from s where term in ('idiot', 'clown') group by doc_id having count(*) filter (term = 'idiot') > 0")(lambda s, d: rounded(P.xml('<BooleanQuery><Clause occurs="must"><TermQuery fieldName="text">idiot</TermQuery></Clause><Clause occurs="should"><TermQuery fieldName="text">clown</TermQuery></Clause></BooleanQuery>').hits(documents(s, d))))
R.add("parse_multi_field", f"with {TOK} select doc_id, round(2 * {BM25}, 6) as score from s where term = 'clown'")(lambda s, d: rounded(P.multi_field("clown", {"text": 2.0}).hits(documents(s, d))))

# --- intervals ------------------------------------------------------------------------------------------

_t = I.Term
_iv = {
    "ordered": (I.max_width(I.Ordered((_t("of"), _t("the"))), 3), "select distinct a.doc_id from tok a join tok b using (doc_id) where a.term = 'of' and b.term = 'the' and b.pos > a.pos and b.pos - a.pos + 1 <= 3"),
    "phrase": (I.Phrase((_t("of"), _t("the"))), "select distinct a.doc_id from tok a join tok b using (doc_id) where a.term = 'of' and b.term = 'the' and b.pos = a.pos + 1"),
    "unordered": (I.max_width(I.Unordered((_t("idiot"), _t("the"))), 4), "select distinct a.doc_id from tok a join tok b using (doc_id) where a.term = 'idiot' and b.term = 'the' and abs(b.pos - a.pos) + 1 <= 4"),
    "or": (I.Or((_t("idiot"), _t("clown"))), "select distinct doc_id from tok where term in ('idiot', 'clown')"),
    "at_least": (I.AtLeast(2, (_t("idiot"), _t("clown"), _t("moron"))), "select doc_id from tf where term in ('idiot', 'clown', 'moron') group by 1 having count(*) >= 2"),
    "containing": (I.containing(I.max_width(I.Ordered((_t("idiot"), _t("the"))), 8), _t("of")), "select distinct a.doc_id from tok a join tok b on a.doc_id = b.doc_id and a.term = 'idiot' and b.term = 'the' and b.pos > a.pos and b.pos - a.pos + 1 <= 8 join tok c on c.doc_id = a.doc_id and c.term = 'of' and c.pos between a.pos and b.pos where not exists (select 1 from tok x where x.doc_id = a.doc_id and x.term in ('idiot', 'the') and x.pos > a.pos and x.pos < b.pos)"),
    "before": (I.before(_t("idiot"), _t("clown")), "select distinct a.doc_id from tok a join tok b using (doc_id) where a.term = 'idiot' and b.term = 'clown' and b.pos > a.pos"),
    "within": (I.within(_t("idiot"), 2, _t("the")), "select distinct a.doc_id from tok a join tok b using (doc_id) where a.term = 'idiot' and b.term = 'the' and abs(b.pos - a.pos) <= 2"),
    "prefix": (I.prefix("text", "idio"), "select distinct doc_id from tok where starts_with(term, 'idio')"),
}
for _n, (_src, _s) in _iv.items():
    R.add(f"intervals_{_n}", f"with {TOK} {_s}")(lambda s, d, x=_src: I.Intervals("text", x).hits(documents(s, d)).select("doc_id"))
R.add("intervals_score", f"with {TOK} select doc_id, round(tf / (tf + 1), 6) as score from tf where term = 'idiot'")(lambda s, d: rounded(I.Intervals("text", _t("idiot")).hits(documents(s, d))))

# --- highlighting ---------------------------------------------------------------------------------------

R.add("highlight_whole", "select doc_id, regexp_replace(text, '\\b(idiot|clown)\\b', '<b>\\1</b>', 'gi') as highlighted from documents where lang = 'en' and regexp_matches(text, '\\b(idiot|clown)\\b', 'i')")(lambda s, d: table(s, d, "documents").where("lang = 'en'").where(F.col("text").rlike(r"(?i)\b(idiot|clown)\b")).select("doc_id", H.mark_all(F.col("text"), ["idiot", "clown"]).alias("highlighted")))
R.add("highlight_unified")(lambda s, d: table(s, d, "documents").where(F.col("text").contains("idiot")).select("doc_id", H.Highlighter(("idiot", "clown")).column(F.col("text")).alias("highlighted")))
R.add("highlight_phrase", f"with {TOK} select doc_id, coalesce(4 * n, 0)::int as n from documents left join (select a.doc_id, count(*) as n from tok a join tok b using (doc_id) where a.term = 'of' and b.term = 'the' and b.pos = a.pos + 1 group by 1) using (doc_id)")(lambda s, d: table(s, d, "documents").select("doc_id", F.size(H.Highlighter(phrases=(("of", "the"),)).regions(F.col("text"))).alias("n")))

# --- suggestions and spelling ----------------------------------------------------------------------------


def _words(s, d):
    return documents(s, d).terms("text").select("term", F.col("ttf").alias("weight"), "df")


_D = f"with {TOK} select term, ttf::bigint as weight from df where "
R.add("suggest_prefix", _D + "starts_with(term, 'th') order by ttf desc, term limit 10")(lambda s, d: S.prefix(_words(s, d), "th").select("term", "weight"))
R.add("suggest_infix", _D + "contains(term, 'ing') order by ttf desc, term limit 10")(lambda s, d: S.infix(_words(s, d), "ing").select("term", "weight"))
R.add("suggest_fuzzy", _D + "levenshtein(term, 'clowm') <= 1 order by ttf desc, term limit 10")(lambda s, d: S.fuzzy(_words(s, d), "clowm").select("term", "weight"))
R.add("suggest_fuzzy_prefix", _D + "levenshtein(substring(term, 1, 3), 'idip') <= 1 or levenshtein(substring(term, 1, 4), 'idip') <= 1 or levenshtein(substring(term, 1, 5), 'idip') <= 1 order by ttf desc, term limit 10")(lambda s, d: S.fuzzy_prefix(_words(s, d), "idip").select("term", "weight"))
R.add("suggest_regex", _D + "regexp_matches(term, '^(st[au])') order by ttf desc, term limit 10")(lambda s, d: S.regex(_words(s, d), "st[au]").select("term", "weight"))
R.add("suggest_fst", f"with {TOK}, b as (select term, ttf::bigint as weight, ntile(10) over (order by ttf, term) as bucket from df where starts_with(term, 'th')) select term, weight from b order by (term = 'th') desc, bucket desc, term limit 10")(lambda s, d: S.fst(_words(s, d), "th").select("term", "weight"))
R.add("suggest_context", "select p_type as term, (sum(p_size) * 2)::double as weight from part where starts_with(p_type, 'S') group by 1 having count(*) filter (p_brand = 'Brand#22') > 0 order by 2 desc, 1 limit 5")(lambda s, d: S.in_context(S.dictionary(table(s, d, "part"), "p_type", "p_size", contexts="p_brand"), "S", {"Brand#22": 2.0}, 5).select("term", "weight"))
R.add("suggest_blended", f"with {TOK} select term, avg(w) as weight from (select * from (select term, ttf as w from df where starts_with(term, 'th') order by ttf desc, term limit 10) union all select * from (select term, ttf from df where contains(term, 'the') order by ttf desc, term limit 10)) group by 1 order by 2 desc, 1 limit 10")(lambda s, d: S.blended([S.prefix(_words(s, d), "th"), S.infix(_words(s, d), "the")]))
R.add("suggest_free_text", f"with {TOK}, b as (select term, lag(term) over (partition by doc_id order by pos) as p from tok), l as (select term, count(*) / (select count(*) from b where p = 'of')::double as w, 1 as m from b where p = 'of' and starts_with(term, 'th') group by 1 union all select term, 0.4 * count(*) / (select count(*) from b)::double, 0 from b where starts_with(term, 'th') group by 1) select term, round(arg_max(w, m), 6) as weight from l group by 1 order by arg_max(w, m) desc, term limit 5")(lambda s, d: S.free_text(documents(s, d).tokens("text"), "of th", 2, 5).withColumn("weight", F.round("weight", 6)))
R.add("spell_direct", f"with {TOK} select term, df::bigint as df, round(1 - damerau_levenshtein(term, 'stupidd')::double / greatest(length(term), 7), 6) as score from df where starts_with(term, 's') and damerau_levenshtein(term, 'stupidd') <= 4 and abs(length(term) - 7) <= 2 and 1 - damerau_levenshtein(term, 'stupidd')::double / greatest(length(term), 7) >= 0.5 order by 3 desc, 2 desc, 1 limit 5")(lambda s, d: S.direct_spelling(_words(s, d), "stupidd").withColumn("score", F.round("score", 6)))
R.add("spell_ngram", f"with {TOK} select term, round(1 - levenshtein(term, 'worthles') / greatest(length(term), 8)::double, 6) as score from df where term <> 'worthles' and (" + " or ".join(f"contains(term, '{'worthles'[i:i + 3]}')" for i in range(6)) + ") and 1 - levenshtein(term, 'worthles') / greatest(length(term), 8)::double >= 0.5 order by score desc, term limit 5")(lambda s, d: S.ngram_spelling(_words(s, d), "worthles").withColumn("score", F.round("score", 6)))
R.add("spell_break", f"with {TOK} select a.term as left, b.term as right, least(a.df, b.df)::bigint as df from df a, df b where a.term || b.term = 'theidiot'")(lambda s, d: S.word_breaks(_words(s, d), "theidiot"))
R.add("spell_combine", f"with {TOK} select term as combined, df::bigint as df, 0 as first, 2 as parts from df where term = 'idiot'")(lambda s, d: S.word_combinations(_words(s, d), ["id", "iot"]))

# --- classification ----------------------------------------------------------------------------------------

_LAB = "l as (select doc_id, toxic from labels)"


def _labelled(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id")


def _index(s, d):
    from ..operators.index import Index

    return Index.of(_labelled(s, d), "text")


_LTOK = TOK.replace("from documents)", "from documents join labels using (doc_id))", 1)
R.add("classify_knn", f"with {_LTOK}, h as (select doc_id, sum({BM25}) as score from s where term in ('idiot', 'clown', 'moron') group by 1), t as (select h.score, toxic from h join labels using (doc_id) order by h.score desc, doc_id limit 10) select toxic as class, round(count(*) * avg(score / (select max(score) from t)) / 10, 6) as score from t group by 1")(lambda s, d: K.knn(_index(s, d), "text", "toxic", ("idiot", "clown", "moron"), 10).withColumn("score", F.round("score", 6)))
R.add("classify_naive_bayes", f"with {_LTOK}, c as (select toxic as class, count(*)::double as docs from labels join documents using (doc_id) group by 1), z as (select toxic as class, count(*)::double as tokens from tok join labels using (doc_id) group by 1), h as (select toxic as class, term, count(*)::double as hits from tf join labels using (doc_id) group by 1, 2) select class, round(ln(docs) - ln((select sum(docs) from c)) + sum(ln((coalesce(hits, 0) + 1) / (tokens / docs + docs))), 6) as score from c join z using (class) cross join (values ('idiot'), ('clown')) w(term) left join h using (class, term) group by class, docs")(lambda s, d: K.NaiveBayes(_labelled(s, d), "text", "toxic").scores(s.createDataFrame([(1, "idiot"), (1, "clown")], "id int, term string")).select("class", F.round("score", 6).alias("score")))
R.add("classify_confusion", "select toxic as actual, (quality = 0)::int as predicted, count(*)::bigint as count from labels group by 1, 2")(lambda s, d: K.confusion(table(s, d, "labels").withColumn("p", (F.col("quality") == 0).cast("int")), "toxic", "p"))
R.add("classify_accuracy", "select round(avg((toxic = (quality = 0)::int)::int), 6) as accuracy from labels")(lambda s, d: K.accuracy(K.confusion(table(s, d, "labels").withColumn("p", (F.col("quality") == 0).cast("int")), "toxic", "p")).select(F.round("accuracy", 6).alias("accuracy")))
R.add("classify_perceptron")(lambda s, d: K.confusion(K.perceptron_classify(_labelled(s, d), "text", *K.perceptron(_labelled(s, d), "text", "toxic", 2)).join(table(s, d, "labels"), "doc_id"), "toxic", "label"))
R.add("dataset_split")(lambda s, d: table(s, d, "documents").select(K.split(F.col("doc_id")).alias("part")).groupBy("part").agg(F.count("*").alias("n")))
R.add("minhash")(lambda s, d: table(s, d, "benchmark").select("item_id", K.min_hashes(T.ascii_words(F.col("text")), 8).alias("m")).select("item_id", F.get("m", 0).alias("first")))

# --- reverse search and streams -------------------------------------------------------------------------------


def _monitor():
    m = M.Monitor()
    m.register("insult", P.parse("idiot OR clown"))
    m.register("both", P.parse("+idiot +clown"))
    m.register("licence", P.parse('"apache license"'))
    m.register("not", P.parse("+idiot -clown"))
    return m


_PERC = f"with {TOK} select distinct doc_id, 'insult' as query from tok where term in ('idiot', 'clown') union all select doc_id, 'both' from tf where term in ('idiot', 'clown') group by 1 having count(*) = 2 union all select distinct a.doc_id, 'licence' from tok a join tok b on a.doc_id = b.doc_id and a.term = 'apache' and b.term = 'license' and b.pos = a.pos + 1 union all select doc_id, 'not' from tf where term in ('idiot', 'clown') group by 1 having count(*) = 1 and any_value(term) = 'idiot'"
R.add("percolate", _PERC)(lambda s, d: _monitor().match(table(s, d, "documents")).select("doc_id", "query"))
R.add("percolate_join", _PERC)(lambda s, d: _monitor().match_stored(table(s, d, "documents")).select("doc_id", "query"))
R.add("percolate_stream", _PERC)(lambda s, d: _stream(s, d))
R.add("event_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*)::bigint as count, round(sum(value), 4) as total from events group by 1, 2")(lambda s, d: streaming.tumbling(table(s, d, "events"), "ts", "1 hour", "event_type").withColumn("total", F.round("total", 4)))
R.add("event_sliding", "select unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as start, count(*)::bigint as count from events group by 1")(lambda s, d: streaming.sliding(table(s, d, "events"), "ts", "2 hours", "1 hour"))
R.add("event_sessions", "with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select min(ts) as start, max(ts) + interval 30 minute as stop, user_id, count(*)::bigint as count from g group by user_id, k")(lambda s, d: streaming.sessions(table(s, d, "events"), "ts", "30 minutes", "user_id"))


def _stream(s, d):
    src = f"{d}/documents.parquet"
    one = s.read.parquet(src)
    # a file source wants a folder: the glob makes the one file a folder's only match
    docs = s.readStream.schema(one.schema).option("pathGlobFilter", "*.parquet").parquet(f"{src}*")
    out = streaming.percolate(docs, _monitor()).select("doc_id", "query")
    return streaming.run_available(out, f"percolated_{abs(hash(d)) % 10**8}_{id(out)}", store.scratch_path(s, "stream"))


# --- stored indexes ------------------------------------------------------------------------------------------------


@R.add("stored_index", f"with {TOK} select doc_id, round(sum({BM25}), 6) as score from s where term in ('idiot', 'the') group by 1 order by sum({BM25}) desc, doc_id limit 10")
def _stored(s, d):
    from ..operators.collect import top

    st = store.IndexStore(s, store.scratch_path(s, "index"))
    docs = table(s, d, "documents")
    st.add(docs.where("doc_id % 2 = 0"), {"text": T.ascii_words})
    st.add(docs.where("doc_id % 2 = 1"), {"text": T.ascii_words})
    return rounded(top(Q.Boolean.of(should=[Q.Term("text", "idiot"), Q.Term("text", "the")]).hits(st.open({"text": T.ascii_words})), 10))


@R.add("stored_index_updates", "select doc_id, case when doc_id % 10 = 3 then 'new text' else text end as text from documents where doc_id % 10 <> 7")
def _updates(s, d):
    st = store.IndexStore(s, store.scratch_path(s, "index"))
    docs = table(s, d, "documents").select("doc_id", "text")
    st.add(docs, {"text": T.ascii_words})
    st.delete_where("doc_id % 10 = 7")
    st.update(docs.where("doc_id % 10 = 3").withColumn("text", F.lit("new text")), {"text": T.ascii_words})
    st.merge()
    return st.docs()


R.add("multi_reader", "select doc_id, (doc_id % 2)::int as shard from documents")(lambda s, d: store.multi(*[table(s, d, "documents").select("doc_id").where(f"doc_id % 2 = {i}") for i in range(2)]))
R.add("parallel_reader", "select doc_id, lang, source from documents")(lambda s, d: store.parallel(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "documents").select("doc_id", "source")))
R.add("schema_registry", "select p_partkey as doc_id, p_size::bigint as p_size from part")(lambda s, d: store.Schema().add("doc_id", "long").add("p_size", "long").conform(_parts(s, d)))
R.add("html_strip")(lambda s, d: table(s, d, "pages").select("page_id", _strip(F.col("html")).alias("n")))


def _strip(c):
    @F.pandas_udf("int")
    def udf(x: pd.Series) -> pd.Series:
        strip = analysis.html_strip()
        return x.map(lambda v: len(strip(v or "").split()))

    return udf(c)


QUERIES, ORACLES = R.queries, R.oracles
