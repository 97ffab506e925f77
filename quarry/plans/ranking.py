"""Ranked retrieval over documents: terms, booleans, rewrites, phrases and similarities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import collect as C
from ..operators import query as Q
from ..operators import spans as S
from .base import BM25, TOK, Registry, documents, rounded

R = Registry()


def _hits(name: str, build, sql: str, k: int | None = None):
    """A query over documents.text: all hits, or the best k; `sql` follows the token tables and yields doc_id and score."""
    text = f"with {TOK} select doc_id, round(score, 6) as score from ({sql})" + (f" order by score desc, doc_id limit {k}" if k else "")
    # rounding after ordering, so that equal ranks stay equal
    if k:
        text = f"with {TOK} select doc_id, round(score, 6) as score from (select * from ({sql}) order by score desc, doc_id limit {k})"

    @R.add(name, text)
    def run(spark, sf_dir):
        index = documents(spark, sf_dir)
        h = build(index) if callable(build) else build.hits(index)
        return rounded(C.top(h, k) if k else h)

    return run


def _terms(*terms: str) -> str:
    return "term in (" + ", ".join(f"'{t}'" for t in terms) + ")"


T = lambda t: Q.Term("text", t)
ANY = f"select doc_id, sum({BM25}) as score from s where {{}} group by doc_id"

_hits("bm25_top10", Q.Boolean.of(should=[T("stupid"), T("the")]), ANY.format(_terms("stupid", "the")), 10)
_hits("term_query", T("idiot"), f"select doc_id, {BM25} as score from s where term = 'idiot'")
_hits("term_top100", T("and"), f"select doc_id, {BM25} as score from s where term = 'and'", 100)
_hits("match_all", Q.MatchAll(), "select doc_id, 1.0::double as score from documents")
_hits("match_none", Q.MatchNone(), "select doc_id, 0.0::double as score from documents where false")
_hits(
    "boolean_must_should_not",
    Q.Boolean.of(must=[T("the")], should=[T("idiot"), T("clown")], must_not=[T("moron")], filter=[T("of")]),
    f"select doc_id, sum(case when term in ('the', 'idiot', 'clown') then {BM25} else 0 end) as score from s where {_terms('the', 'idiot', 'clown', 'moron', 'of')} group by doc_id having count(*) filter (term = 'the') > 0 and count(*) filter (term = 'of') > 0 and count(*) filter (term = 'moron') = 0",
)
_hits("boolean_min_should", Q.Boolean.of(should=[T("idiot"), T("clown"), T("moron"), T("stupid")], min_should=2), f"select doc_id, sum({BM25}) as score from s where {_terms('idiot', 'clown', 'moron', 'stupid')} group by doc_id having count(*) >= 2")
_hits("boolean_nested", Q.Boolean.of(must=[Q.Boolean.of(should=[T("idiot"), T("clown")]), T("the")]), f"select doc_id, sum({BM25}) as score from s where {_terms('idiot', 'clown', 'the')} group by doc_id having count(*) filter (term <> 'the') > 0 and count(*) filter (term = 'the') > 0")
_hits("boolean_rewrite", lambda i: Q.Boolean.of(filter=[T("idiot")]).rewrite().hits(i), "select doc_id, 0.0::double as score from tf where term = 'idiot'")
_hits("constant_score", Q.ConstantScore(T("idiot"), 2.5), "select doc_id, 2.5::double as score from tf where term = 'idiot'")
_hits("boost", Q.Boost(T("idiot"), 3.0), f"select doc_id, 3 * {BM25} as score from s where term = 'idiot'")
_hits("disjunction_max", Q.DisjunctionMax((T("idiot"), T("clown"), T("moron")), 0.25), f"select doc_id, max({BM25}) + 0.25 * (sum({BM25}) - max({BM25})) as score from s where {_terms('idiot', 'clown', 'moron')} group by doc_id")
_hits("prefix", Q.Prefix("text", prefix="wor"), "select distinct doc_id, 1.0::double as score from tf where starts_with(term, 'wor')")
_hits("wildcard", Q.Wildcard("text", pattern="st?p*d"), "select distinct doc_id, 1.0::double as score from tf where regexp_full_match(term, 'st.p.*d')")
_hits("regexp", Q.Regexp("text", pattern="(idi|mor)o[nt]"), "select distinct doc_id, 1.0::double as score from tf where regexp_full_match(term, '(idi|mor)o[nt]')")
_hits("automaton", Q.Automaton("text", pattern="[0-9]+"), "select distinct doc_id, 1.0::double as score from tf where regexp_full_match(term, '[0-9]+')")
_hits("term_range", Q.TermRange("text", low="idiot", high="idle", include_high=False), "select distinct doc_id, 1.0::double as score from tf where term >= 'idiot' and term < 'idle'")
_hits("term_set", Q.TermSet("text", values=("idiot", "clown", "scum")), f"select distinct doc_id, 1.0::double as score from tf where {_terms('idiot', 'clown', 'scum')}")
_hits("rewrite_scoring", Q.Prefix("text", prefix="idio", rewrite_as=Q.SCORING), ANY.format("starts_with(term, 'idio')"))
_hits("rewrite_top_terms", Q.Prefix("text", prefix="wo", rewrite_as=Q.TOP_TERMS, max_clauses=5), ANY.format("term in (select term from df where starts_with(term, 'wo') order by term limit 5)"))
_hits(
    "fuzzy",
    Q.Fuzzy("text", term="clown", max_edits=1),
    f"select doc_id, sum({BM25} * boost) as score from s join (select term, 1 - damerau_levenshtein(term, 'clown') / 2.0 as boost from df where damerau_levenshtein(term, 'clown') <= 1 order by boost desc, term limit 50) using (term) group by doc_id",
)
_hits("fuzzy_plain", Q.Fuzzy("text", term="stupit", max_edits=2, prefix_length=2, transpositions=False), f"select doc_id, sum({BM25} * boost) as score from s join (select term, 1 - levenshtein(term, 'stupit') / 3.0 as boost from df where starts_with(term, 'st') and levenshtein(term, 'stupit') <= 2 order by boost desc, term limit 50) using (term) group by doc_id")
_hits(
    "synonym",
    Q.Synonym.of("text", "idiot", "moron"),
    "select doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) - ln(1 + (n - df + 0.5) / (df + 0.5)) / (1 + tf / (1.2 * (0.25 + 0.75 * dl / avgdl))) as score from (select doc_id, sum(tf) as tf, any_value(dl) as dl, any_value(n) as n, any_value(avgdl) as avgdl, (select max(df) from df where term in ('idiot', 'moron')) as df from s where term in ('idiot', 'moron') group by doc_id)",
)
_hits(
    "blended",
    Q.Blended((("text", "idiot", 1.0), ("text", "moron", 2.0))),
    "select doc_id, sum(b * (ln(1 + (n - d + 0.5) / (d + 0.5)) - ln(1 + (n - d + 0.5) / (d + 0.5)) / (1 + tf / (1.2 * (0.25 + 0.75 * dl / avgdl))))) as score from (select *, case term when 'moron' then 2 else 1 end as b, (select max(df) from df where term in ('idiot', 'moron')) as d from s where term in ('idiot', 'moron')) group by doc_id",
)
_hits(
    "common_terms",
    Q.CommonTerms("text", ("the", "idiot", "moron"), 0.2, rare_all=False),
    f"select doc_id, sum({BM25}) as score from s where {_terms('the', 'idiot', 'moron')} group by doc_id having count(*) filter (df <= ceil(0.2 * (select count(*) from documents))) >= 1",
)
_hits(
    "covering",
    Q.Covering((T("idiot"), T("clown"), T("moron")), "case when lang = 'en' then 2 else 1 end"),
    f"select doc_id, sum({BM25}) as score from s join documents using (doc_id) where {_terms('idiot', 'clown', 'moron')} group by doc_id, lang having count(*) >= case when lang = 'en' then 2 else 1 end",
)
_hits(
    "more_like_this",
    Q.MoreLikeThis("text", ("idiot", "idiot", "clown", "clown", "clown", "the", "the"), min_tf=2, min_df=5, max_df_percent=50, max_terms=2),
    ANY.format("term in (select term from (values ('idiot', 2), ('clown', 3), ('the', 2)) w(term, f) join df using (term) where df >= 5 and df <= floor((select count(*) from documents) * 50 / 100) order by (1 + log10(f)) * log10((select count(*) from documents) / (df + 1)) desc, term limit 2)"),
)
_hits("indri_and", Q.IndriAnd("text", (("idiot", 1.0), ("the", 2.0))), "select doc_id, sum(w / 3 * ln((coalesce(x.tf, 0) + 2000 * ((ttf + 1) / (total + 1))) / (l.dl + 2000))) as score from (select distinct doc_id from tf where term in ('idiot', 'the')) d join len l using (doc_id) cross join (select term, ttf, case term when 'the' then 2 else 1 end as w from df where term in ('idiot', 'the')) q left join tf x using (doc_id, term), st group by doc_id")
_hits("function_score", Q.FunctionScore(T("idiot"), "ln(1 + n_chars)", multiply=True), f"select doc_id, {BM25} * ln(1 + n_chars) as score from s join documents using (doc_id) where term = 'idiot'")
_hits("function_query", Q.FunctionQuery("sqrt(n_chars)"), "select doc_id, sqrt(n_chars) as score from documents")
_hits("function_range", Q.FunctionRange("n_chars / 10.0D", 50.0, 100.0), "select doc_id, n_chars / 10.0 as score from documents where n_chars / 10.0 between 50 and 100")
_hits("feature_saturation", Q.Feature("n_chars", "saturation", pivot=1000.0, weight=2.0), "select doc_id, 2 * n_chars / (n_chars + 1000.0) as score from documents where n_chars > 0")
_hits("feature_sigmoid", Q.Feature("n_chars", "sigmoid", pivot=1000.0, exponent=0.6), "select doc_id, pow(n_chars, 0.6) / (pow(n_chars, 0.6) + pow(1000, 0.6)) as score from documents where n_chars > 0")
_hits("feature_log", Q.Feature("n_chars", "log", pivot=10.0), "select doc_id, ln(10 + n_chars) as score from documents where n_chars > 0")
_hits("distance_feature", Q.DistanceFeature("n_chars", 1000.0, 200.0, 1.5), "select doc_id, 1.5 * 200 / (200 + abs(n_chars - 1000.0)) as score from documents")
_hits("doc_and_score", lambda i: Q.DocAndScore(i.docs.selectExpr("doc_id", "n_chars % 7 score")).hits(i), "select doc_id, (n_chars % 7)::double as score from documents")
_hits("rescore_top_query", Q.RescoreTop(T("the"), T("idiot"), 50, 2.0), f"select a.doc_id, a.score + 2 * coalesce(b.score, 0) as score from (select doc_id, {BM25} as score from s where term = 'the' order by score desc, doc_id limit 50) a left join (select doc_id, {BM25} as score from s where term = 'idiot') b using (doc_id)")
_hits("field_range", Q.Range("n_chars", 1000, 2000, include_high=False), "select doc_id, 1.0::double as score from documents where n_chars >= 1000 and n_chars < 2000")
_hits("field_exists", Q.Exists("lang"), "select doc_id, 1.0::double as score from documents where lang is not null")
_hits("point_range", Q.PointRange(("n_chars", "doc_id"), (500, 100), (1500, 800)), "select doc_id, 1.0::double as score from documents where n_chars between 500 and 1500 and doc_id between 100 and 800")
_hits("point_exact", Q.PointSet("doc_id", (42,)), "select doc_id, 1.0::double as score from documents where doc_id = 42")
_hits("point_set", Q.PointSet("doc_id", (1, 5, 7, 11)), "select doc_id, 1.0::double as score from documents where doc_id in (1, 5, 7, 11)")
_hits("multi_range", Q.MultiRange("n_chars", ((0, 100), (5000, 6000))), "select doc_id, 1.0::double as score from documents where n_chars between 0 and 100 or n_chars between 5000 and 6000")
_hits("column_where", Q.Where("lang = 'fr' and n_chars > 1000"), "select doc_id, 1.0::double as score from documents where lang = 'fr' and n_chars > 1000")
_hits("set_union", lambda i: Q.union(T("idiot").hits(i), T("clown").hits(i)), ANY.format(_terms("idiot", "clown")))
_hits("set_intersection", lambda i: Q.intersection(T("idiot").hits(i), T("clown").hits(i)), ANY.format(_terms("idiot", "clown")) + " having count(*) = 2")
_hits("set_difference", lambda i: Q.difference(T("idiot").hits(i), T("clown").hits(i)), f"select doc_id, {BM25} as score from s where term = 'idiot' and doc_id not in (select doc_id from tf where term = 'clown')")
_hits("required_optional", lambda i: Q.required_optional(T("idiot").hits(i), T("clown").hits(i)), f"select doc_id, sum({BM25}) as score from s where {_terms('idiot', 'clown')} group by doc_id having count(*) filter (term = 'idiot') > 0")


#: Similarities: name, function, and SQL over tf, df, ttf, dl, n, total and avgdl.
_P = "((ttf + 1) / (total + 1))"
_L = "((ttf + 1) / (n + ttf + 1))"
_H2 = "(tf * log2(1 + avgdl / dl))"
_E = "((ttf + 1) * dl / (total + 1))"
_TF = "(1 + ln(1 + ln(tf)))"
_LN = "((avgdl + 0.25) / (avgdl + dl * 0.25))"
_TFLN = "(tf / (tf + 0.25 + 0.25 * dl / avgdl))"
SIMILARITIES = {
    "bm25": (sim.bm25(), BM25),
    "bm25_params": (sim.bm25(2.0, 0.3), BM25.replace("1.2 * (0.25 + 0.75", "2.0 * (0.7 + 0.3")),
    "bm25_quantised": (sim.bm25(quantised=True), BM25.replace("dl / avgdl", "(case when dl < 40 then dl else 24 + floor((dl - 24) / pow(2, greatest(floor(log2(dl - 24)) - 3, 0))) * pow(2, greatest(floor(log2(dl - 24)) - 3, 0)) end) / avgdl")),
    "classic": (sim.classic(), "sqrt(tf) * (ln((n + 1) / (df + 1)) + 1) / sqrt(dl)"),
    "lm_dirichlet": (sim.lm_dirichlet(), f"greatest(0, ln(1 + tf / (2000 * {_P})) + ln(2000 / (dl + 2000)))"),
    "lm_jelinek_mercer": (sim.lm_jelinek_mercer(0.7), f"ln(1 + (0.3 * tf / dl) / (0.7 * {_P}))"),
    "indri_dirichlet": (sim.indri_dirichlet(), f"ln((tf + 2000 * {_P}) / (dl + 2000))"),
    "boolean": (sim.boolean(), "1.0"),
    "raw_tf": (sim.raw_tf(), "tf"),
    "dfr_g_l_h2": (sim.dfr("G", "L", "H2"), f"(log2({_L} + 1) + {_H2} * log2((1 + {_L}) / {_L})) / ({_H2} + 1)"),
    "dfr_if_b_h1": (sim.dfr("IF", "B", "H1"), "(tf * avgdl / dl) * log2(1 + (n + 1) / (ttf + 0.5)) * (ttf + 2) / ((df + 1) * ((tf * avgdl / dl) + 1))"),
    "dfr_in_l_none": (sim.dfr("In", "L", "none"), "tf * log2((n + 1) / (df + 0.5)) / (tf + 1)"),
    "dfr_ine_b_z": (sim.dfr("Ine", "B", "Z"), "(tf * pow(avgdl / dl, 0.3)) * log2((n + 1) / (n * (1 - pow((n - 1) / n, ttf)) + 0.5)) * (ttf + 2) / ((df + 1) * ((tf * pow(avgdl / dl, 0.3)) + 1))"),
    "dfr_if_l_h3": (sim.dfr("IF", "L", "H3"), f"((tf + 800 * {_P}) / (dl + 800) * 800) * log2(1 + (n + 1) / (ttf + 0.5)) / (((tf + 800 * {_P}) / (dl + 800) * 800) + 1)"),
    "ib_ll_df": (sim.ib("LL", "DF", "H2"), f"-ln(((df + 1) / (n + 1)) / ({_H2} + (df + 1) / (n + 1)))"),
    "ib_spl_ttf": (sim.ib("SPL", "TTF", "H2"), f"-ln((pow((ttf + 1) / (n + 1), {_H2} / ({_H2} + 1)) - (ttf + 1) / (n + 1)) / (1 - (ttf + 1) / (n + 1)))"),
    "dfi_chi_squared": (sim.dfi("chi_squared"), f"case when tf > {_E} then log2((tf - {_E}) * (tf - {_E}) / {_E} + 1) else 0 end"),
    "dfi_saturated": (sim.dfi("saturated"), f"case when tf > {_E} then log2((tf - {_E}) / {_E} + 1) else 0 end"),
    "dfi_standardized": (sim.dfi("standardized"), f"case when tf > {_E} then log2((tf - {_E}) / sqrt({_E}) + 1) else 0 end"),
    "axiomatic_f1log": (sim.axiomatic("F1LOG"), f"greatest(0, {_TF} * {_LN} * ln((n + 1) / df))"),
    "axiomatic_f1exp": (sim.axiomatic("F1EXP"), f"greatest(0, {_TF} * {_LN} * pow((n + 1) / df, 0.35))"),
    "axiomatic_f2log": (sim.axiomatic("F2LOG"), f"greatest(0, {_TFLN} * ln((n + 1) / df))"),
    "axiomatic_f2exp": (sim.axiomatic("F2EXP"), f"greatest(0, {_TFLN} * pow((n + 1) / df, 0.35))"),
    "axiomatic_f3log": (sim.axiomatic("F3LOG"), f"greatest(0, {_TF} * ln((n + 1) / df) - (dl - 1) * 0.25 / avgdl)"),
    "axiomatic_f3exp": (sim.axiomatic("F3EXP"), f"greatest(0, {_TF} * pow((n + 1) / df, 0.35) - (dl - 1) * 0.25 / avgdl)"),
    "sweet_spot": (sim.sweet_spot(100, 300), "sqrt(tf) * (ln((n + 1) / (df + 1)) + 1) / sqrt(0.5 * (abs(dl - 100) + abs(dl - 300) - 200) + 1)"),
    "multi": (sim.multi(sim.bm25(), sim.raw_tf()), f"{BM25} + tf"),
    "custom": (sim.custom(lambda s: s.boost * F.log(1 + s.tf) * s.n / s.df), "ln(1 + tf) * n / df"),
}

for _name, (_fn, _sql) in SIMILARITIES.items():
    _hits(f"similarity_{_name}", lambda i, fn=_fn: i.scored("text", F.col("term") == "clown", similarity=fn).select("doc_id", "score"), f"select doc_id, {_sql} as score from s where term = 'clown'")


@R.add("similarity_per_field", f"with {TOK} select doc_id, round({BM25}, 6) as score from s where term = 'clown' union all select doc_id, 1.0::double as score from documents where source = 'src3'")
def _per_field(spark, sf_dir):
    from ..functions.text import ascii_words, keyword
    from ..operators.index import Index
    from .base import table

    index = Index(table(spark, sf_dir, "documents"), {"text": ascii_words, "source": keyword}, similarity=sim.PerField(sim.bm25(), {"source": sim.boolean()}))
    return rounded(Q.Term("text", "clown").hits(index).union(Q.Term("source", "src3").hits(index)))


@R.add("combined_fields", f"""
with {TOK},
a as (select doc_id, 2.0 * tf as tf, term from tf where term = 'clown' union all select doc_id, 1.0, source from documents where source = 'clown'),
l as (select doc_id, sum(dl) as dl from (select doc_id, 2.0 * dl as dl from len union all select doc_id, 1.0 from documents) group by doc_id),
t as (select count(*)::double as n, sum(dl) as total from l),
x as (select doc_id, sum(tf) as tf from a group by doc_id)
select doc_id, round(ln(1 + (n - d + 0.5) / (d + 0.5)) - ln(1 + (n - d + 0.5) / (d + 0.5)) / (1 + tf / (1.2 * (0.25 + 0.75 * dl / (total / n)))), 6) as score
from x join l using (doc_id), t, (select count(*)::double as d from x)
""")
def _combined(spark, sf_dir):
    from ..functions.text import ascii_words, keyword
    from ..operators.index import Index
    from .base import table

    index = Index(table(spark, sf_dir, "documents"), {"text": ascii_words, "source": keyword})
    return rounded(Q.CombinedFields((("text", 2.0), ("source", 1.0)), ("clown",)).hits(index))


@R.add("collection_statistics", f"with {TOK} select (select count(*) from len)::bigint as doc_count, (select sum(dl) from len)::bigint as sum_total_term_freq, (select count(*) from tf)::bigint as sum_doc_freq, (select count(*) from df)::bigint as terms")
def _collection(spark, sf_dir):
    index = documents(spark, sf_dir)
    n, total = index.stats("text")
    t = index.terms("text").agg(F.sum("df").alias("sum_doc_freq"), F.count("*").alias("terms"))
    return t.select(F.lit(n).cast("long").alias("doc_count"), F.lit(total).cast("long").alias("sum_total_term_freq"), "sum_doc_freq", "terms")


@R.add("term_statistics", f"with {TOK} select term, df::bigint as df, ttf::bigint as ttf from df where df >= 20")
def _term_stats(spark, sf_dir):
    return documents(spark, sf_dir).terms("text").where("df >= 20")


@R.add("named_matches", f"with {TOK} select doc_id, string_agg(term, ',' order by term) as names from tf where term in ('idiot', 'clown', 'moron') group by doc_id")
def _named(spark, sf_dir):
    out = Q.named_matches(documents(spark, sf_dir), {t: T(t) for t in ("idiot", "clown", "moron")})
    return out.select("doc_id", F.array_join("names", ",").alias("names"))


@R.add("match_positions", f"with {TOK} select doc_id, term, string_agg(pos::varchar, ',' order by pos) as positions from tok where term in ('idiot', 'clown') group by doc_id, term")
def _positions(spark, sf_dir):
    return Q.match_positions(documents(spark, sf_dir), "text", ["idiot", "clown"]).select("doc_id", "term", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@R.add("explain", f"with {TOK} select doc_id, tf::bigint as tf, dl::int as dl, df::int as df, n::int as n, round(avgdl, 6) as avgdl, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf, round({BM25}, 6) as score from s where term = 'idiot'")
def _explain(spark, sf_dir):
    out = Q.explain(documents(spark, sf_dir), "text", "idiot")
    return out.select("doc_id", "tf", "dl", "df", "n", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"), F.round("score", 6).alias("score"))


# --- phrases and ordered spans -------------------------------------------------------------------

_PHRASE = "select doc_id, count(*)::double as tf from tok a join tok b using (doc_id) where a.term = 'of' and b.term = 'the' and b.pos = a.pos + 1 group by doc_id"


def _freqs(name: str, build, sql: str):
    @R.add(name, f"with {TOK} select doc_id, freq::double as freq from ({sql})")
    def run(spark, sf_dir):
        return build(documents(spark, sf_dir)).select("doc_id", F.round("freq", 6).alias("freq"))


_freqs("phrase_exact", lambda i: S.phrase_freq(i, "text", ["of", "the"]), "select doc_id, count(*) as freq from tok a join tok b using (doc_id) where a.term = 'of' and b.term = 'the' and b.pos = a.pos + 1 group by doc_id")
_freqs("phrase_hole", lambda i: S.phrase_freq(i, "text", ["of", "the"], [0, 2]), "select doc_id, count(*) as freq from tok a join tok b using (doc_id) where a.term = 'of' and b.term = 'the' and b.pos = a.pos + 2 group by doc_id")
_freqs("multi_phrase", lambda i: S.multi_phrase_freq(i, "text", [["of", "and"], ["the", "a"]]), "select doc_id, count(*) as freq from tok a join tok b using (doc_id) where a.term in ('of', 'and') and b.term in ('the', 'a') and b.pos = a.pos + 1 group by doc_id")
_freqs("phrase_wildcard", lambda i: S.phrase_pattern_freq(i, "text", ["of", "th*"]), "select doc_id, count(*) as freq from tok a join tok b using (doc_id) where a.term = 'of' and starts_with(b.term, 'th') and b.pos = a.pos + 1 group by doc_id")
_freqs("ngram_phrase", lambda i: S.phrase_freq(i, "text", *S.ngram_phrase(2, ["the", "of", "the"])), "select doc_id, count(*) as freq from tok a join tok b using (doc_id) where a.term = 'the' and b.term = 'the' and b.pos = a.pos + 2 group by doc_id")
_hits(
    "phrase_query",
    S.Phrase("text", ("of", "the")),
    f"select doc_id, (w - w / (1 + tf / (1.2 * (0.25 + 0.75 * dl / (total / n))))) as score from ({_PHRASE}) join len using (doc_id), st, (select sum(ln(1 + ((select n from st) - df + 0.5) / (df + 0.5))) as w from df where term in ('of', 'the'))",
)
_SPANS = "select doc_id, start, stop from"
_NEAR = "(select a.doc_id, a.pos as s, min(b.pos) as e from tok a join tok b on a.doc_id = b.doc_id and a.term = 'idiot' and b.term = 'the' and b.pos > a.pos group by a.doc_id, a.pos)"


def _span(name: str, build, sql: str):
    @R.add(name, f"with {TOK} select doc_id, s::int as start, e::int as stop from ({sql})")
    def run(spark, sf_dir):
        out = build(documents(spark, sf_dir))
        return out.select("doc_id", F.explode("spans").alias("x")).select("doc_id", F.col("x.s").alias("start"), F.col("x.e").alias("stop"))


st = lambda t: S.SpanTerm("text", t)
_span("span_term", lambda i: st("idiot").spans(i), "select doc_id, pos as s, pos + 1 as e from tok where term = 'idiot'")
_span("span_or", lambda i: S.SpanOr((st("idiot"), st("clown"))).spans(i), "select doc_id, pos as s, pos + 1 as e from tok where term in ('idiot', 'clown')")
_span("span_first", lambda i: S.SpanFirst(st("the"), 3).spans(i), "select doc_id, pos as s, pos + 1 as e from tok where term = 'the' and pos + 1 <= 3")
_span("span_position_range", lambda i: S.SpanPositionRange(st("the"), 2, 6).spans(i), "select doc_id, pos as s, pos + 1 as e from tok where term = 'the' and pos >= 2 and pos + 1 <= 6")
_span("span_multi_term", lambda i: S.SpanMultiTerm("text", Q.Prefix("text", prefix="idio")).spans(i), "select doc_id, pos as s, pos + 1 as e from tok where starts_with(term, 'idio')")
_span("span_near_ordered", lambda i: S.SpanNear((st("idiot"), st("the")), 4, True).spans(i), f"select doc_id, s, e + 1 as e from {_NEAR} where e - s - 1 <= 4")
_span("span_not", lambda i: S.SpanNot(st("the"), st("of"), 1, 0).spans(i), "select doc_id, pos as s, pos + 1 as e from tok a where term = 'the' and not exists (select 1 from tok b where b.doc_id = a.doc_id and b.term = 'of' and b.pos between a.pos - 1 and a.pos)")
_span("span_containing", lambda i: S.SpanContaining(S.SpanNear((st("idiot"), st("the")), 4, True), st("of")).spans(i), f"select doc_id, s, e + 1 as e from {_NEAR} n where e - s - 1 <= 4 and exists (select 1 from tok b where b.doc_id = n.doc_id and b.term = 'of' and b.pos between n.s and n.e)")
_span("span_within", lambda i: S.SpanWithin(st("of"), S.SpanNear((st("idiot"), st("the")), 4, True)).spans(i), f"select distinct b.doc_id, b.pos as s, b.pos + 1 as e from {_NEAR} n join tok b on b.doc_id = n.doc_id and b.term = 'of' and b.pos between n.s and n.e where n.e - n.s - 1 <= 4")

QUERIES, ORACLES = R.queries, R.oracles
