"""Further field types, ranges, rewrites, spans, intervals, parsers, similarities, analysis components, stored queries and stores."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions import analysis, geo
from ..functions import similarity as sim
from ..functions import text as T
from ..operators import collect as C
from ..operators import grouping as G
from ..operators import intervals as I
from ..operators import knn as K
from ..operators import monitor as M
from ..operators import parsers as P
from ..operators import query as Q
from ..operators import spans as S
from ..operators.index import Index
from ..sources import store
from ..streaming import search as streaming
from .base import BM25, TOK, Registry, documents, rounded, table

R = Registry()


def _parts(s, d):
    return table(s, d, "part").withColumnRenamed("p_partkey", "doc_id")


# --- field types and their ranges -------------------------------------------------------------------------

R.add("field_float", "select p_partkey as doc_id, round(p_retailprice::float::double, 4) as price from part")(
    lambda s, d: store.Schema().add("doc_id", "long").add("p_retailprice", "float").conform(_parts(s, d)).select("doc_id", F.round(F.col("p_retailprice").cast("double"), 4).alias("price"))
)
R.add("field_binary", "select p_partkey as doc_id, hex(p_name) as name from part")(lambda s, d: store.Schema().add("doc_id", "long").add("p_name", "binary").conform(_parts(s, d)).select("doc_id", F.hex("p_name").alias("name")))
R.add("binary_point_range", "select p_partkey as doc_id, 1.0::double as score from part where p_brand >= 'Brand#2' and p_brand < 'Brand#4'")(
    lambda s, d: Q.Range("p_brand", bytearray(b"Brand#2"), bytearray(b"Brand#4"), include_high=False).hits(Index(store.Schema().add("doc_id", "long").add("p_brand", "binary").conform(_parts(s, d)), {}))
)
for _kind, _name, _low, _high in (("int", "p_size", 10, 20), ("long", "p_size", 10, 20), ("float", "p_retailprice", 905.0, 915.0), ("double", "p_retailprice", 905.0, 915.0)):
    R.add(f"slow_range_{_kind}", f"select p_partkey as doc_id, 1.0::double as score from part where {_name} between {_low} and {_high}")(
        lambda s, d, k=_kind, n=_name, a=_low, b=_high: Q.Range(n, a, b).hits(Index(store.Schema().add("doc_id", "long").add(n, k).conform(_parts(s, d)), {}))
    )
for _kind, _one, _from, _to, _qlow, _qhigh in (
    ("long", "p_size::bigint", "{} * 10000000000", "{} * 10000000000 + 50000000000", 200000000000, 240000000000),
    ("double", "p_retailprice::double", "{}", "{} + 10", 910.0, 915.0),
):
    _col = _one.partition("::")[0]
    for _rel, _sql in (("intersects", f"lo <= {_qhigh} and hi >= {_qlow}"), ("within", f"lo >= {_qlow} and hi <= {_qhigh}"), ("contains", f"lo <= {_qlow} and hi >= {_qhigh}"), ("crosses", f"lo <= {_qhigh} and hi >= {_qlow} and not (lo >= {_qlow} and hi <= {_qhigh})")):
        R.add(f"range_field_{_kind}_{_rel}", f"select doc_id, 1.0::double as score from (select p_partkey as doc_id, {_from.format(_one)} as lo, {_to.format(_one)} as hi from part) where {_sql}")(
            lambda s, d, k=_kind, c=_col, a=_from, b=_to, p=_qlow, q=_qhigh, r=_rel: Q.RangeField(("lo",), ("hi",), (p,), (q,), r).hits(
                Index(_parts(s, d).select("doc_id", F.expr(a.format(f"cast({c} as {'bigint' if k == 'long' else 'double'})")).alias("lo"), F.expr(b.format(f"cast({c} as {'bigint' if k == 'long' else 'double'})")).alias("hi")), {})
            )
        )


@R.add("range_field_inet", "select p_partkey as doc_id, 1.0::double as score from part where p_size between 10 and 20")
def _inet_ranges(s, d):
    """Ranges of addresses that grow with the part's size, against a network's."""
    from ..functions.dates import ip

    rows = _parts(s, d).select("doc_id", ip(F.concat(F.lit("10.0."), F.col("p_size"), F.lit(".0"))).alias("lo"), ip(F.concat(F.lit("10.0."), F.col("p_size"), F.lit(".255"))).alias("hi"))
    # addresses are 16 bytes in order; IPv4 ones are mapped
    mapped = lambda *b: bytearray(b"\0" * 10 + b"\xff\xff" + bytes(b))
    return Q.RangeField(("lo",), ("hi",), (mapped(10, 0, 10, 0),), (mapped(10, 0, 20, 255),), Q.WITHIN).hits(Index(rows, {}))


R.add("lazy_document", "select doc_id, lang from documents")(lambda s, d: _stored(s, d).docs(columns=["lang"]))
R.add("index_or_values", "select doc_id, 1.0::double as score from documents where n_chars between 100 and 500")(lambda s, d: Q.IndexOrValues(Q.Range("n_chars", 100, 500), Q.Where("n_chars between 100 and 500")).hits(documents(s, d)))
R.add("index_sort_range", "select p_partkey as doc_id, 1.0::double as score from part where p_size between 10 and 12")(
    lambda s, d: Q.Range("p_size", 10, 12).hits(Index(_parts(s, d).repartitionByRange("p_size").sortWithinPartitions("p_size"), {}))
)

# --- rewrites ------------------------------------------------------------------------------------------------

for _how in (Q.BLENDED, Q.AUTO):
    for _n, _q, _sql in (("prefix", lambda h: Q.Prefix("text", h, prefix="sc"), "starts_with(term, 'sc')"), ("wildcard", lambda h: Q.Wildcard("text", h, pattern="*ing"), "term like '%ing'"), ("regexp", lambda h: Q.Regexp("text", h, pattern="(idi|mor)o[nt]"), "regexp_full_match(term, '(idi|mor)o[nt]')")):
        R.add(f"rewrite_{_how}_{_n}", f"with {TOK} select distinct doc_id, 1.0::double as score from tf where {_sql}")(lambda s, d, q=_q, h=_how: q(h).hits(documents(s, d)))

# --- spans ---------------------------------------------------------------------------------------------------

_span = lambda t: S.SpanTerm("text", t)
_pair = "select distinct a.doc_id from tok a join tok b using (doc_id) where a.term = '{}' and b.term = '{}' and {}"
R.add("span_near_unordered", f"with {TOK} {_pair.format('idiot', 'the', 'abs(b.pos - a.pos) <= 3')}")(lambda s, d: S.SpanNear((_span("idiot"), _span("the")), 2, ordered=False).hits(documents(s, d)).select("doc_id"))
R.add("span_near_gaps", f"with {TOK} {_pair.format('of', 'the', 'b.pos = a.pos + 2')}")(lambda s, d: S.SpanNearGaps((_span("of"), S.SpanGap(1), _span("the"))).hits(documents(s, d)).select("doc_id"))
R.add("span_or_terms", f"with {TOK} select distinct doc_id from tok where term in ('idiot', 'clown', 'scum')")(lambda s, d: S.SpanOrTerms("text", "idiot", "clown", "scum").hits(documents(s, d)).select("doc_id"))
R.add("span_scoring", f"with {TOK} select doc_id, round(tf / 2, 6) as score from tf where term = 'idiot'")(lambda s, d: rounded(_span("idiot").hits(documents(s, d))))
R.add("span_scoring_near", f"with {TOK} select a.doc_id, round(count(*) / 3.0, 6)::double as score from tok a join tok b using (doc_id) where a.term = 'of' and b.term = 'the' and b.pos = a.pos + 1 group by 1")(lambda s, d: rounded(S.SpanNear((_span("of"), _span("the")), 0).hits(documents(s, d))))

# --- intervals -------------------------------------------------------------------------------------------------

_t = I.Term
_wide = I.max_width(I.Ordered((_t("idiot"), _t("the"))), 8)
#: The smallest ordered intervals of idiot ... the, of at most 8 positions.
_WIDE = "p as (select a.doc_id, a.pos as s, min(b.pos) as e from tok a join tok b using (doc_id) where a.term = 'idiot' and b.term = 'the' and b.pos > a.pos group by 1, 2), m as (select doc_id, max(s) as s, e from p group by doc_id, e having e - max(s) < 8)"
_one = "select distinct a.doc_id from tok a where a.term = '{}' and {} (select 1 from tok b where b.doc_id = a.doc_id and b.term = '{}' and {})"
_intervals = {
    "max_gaps": (I.max_gaps(I.Ordered((_t("of"), _t("the"))), 1), _pair.format("of", "the", "b.pos > a.pos and b.pos - a.pos <= 2")),
    "max_width": (I.max_width(I.Unordered((_t("of"), _t("the"))), 2), _pair.format("of", "the", "abs(b.pos - a.pos) <= 1")),
    "not_containing": (I.not_containing(_wide, _t("of")), f", {_WIDE} select distinct doc_id from m where not exists (select 1 from tok o where o.doc_id = m.doc_id and o.term = 'of' and o.pos between m.s and m.e)"),
    "contained_by": (I.contained_by(_t("of"), _wide), f", {_WIDE} select distinct m.doc_id from m join tok o on o.doc_id = m.doc_id and o.term = 'of' and o.pos between m.s and m.e"),
    "not_contained_by": (I.not_contained_by(_t("idiot"), _wide), f", {_WIDE} select distinct o.doc_id from tok o where o.term = 'idiot' and not exists (select 1 from m where m.doc_id = o.doc_id and o.pos between m.s and m.e)"),
    "overlapping": (I.overlapping(I.Extend(_t("idiot"), 3, 3), _t("the")), _one.format("idiot", "exists", "the", "abs(b.pos - a.pos) <= 3")),
    "non_overlapping": (I.non_overlapping(I.Extend(_t("idiot"), 1, 1), _t("the")), _one.format("idiot", "not exists", "the", "abs(b.pos - a.pos) <= 1")),
    "not_within": (I.not_within(_t("idiot"), 2, _t("the")), _one.format("idiot", "not exists", "the", "abs(b.pos - a.pos) <= 2")),
    "after": (I.after(_t("idiot"), _t("clown")), _one.format("idiot", "exists", "clown", "b.pos < a.pos")),
    "extend": (I.containing(I.Extend(_t("idiot"), 0, 3), _t("the")), _one.format("idiot", "exists", "the", "b.pos > a.pos and b.pos <= a.pos + 3")),
    "analyzed_text": (I.analyzed(["of", "the"], 1), _pair.format("of", "the", "b.pos > a.pos and b.pos - a.pos <= 2")),
    "analyzed_text_any_order": (I.analyzed(["of", "the"], 0, False), _pair.format("of", "the", "abs(b.pos - a.pos) = 1")),
    "none": (I.Nothing(), "select doc_id from documents where false"),
}
for _n, (_src, _sql) in _intervals.items():
    R.add(f"intervals_{_n}", f"with {TOK}{_sql if _sql[0] == ',' else ' ' + _sql}")(lambda s, d, x=_src: I.Intervals("text", x).hits(documents(s, d)).select("doc_id"))
R.add("intervals_score_sigmoid", f"with {TOK} select doc_id, round(2 * pow(tf, 1.5) / (pow(tf, 1.5) + pow(3, 1.5)), 6) as score from tf where term = 'idiot'")(lambda s, d: rounded(I.Intervals("text", _t("idiot"), 3.0, 1.5, 2.0).hits(documents(s, d))))

# --- parsers -----------------------------------------------------------------------------------------------------

_any = f"with {TOK} select doc_id, round(sum({BM25}), 6) as score from s where {{}} group by doc_id"
R.add("parse_precedence", _any.format("term in ('idiot', 'the', 'clown')") + " having count(*) filter (term = 'clown') > 0 or count(*) filter (term in ('idiot', 'the')) = 2")(
    # AND binds first; a group's terms count only if the group matches
    lambda s, d: P.parse("idiot AND the OR clown", precedence=True).hits(documents(s, d)).select("doc_id", F.lit(1).alias("one")).join(Q.Boolean.of(should=[Q.Term("text", t) for t in ("idiot", "the", "clown")]).hits(documents(s, d)), "doc_id").select("doc_id", F.round("score", 6).alias("score"))
)
R.add("parse_escaped", f"with {TOK} select doc_id, round({BM25}, 6) as score from s where term = 'clown'")(lambda s, d: rounded(P.parse(P.escape("clown)(!*")).hits(documents(s, d))))
R.add("parse_extension", f"with {TOK} select distinct doc_id, 1.0::double as score from tf where starts_with(term, 'idio')")(lambda s, d: P.parse('starts:"idio"', extensions={"starts": lambda name, text: Q.Prefix("text", prefix=text)}).hits(documents(s, d)))
R.add("parse_default_and", _any.format("term in ('idiot', 'clown')") + " having count(*) = 2")(lambda s, d: rounded(P.parse("idiot clown", default_and=True).hits(documents(s, d))))
R.add("parse_range_and_fuzzy", f"with {TOK} select distinct doc_id from tok where term >= 'idiot' and term < 'idle' or damerau_levenshtein(term, 'clowm') <= 1")(lambda s, d: P.parse("[idiot TO idle} OR clowm~1").hits(documents(s, d)).select("doc_id"))


@R.add("query_terms", f"select field, term from (values ('text', 'clown'), ('text', 'idiot'), ('text', 'of'), ('text', 'the')) t(field, term)")
def _query_terms(s, d):
    """The terms a visitor sees in a tree; those that must not match aren't among them."""
    q = P.parse('+idiot "of the" (clown OR idiot^2) -moron')
    return s.createDataFrame(sorted(q.terms()), "field string, term string")


# --- similarities ---------------------------------------------------------------------------------------------------

_LAMBDA = "((ttf + 1) / (n + ttf + 1))"
_TFN = {"none": "tf", "H1": "(tf * avgdl / dl)", "H2": "(tf * log2(1 + avgdl / dl))", "H3": "((tf + 800.0 * ((ttf + 1) / (total + 1))) / (dl + 800.0) * 800.0)", "Z": "(tf * pow(avgdl / dl, 0.3))"}
_MODEL = {"G": f"(log2({_LAMBDA} + 1) + {{}} * log2((1 + {_LAMBDA}) / {_LAMBDA}))", "IF": "({} * log2(1 + (n + 1) / (ttf + 0.5)))", "In": "({} * log2((n + 1) / (df + 0.5)))", "Ine": "({} * log2((n + 1) / (n * (1 - pow((n - 1) / n, ttf)) + 0.5)))"}
_EFFECT = {"none": "1.0", "L": "(1 / ({} + 1))", "B": "((ttf + 2) / ((df + 1) * ({} + 1)))"}
_similarities = {}
for _m, _e, _h in itertools.product(_MODEL, _EFFECT, _TFN):
    _similarities[f"dfr_{_m}_{_e}_{_h}".lower()] = (sim.dfr(_m, _e, _h), _MODEL[_m].format(_TFN[_h]) + " * " + _EFFECT[_e].format(_TFN[_h]))
for _d, _l, _h in itertools.product(("LL", "SPL"), ("DF", "TTF"), _TFN):
    _x, _f = ("((df + 1) / (n + 1))" if _l == "DF" else "((ttf + 1) / (n + 1))"), _TFN[_h]
    _similarities[f"ib_{_d}_{_l}_{_h}".lower()] = (sim.ib(_d, _l, _h), f"-ln({_x} / ({_f} + {_x}))" if _d == "LL" else f"-ln((pow({_x}, {_f} / ({_f} + 1)) - {_x}) / (1 - {_x}))")


def _family(s, d, family: str):
    """A family's members in one pass, by name."""
    own = {n: f for n, (f, _) in _similarities.items() if n.startswith(family)}
    return documents(s, d).scored_by("text", F.col("term") == "clown", own, most_terms=1)


for _fam in ("dfr_g", "dfr_if", "dfr_in_", "dfr_ine", "ib_ll", "ib_spl"):
    _sql = " union all ".join(f"select doc_id, '{n}' as similarity, round({x}, 6) as score from s where term = 'clown'" for n, (_, x) in _similarities.items() if n.startswith(_fam))
    R.add(f"similarities_{_fam.strip('_')}", f"with {TOK} {_sql}")(lambda s, d, f=_fam: rounded(_family(s, d, f)))

# --- analysis components ------------------------------------------------------------------------------------------------


def _component(name: str, sql: str, tokenizer, *filters, column: str = "p_name"):
    """Terms of part names and how often: `sql` gives an expression over a word w, or a table of terms."""
    text = sql if sql.startswith("select") else f"select {sql} as term, count(*)::bigint as n from (select unnest(string_split({column}, ' ')) as w from part) where w <> '' group by 1"
    a = analysis.build(tokenizer, filters)
    R.add(f"component_{name}", text)(lambda s, d: table(s, d, "part").select(F.explode(a.tokens(F.col(column))).alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.count("*").alias("n")))


_component("lowercase", "lower(w)", "whitespace", "lowercase", column="p_type")
_component("uppercase", "upper(w)", "whitespace", "uppercase")
_component("truncate", "substring(w, 1, 3)", "whitespace", ("truncate", {"n": 3}))
_component("reverse", "reverse(w)", "whitespace", "reverse_string")
_component("length", "select w as term, count(*)::bigint as n from (select unnest(string_split(p_type, ' ')) as w from part) where length(w) between 4 and 6 group by 1", "whitespace", ("length", {"low": 4, "high": 6}), column="p_type")
_component("trim", "select trim(p_name) as term, count(*)::bigint as n from part group by 1", "keyword", "trim")
_component("pattern_replace", "regexp_replace(w, '[aeiou]+', '_', 'g')", "whitespace", ("pattern_replace", {"pattern": "[aeiou]+", "replacement": "_"}))
_component("pattern_split", "select w as term, count(*)::bigint as n from (select unnest(regexp_split_to_array(p_type, '[AEIOU ]+')) as w from part) where w <> '' group by 1", ("pattern", {"pattern": "[AEIOU ]+"}), column="p_type")
_component("pattern_group", "select w as term, count(*)::bigint as n from (select unnest(regexp_extract_all(p_brand, '#([0-9])', 1)) as w from part) group by 1", ("pattern", {"pattern": "#([0-9])", "group": 1}), column="p_brand")
_component("letter", "select w as term, count(*)::bigint as n from (select unnest(regexp_extract_all(p_brand, '[A-Za-z]+')) as w from part) group by 1", "letter", column="p_brand")
_component("ngram", "select substring(p_brand, i, 3) as term, count(*)::bigint as n from part, unnest(range(1, length(p_brand) - 1)) t(i) group by 1", "keyword", ("ngrams", {"low": 3, "high": 3}), column="p_brand")
_component("stop", "select w as term, count(*)::bigint as n from (select unnest(string_split(p_type, ' ')) as w from part) where w not in ('PROMO', 'LARGE') group by 1", "whitespace", ("stop", {"words": ["PROMO", "LARGE"]}), column="p_type")
_component("keep_words", "select w as term, count(*)::bigint as n from (select unnest(string_split(p_type, ' ')) as w from part) where w in ('PROMO', 'LARGE') group by 1", "whitespace", ("keep_words", {"words": ["PROMO", "LARGE"]}), column="p_type")
_component("limit", "select string_split(p_type, ' ')[1] as term, count(*)::bigint as n from part group by 1", "whitespace", ("limit_count", {"n": 1}), column="p_type")


@R.add("token_attributes", "with w as (select p_partkey, string_split(p_type, ' ') as w from part), t as (select p_partkey, w[i] as term, i - 1 as pos, (length(array_to_string(w[1:i - 1], ' ')) + (i > 1)::int)::int as start from w, unnest(range(1, len(w) + 1)) t(i)) select p_partkey as doc_id, term, pos::int as pos, start, (start + length(term))::int as stop from t")
def _attributes(s, d):
    a = analysis.build("whitespace")
    t = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(a.tokens(F.col("p_type"))).alias("t"))
    return t.select("doc_id", "t.term", "t.pos", F.col("t.start").alias("start"), F.col("t.end").alias("stop"))


@R.add("analyzer_per_field", f"with {TOK} select doc_id from tf where term = 'idiot' intersect select doc_id from documents where source = 'src9'")
def _per_field(s, d):
    own = {"text": T.ascii_words, "source": T.keyword}
    index = store.stored_index(s, f"{d}/documents.parquet", own)
    return Q.Boolean.of(must=[Q.Term("text", "idiot"), Q.Term("source", "src9")]).hits(index).select("doc_id")


# --- scalar functions of maps, JSON, decimals and intervals -------------------------------------------------------------

R.add("map_functions", "select p_partkey as doc_id, p_size + 1 as size, 2::bigint as n from part")(lambda s, d: _parts(s, d).select("doc_id", F.create_map(F.lit("size"), F.col("p_size") + 1, F.lit("key"), F.lit(1)).alias("m")).select("doc_id", F.element_at("m", "size").alias("size"), F.size("m").cast("long").alias("n")))
R.add("json_functions", "select p_partkey as doc_id, p_brand as brand, p_size::int as size from part")(
    lambda s, d: _parts(s, d).select("doc_id", F.to_json(F.struct("p_brand", "p_size")).alias("j")).select("doc_id", F.get_json_object("j", "$.p_brand").alias("brand"), F.from_json("j", "p_size int")["p_size"].alias("size"))
)
R.add("decimal_functions", "select o_orderstatus as status, round(sum(o_totalprice::decimal(18, 2))::double, 2) as total from orders group by 1")(lambda s, d: table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("total")))
R.add("interval_functions", "select o_orderkey as doc_id, strftime(o_orderdate + interval 45 day, '%Y-%m-%d') as due from orders")(lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format(F.col("o_orderdate") + F.expr("interval 45 days"), "yyyy-MM-dd").alias("due")))
R.add("array_functions", "select l_orderkey as doc_id, min(l_linenumber)::int as low, max(l_linenumber)::int as high, count(distinct l_returnflag)::int as kinds from lineitem group by 1")(
    lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list("l_linenumber").alias("v"), F.collect_list("l_returnflag").alias("f")).select("doc_id", F.array_min("v").cast("int").alias("low"), F.array_max("v").cast("int").alias("high"), F.size(F.array_distinct("f")).alias("kinds"))
)
R.add("value_literal", "select p_partkey as doc_id, 'part' as kind from part")(lambda s, d: _parts(s, d).select("doc_id", F.lit("part").alias("kind")))

# --- geometry -------------------------------------------------------------------------------------------------------------

_RECTS = "(select p_partkey as doc_id, p_size as y1, p_size + 4 as y2, p_partkey % 50 as x1, p_partkey % 50 + 6 as x2 from part)"
_IN, _MEET = "y1 >= 20 and y2 <= 30 and x1 >= 10 and x2 <= 30", "y1 <= 30 and y2 >= 20 and x1 <= 30 and x2 >= 10"


@R.add("xy_shape_relation", f"select doc_id, case when {_IN} then 'within' when {_MEET} then 'intersects' else 'disjoint' end as relation from {_RECTS}")
def _xy_shapes(s, d):
    """Shapes kept as text in a shape field, against a polygon."""
    rect = F.format_string("ENVELOPE(%s, %s, %s, %s)", *[F.expr(e).cast("string") for e in ("p_partkey % 50", "p_partkey % 50 + 6", "p_size + 4", "p_size")])
    rows = store.Schema().add("doc_id", "long").add("shape", "shape").conform(table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), rect.alias("shape")))
    return rows.select("doc_id", geo.shape_relation(F.col("shape"), "POLYGON((10 20, 30 20, 30 30, 10 30, 10 20))").alias("relation"))


# --- collectors, grouping and vectors ---------------------------------------------------------------------------------------

R.add("time_limit", "select count(*)::bigint as n from orders")(lambda s, d: C.within_time(table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1.0).alias("score")), 3600.0).agg(F.count("*").alias("n")))
R.add("time_limit_over", "select 0::bigint as n")(lambda s, d: C.within_time(table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1.0).alias("score")), -1.0).agg(F.count("*").alias("n")))
R.add(
    "block_grouping",
    "with g as (select l_orderkey as parent, l_linenumber as doc_id, l_extendedprice as score, max(l_extendedprice) over (partition by l_orderkey) as best, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as place from lineitem), b as (select parent, row_number() over (order by max(best) desc, parent) as rank from g group by 1) select parent, doc_id::bigint as doc_id, round(score, 4) as score, rank::int as rank, place::int as place from g join b using (parent) where rank <= 5 and place <= 2",
)(lambda s, d: G.block_grouped(table(s, d, "lineitem").selectExpr("l_orderkey parent", "cast(l_linenumber as bigint) doc_id", "l_extendedprice score"), "parent", 5, 2).withColumn("score", F.round("score", 4)))
_Q = [0.1] * 64
_KNN = "select vec_id as doc_id, round(1 / (1 + list_sum([(x - 0.1) * (x - 0.1) for x in embedding::double[]])), 6) as score from embeddings order by 1 / (1 + list_sum([(x - 0.1) * (x - 0.1) for x in embedding::double[]])) desc, vec_id limit 10"
R.add("knn_seeded", _KNN)(lambda s, d: rounded(K.seeded(table(s, d, "embeddings"), "embedding", _Q, 10, F.col("vec_id") < 50, key="vec_id")))

@R.add("knn_lists", _KNN)
def _knn_lists(s, d):
    """Exact search over an inverted file."""
    lists = K.Lists.build(table(s, d, "embeddings"), store.scratch_path(s, "lists"), "embedding", "vec_id", 16)
    return rounded(lists.exact(_Q, 10))


# --- stored queries, streams and stores ---------------------------------------------------------------------------------------


def _monitor(**options):
    m = M.Monitor(**options)
    m.register("insult", P.parse("idiot OR clown"))
    m.register("both", P.parse("+idiot +clown"))
    return m


_MATCH = "select distinct doc_id, 'insult' as query from tok where term in ('idiot', 'clown') union all select doc_id, 'both' from tf where term in ('idiot', 'clown') group by 1 having count(*) = 2"
R.add("monitor_weights", f"with {TOK} {_MATCH}")(lambda s, d: _monitor(weight=M.combined_weight(M.length_weight, M.frequency_weight({"idiot": 100, "clown": 10}))).match(table(s, d, "documents")).select("doc_id", "query"))
R.add("monitor_explain", f"with {TOK} select m.doc_id, m.query, a.anchors from ({_MATCH}) m join (values ('insult', 'idiot,clown'), ('both', 'clown')) a(query, anchors) using (query)")(
    lambda s, d: _monitor(weight=M.frequency_weight({"idiot": 100, "clown": 10})).explain(table(s, d, "documents")).select("doc_id", "query", "anchors")
)
R.add("monitor_highlight", f"with {TOK} select doc_id, query, regexp_replace(text, '\\b(idiot|clown)\\b', '<b>\\1</b>', 'gi') as highlighted from ({_MATCH}) join documents using (doc_id)")(lambda s, d: _monitor().highlight(table(s, d, "documents")))
R.add("monitor_decompose", "select 'insult' as query, t as term from (values ('idiot'), ('clown')) x(t) union all select 'both', 'idiot'")(lambda s, d: s.createDataFrame([(n, t) for t, n in _monitor().anchor_table()], "query string, term string"))


def _event_stream(s, d):
    """The events as a stream: the glob makes the one file a folder's only match."""
    src = f"{d}/events.parquet"
    rows = s.readStream.schema(s.read.parquet(src).schema).option("pathGlobFilter", "*.parquet").parquet(f"{src}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need one


def _drained(s, stream, name: str):
    out = streaming.run_complete(stream, store.scratch_path(s, name), store.scratch_path(s, name))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop") if c in out.columns})


R.add("event_stream_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*)::bigint as count, round(sum(value), 4) as total from events group by 1, 2")(lambda s, d: _drained(s, streaming.tumbling(_event_stream(s, d), "ts", "1 hour", "event_type"), "windows").withColumn("total", F.round("total", 4)))
R.add("event_stream_sliding", "select unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as start, count(*)::bigint as count from events group by 1")(lambda s, d: _drained(s, streaming.sliding(_event_stream(s, d), "ts", "2 hours", "1 hour"), "sliding"))
R.add("event_stream_sessions", "with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, max(ts) + interval 30 minute as stop, count(*)::bigint as count from g group by user_id, k")(
    lambda s, d: _drained(s, streaming.sessions(_event_stream(s, d), "ts", "30 minutes", "user_id"), "sessions")
)


def _stored(s, d):
    st = store.IndexStore(s, store.scratch_path(s, "index"))
    st.add(table(s, d, "documents").select("doc_id", "lang", "n_chars", "text"), {"text": T.ascii_words})
    return st


@R.add("index_merge", f"with {TOK} select doc_id, round(sum({BM25}), 6) as score from s where term in ('idiot', 'clown') group by 1")
def _merged(s, d):
    """Two indexes merged into one give the scores of all their documents."""
    docs = table(s, d, "documents").select("doc_id", "text")
    halves = []
    for i in range(2):
        st = store.IndexStore(s, store.scratch_path(s, "index"))
        st.add(docs.where(f"doc_id % 2 = {i}"), {"text": T.ascii_words})
        halves.append(st)
    out = store.IndexStore(s, store.scratch_path(s, "index"))
    out.merge_from(*halves)
    return rounded(Q.Boolean.of(should=[Q.Term("text", "idiot"), Q.Term("text", "clown")]).hits(out.open({"text": T.ascii_words})))


R.add("replicated", "select doc_id, lang from documents")(lambda s, d: store.replicate(_stored(s, d), store.scratch_path(s, "replica")).docs(columns=["lang"]))


@R.add("text_codec", f"with {TOK} select term, count(*)::bigint as df, sum(tf)::bigint as ttf from tf group by 1")
def _text_codec(s, d):
    path = store.scratch_path(s, "export")
    _stored(s, d).export_text(path)
    return s.read.json(path).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))


@R.add("searcher_refresh", "select 1::bigint as step, count(*) filter (doc_id % 2 = 0)::bigint as n from documents union all select 2, count(*) filter (doc_id % 2 = 0) from documents union all select 3, count(*) from documents")
def _refresh(s, d):
    """A searcher keeps its snapshot until it is refreshed; waiting for a version refreshes it."""
    docs = table(s, d, "documents").select("doc_id", "text")
    st = store.IndexStore(s, store.scratch_path(s, "index"))
    st.add(docs.where("doc_id % 2 = 0"), {"text": T.ascii_words})
    manager = streaming.SearcherManager(st, {"text": T.ascii_words})
    first = manager.acquire()
    version = st.add(docs.where("doc_id % 2 = 1"), {"text": T.ascii_words})
    second = manager.acquire()
    manager.wait_for(version, 60)
    counts = [i.docs.agg(F.lit(k).cast("long").alias("step"), F.count("*").alias("n")) for k, i in ((1, first), (2, second), (3, manager.acquire()))]
    return counts[0].union(counts[1]).union(counts[2])


R.add("live_values", "select p_partkey as doc_id, (case when p_partkey % 10 = 0 then p_size + 100 else p_size end)::bigint as value from part where p_partkey % 10 <> 1")(
    lambda s, d: store.live_values(
        _parts(s, d).select("doc_id", F.col("p_size").cast("long").alias("value")),
        _parts(s, d).where("doc_id % 10 < 2").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.col("p_size").cast("long") + 100).alias("value"), (F.col("doc_id") % 10 == 1).alias("deleted")),
    )
)
R.add("memory_index", f"with {TOK} select doc_id, round({BM25}, 6) as score from s where term = 'idiot'")(lambda s, d: rounded(Q.Term("text", "idiot").hits(documents(s, d).in_memory())))

QUERIES, ORACLES = R.queries, R.oracles
