"""Multi-valued columns, token graphs, further classifiers, live documents and other operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as K
from ..operators import facets as X
from ..operators import intervals as I
from ..operators import query as Q
from ..operators import spans as S
from ..operators.index import Index
from ..sources import store
from .base import BM25, TOK, Registry, documents, rounded, table

R = Registry()


def _orders(s, d) -> Index:
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("numbers"), F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("flags"))
    return Index(rows, {})


_ALL = "(select l_orderkey as doc_id, list(l_linenumber) as numbers, list(distinct l_returnflag || l_linestatus) as flags from lineitem group by 1)"
R.add("sorted_numeric_range", f"select doc_id, 1.0::double as score from {_ALL} where len([x for x in numbers if x between 6 and 9]) > 0")(lambda s, d: Q.Range("numbers", 6, 9, multi_valued=True).hits(_orders(s, d)))
R.add("sorted_numeric_set", f"select doc_id, 1.0::double as score from {_ALL} where len([x for x in numbers if x in (5, 7)]) > 0")(lambda s, d: Q.PointSet("numbers", (5, 7), True).hits(_orders(s, d)))
R.add("sorted_set_range", f"select doc_id, 1.0::double as score from {_ALL} where len([x for x in flags if x >= 'A' and x < 'O']) > 0")(lambda s, d: Q.Range("flags", "A", "O", include_high=False, multi_valued=True).hits(_orders(s, d)))
R.add("sorted_set_set", f"select doc_id, 1.0::double as score from {_ALL} where len([x for x in flags if x in ('RF', 'NF')]) > 0")(lambda s, d: Q.PointSet("flags", ("RF", "NF"), True).hits(_orders(s, d)))
R.add("term_automaton", f"with {TOK} select a.doc_id, count(distinct a.pos)::double as score from tok a join tok b using (doc_id) where a.term = 'of' and ((b.term in ('the', 'a') and b.pos = a.pos + 1) or (b.term = 'the' and b.pos = a.pos + 2)) group by 1")(
    lambda s, d: S.TermAutomaton("text", ((0, "of", 1), (1, "the", 2), (1, "a", 2), (1, None, 3), (3, "the", 2)), (2,)).hits(documents(s, d))
)
R.add("interval_fix_field", f"with {TOK} select distinct tf.doc_id from tf join documents using (doc_id) where term = 'idiot' and lang = 'en'")(lambda s, d: I.Intervals("text", I.overlapping(I.Extend(I.Term("idiot"), 10**6, 10**6), I.FixField("lang", I.Term("en")))).hits(Index(table(s, d, "documents"), {"text": T.ascii_words, "lang": T.keyword})).select("doc_id"))
R.add("interval_payload", f"with {TOK} select doc_id, round(tf / (tf + 1), 6) as score from tf where term = 'idiot' and doc_id % 2 = 0")(lambda s, d: rounded(I.Intervals("text", I.PayloadTerm("idiot", lambda p: p == "0")).hits(_payloads(s, d))))
R.add("span_payload", f"with {TOK} select doc_id, count(*)::bigint as n from tok where term = 'idiot' and pos % 3 = 1 group by 1")(lambda s, d: _span_payload(s, d))
R.add("live_docs", "select count(*)::bigint as n from documents where doc_id % 9 <> 4")(lambda s, d: table(s, d, "documents").withColumn("_deleted", F.col("doc_id") % 9 == 4).where("not _deleted").agg(F.count("*").alias("n")))
R.add("fuzzy_like_this")(lambda s, d: rounded(Q.FuzzyLikeThis("text", ("stupit", "clowm"), 1).hits(documents(s, d))))
R.add("classify_knn_fuzzy")(lambda s, d: K.knn_fuzzy(_labelled(s, d), "text", "toxic", ("idiot", "stupit"), 10))
_LTOK = TOK.replace("from documents)", "from documents join labels using (doc_id))", 1)
R.add("classify_knn_document", f"with {_LTOK}, h as (select doc_id, sum({BM25}) as score from s where term in ('idiot', 'clown', 'moron') group by 1), t as (select h.score, toxic from h join labels using (doc_id) order by h.score desc, doc_id limit 10) select toxic as class, round(count(*) * avg(score / (select max(score) from t)) / 10, 6) as score from t group by 1")(
    # the field's boost cancels out
    lambda s, d: K.knn_document(_labelled(s, d), {"text": (("idiot", "clown", "moron"), 2.0)}, "toxic", 10).withColumn("score", F.round("score", 6))
)
R.add("classify_bm25_bayes", f"with {_LTOK}, c as (select toxic as class, ln(count(*) / (select count(*)::double from documents join labels using (doc_id))) as prior from documents join labels using (doc_id) group by 1), b as (select toxic as class, term, max({BM25}) as m from s join labels using (doc_id) where term in ('idiot', 'clown') group by 1, 2) select class, round(any_value(prior) + sum(ln(greatest(coalesce(m, 0), 1e-6))), 6) as score from c cross join (values ('idiot'), ('clown')) w(term) left join b using (class, term) group by class")(
    lambda s, d: K.bm25_bayes(_labelled(s, d), "text", "toxic", ["idiot", "clown"]).withColumn("score", F.round("score", 6))
)
R.add("classify_evaluation", "with m as (select toxic as a, (quality = 0)::int as p, count(*)::double as c from labels group by 1, 2) select a as class, round(sum(c) filter (a = p) / (select sum(c) from m x where x.p = m.a), 6) as precision, round(sum(c) filter (a = p) / sum(c), 6) as recall from m group by a")(
    lambda s, d: K.evaluation(K.confusion(table(s, d, "labels").withColumn("p", (F.col("quality") == 0).cast("int")), "toxic", "p")).select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
)
R.add("drill_down_repeated", "select 0::bigint as n")(lambda s, d: X.drill_down(table(s, d, "part"), [("p_brand", ["Brand#11", "Brand#22"])], any_of=False).agg(F.count("*").alias("n")))
R.add("index_sorted", "select p_partkey as doc_id from part where p_size between 10 and 12")(lambda s, d: table(s, d, "part").withColumnRenamed("p_partkey", "doc_id").repartitionByRange("p_size").sortWithinPartitions("p_size").where("p_size between 10 and 12").select("doc_id"))
R.add("feature_field", "select p_partkey, (floor(f / pow(2, floor(log2(f)) - 8)) * pow(2, floor(log2(f)) - 8))::float as feature from (select p_partkey, p_retailprice::float::double as f from part)")(lambda s, d: table(s, d, "part").select("p_partkey", store.truncated_feature(F.col("p_retailprice").cast("float")).alias("feature")))
R.add("facet_time_histogram", "select strftime(ts, '%Y-%m-%d') as day, count(*)::bigint as n from events group by 1")(lambda s, d: table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")))


def _labelled(s, d) -> Index:
    return Index.of(table(s, d, "documents").join(table(s, d, "labels"), "doc_id"), "text")


def _payloads(s, d) -> Index:
    """Every token carries the parity of its document's id."""
    docs = table(s, d, "documents")

    def analyzer(c):
        return F.transform(T.ascii_words(c), lambda t: F.concat(t, F.lit("|"), (F.col("doc_id") % 2).cast("string")))

    return Index(docs, {"text": analyzer})


def _span_payload(s, d):
    i = documents(s, d)
    payloads = i.tokens("text").where("term = 'idiot'").select("doc_id", "pos", (F.col("pos") % 3).alias("payload"))
    out = S.SpanPayload(S.SpanTerm("text", "idiot"), payloads, lambda p: p == 1).spans(i)
    return out.select("doc_id", F.size("spans").cast("long").alias("n"))


QUERIES, ORACLES = R.queries, R.oracles
