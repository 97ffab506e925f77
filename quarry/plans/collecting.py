"""Sorting, paging, merging, fusion, rescoring and grouping over the star tables and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import collect as C
from ..operators import grouping as G
from ..operators import query as Q
from .base import BM25, TOK, Registry, documents, rounded, table

R = Registry()


def _parts(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey as doc_id", "p_retailprice as score", "p_brand", "p_type", "p_size", "p_name")


_RANK = "row_number() over (order by {}) as rank"


def _ranked(name: str, build, sql: str):
    """An ordered result with its ranks."""

    @R.add(name, sql)
    def run(spark, d):
        out = build(spark, d)
        return out.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.monotonically_increasing_id())).cast("long").alias("rank"), "*")


def _top(order: str, cols: str, limit: int, source: str = "part", where: str = "true", offset: int = 0) -> str:
    return f"select row_number() over (order by {order}) - {offset} as rank, {cols} from {source} where {where} qualify row_number() over (order by {order}) between {offset + 1} and {offset + limit}"


_ranked("top_docs", lambda s, d: C.top(_parts(s, d).select("doc_id", "score"), 25), _top("p_retailprice desc, p_partkey", "p_partkey as doc_id, p_retailprice as score", 25))
_ranked("top_docs_offset", lambda s, d: C.top(_parts(s, d).select("doc_id", "score"), 10, 15), _top("p_retailprice desc, p_partkey", "p_partkey as doc_id, p_retailprice as score", 10, offset=15))
_ranked("sort_fields", lambda s, d: C.sort(_parts(s, d), [C.By("p_brand"), C.By("p_size", reverse=True)], 40).select("doc_id", "p_brand", "p_size"), _top("p_brand, p_size desc, p_partkey", "p_partkey as doc_id, p_brand, p_size", 40))
_NULLED = "(select p_partkey, (case when p_size % 3 = 0 then null else p_size end)::double as v from part)"
for _m, _o in (("last", "v asc nulls last"), ("first", "v asc nulls first")):
    _ranked(f"sort_missing_{_m}", lambda s, d, m=_m: C.sort(_parts(s, d).selectExpr("doc_id", "cast(case when p_size % 3 = 0 then null else p_size end as double) v"), [C.By("v", missing=m)], 900).select("doc_id", "v"), _top(_o + ", p_partkey", "p_partkey as doc_id, v", 900, _NULLED))
_ranked("sort_missing_value", lambda s, d: C.sort(_parts(s, d).selectExpr("doc_id", "cast(case when p_size % 3 = 0 then null else p_size end as double) v"), [C.By("v", reverse=True, missing=20.0)], 900).select("doc_id", "v"), _top("coalesce(v, 20) desc, p_partkey", "p_partkey as doc_id, v", 900, _NULLED))
_ranked("sort_expression", lambda s, d: C.sort(_parts(s, d), [C.By("p_size * 2 - length(p_type)")], 30).select("doc_id"), _top("p_size * 2 - length(p_type), p_partkey", "p_partkey as doc_id", 30))
# Without ranks, which one task would number: the order is that of the result.
R.add("sort_doc_order", "select p_partkey as doc_id from part order by p_partkey")(lambda s, d: C.docs_in_order(_parts(s, d).select("doc_id")))
_ranked("sort_feature", lambda s, d: C.sort(_parts(s, d).withColumn("features", F.create_map(F.lit("size"), "p_size")), [C.By(F.col("features")["size"], reverse=True)], 20).select("doc_id"), _top("p_size desc, p_partkey", "p_partkey as doc_id", 20))
_ranked("search_after", lambda s, d: C.search_after(_parts(s, d), [C.By("p_brand"), C.By("p_size", reverse=True)], ["Brand#22", 30], 100, 25).select("doc_id", "p_brand", "p_size"), _top("p_brand, p_size desc, p_partkey", "p_partkey as doc_id, p_brand, p_size", 25, where="p_brand > 'Brand#22' or (p_brand = 'Brand#22' and (p_size < 30 or (p_size = 30 and p_partkey > 100)))"))
_ranked("search_after_score", lambda s, d: C.search_after(_parts(s, d).select("doc_id", "score"), [C.SCORE], [1200.0], 10**9, 20), _top("p_retailprice desc, p_partkey", "p_partkey as doc_id, p_retailprice as score", 20, where="p_retailprice < 1200.0 or (p_retailprice = 1200.0 and p_partkey > 1000000000)"))
_ranked("merge_top_docs", lambda s, d: C.merge([C.top(_parts(s, d).select("doc_id", "score").where(f"doc_id % 3 = {i}"), 30) for i in range(3)], 30), _top("p_retailprice desc, p_partkey % 3, p_partkey", "p_partkey as doc_id, p_retailprice as score, (p_partkey % 3)::int as shard", 30))
_ranked("merge_field_docs", lambda s, d: C.merge([_parts(s, d).select("doc_id", "score", "p_size").where(f"doc_id % 2 = {i}") for i in range(2)], 30, [C.By("p_size")], 5).select("doc_id", "p_size", "shard"), _top("p_size, p_partkey % 2, p_partkey", "p_partkey as doc_id, p_size, (p_partkey % 2)::int as shard", 30, offset=5))
_ranked("sort_multi_value_numeric", lambda s, d: C.sort(_orders_values(s, d).select("doc_id", C.multi_value(F.col("q"), "max").alias("v")), [C.By("v", reverse=True)], 50), "select row_number() over (order by v desc, doc_id) as rank, * from (select l_orderkey as doc_id, max(l_quantity) as v from lineitem group by 1) qualify row_number() over (order by v desc, doc_id) <= 50")
_ranked("sort_multi_value_string", lambda s, d: C.sort(_orders_modes(s, d).select("doc_id", C.multi_value(F.col("m"), "middle_max").alias("v")), [C.By("v")], 50), "select row_number() over (order by v, doc_id) as rank, * from (select l_orderkey as doc_id, list_sort(list(l_returnflag || l_linestatus))[(count(*) // 2) + 1] as v from lineitem group by 1) qualify row_number() over (order by v, doc_id) <= 50")


def _orders_values(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list("l_quantity").alias("q"))


def _orders_modes(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("m"))


_A = f"(select doc_id, score, row_number() over (order by score desc, doc_id) as r from (select doc_id, {BM25} as score from s where term = 'the') qualify r <= 40)"
_B = f"(select doc_id, score, row_number() over (order by score desc, doc_id) as r from (select doc_id, {BM25} as score from s where term = 'idiot') qualify r <= 40)"


@R.add("rank_fusion", f"with {TOK} select doc_id, round(sum(1.0 / (60 + r)), 6) as score from (select doc_id, r from {_A} union all select doc_id, r from {_B}) group by doc_id")
def _rrf(spark, d):
    i = documents(spark, d)
    return rounded(C.reciprocal_rank_fusion([C.top(Q.Term("text", t).hits(i), 40) for t in ("the", "idiot")]))


@R.add("rescore_query", f"with {TOK} select a.doc_id, round(a.score + coalesce(2 * b.score, 0), 6) as score from {_A} a left join (select doc_id, {BM25} as score from s where term = 'idiot') b using (doc_id)")
def _rescore(spark, d):
    i = documents(spark, d)
    return rounded(C.rescore(Q.Term("text", "the").hits(i), 40, Q.Term("text", "idiot").hits(i), lambda a, b: a + 2 * b))


@R.add("rescore_sort", f"with {TOK} select doc_id, round(score, 6) as score from {_A} join documents using (doc_id) order by n_chars desc, doc_id limit 10")
def _rescore_sort(spark, d):
    i = documents(spark, d)
    return rounded(C.rescore_sort(Q.Term("text", "the").hits(i), 40, i.docs, [C.By("n_chars", reverse=True)], 10))


@R.add("rescore_expression", f"with {TOK} select doc_id, round(score * ln(n_chars), 6) as score from {_A} join documents using (doc_id) order by score * ln(n_chars) desc, doc_id limit 10")
def _rescore_expr(spark, d):
    i = documents(spark, d)
    return rounded(C.rescore_expression(Q.Term("text", "the").hits(i), 40, i.docs, "score * ln(n_chars)", 10))


_BEST = "list_max([list_dot_product(x, {0}) for x in vs])"


@R.add("late_interaction", f"with v as (select vec_id // 4 as doc_id, list(embedding::double[]) as vs from embeddings group by 1), q as (select a.embedding::double[] as qa, b.embedding::double[] as qb from embeddings a, embeddings b where a.vec_id = 3 and b.vec_id = 9) select doc_id, round({_BEST.format('qa')} + {_BEST.format('qb')}, 6) as score from v, q")
def _late(spark, d):
    e = table(spark, d, "embeddings")
    q = [[float(x) for x in r["embedding"]] for r in e.where("vec_id in (3, 9)").orderBy("vec_id").collect()]
    docs = e.groupBy(F.floor(F.col("vec_id") / 4).cast("long").alias("doc_id")).agg(F.collect_list("embedding").alias("vs"))
    return docs.select("doc_id", F.round(C.sum_max_similarity(q, F.col("vs")), 6).alias("score"))


@R.add("positive_scores", "select c_custkey as doc_id, c_acctbal as score from customer where c_acctbal > 0")
def _positive(spark, d):
    return C.positive(table(spark, d, "customer").selectExpr("c_custkey doc_id", "c_acctbal score"))


@R.add("total_hits", "select count(*)::bigint as value, 'EQUAL_TO' as relation from part where p_size > 25")
def _total(spark, d):
    return C.total_hits(_parts(spark, d).where("p_size > 25"))


@R.add("multi_collector", "select count(*)::bigint as n, max(p_retailprice) as best, count(distinct p_brand)::bigint as brands from part where p_size > 25")
def _several(spark, d):
    return C.several(_parts(spark, d).where("p_size > 25"), n=F.count("*"), best=F.max("score"), brands=F.count_distinct("p_brand"))


@R.add("early_termination", "select 100::bigint as hits")
def _early(spark, d):
    return C.early(_parts(spark, d), 100).agg(F.count("*").alias("hits"))


# --- grouping --------------------------------------------------------------------------------------

_HEADS = "(select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as place from part)"
_GROUPS = f"(select p_brand, row_number() over (order by p_retailprice desc, p_partkey) as rank from {_HEADS} where place = 1)"
R.add("grouping_first_pass", f"select * from {_GROUPS} where rank <= 7")(lambda s, d: G.first_pass(_parts(s, d), "p_brand", 7).withColumn("rank", F.col("rank").cast("long")))
R.add("grouping", f"select h.p_brand, g.rank, h.place, h.p_partkey as doc_id from {_HEADS} h join {_GROUPS} g using (p_brand) where g.rank <= 7 and h.place <= 3")(lambda s, d: G.grouped(_parts(s, d), "p_brand", 7, 3).select("p_brand", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"), "doc_id"))
R.add("grouping_offsets", f"select h.p_brand, h.p_partkey as doc_id from {_HEADS} h join {_GROUPS} g using (p_brand) where g.rank between 3 and 6 and h.place between 2 and 4")(lambda s, d: G.grouped(_parts(s, d), "p_brand", 4, 3, offset=2, doc_offset=1).select("p_brand", "doc_id"))
R.add("grouping_within_sort", "select p_brand, p_partkey as doc_id from (select *, row_number() over (partition by p_brand order by p_size, p_partkey) as place from part) where place <= 2 and p_brand in (select p_brand from (select p_brand, min(p_retailprice) from part group by 1 order by 2, 1 limit 100))")(lambda s, d: G.grouped(_parts(s, d), "p_brand", 100, 2, within=[C.By("p_size")]).select("p_brand", "doc_id"))
R.add("group_heads", f"select p_brand, p_partkey as doc_id from {_HEADS} where place = 1")(lambda s, d: G.group_heads(_parts(s, d), "p_brand").select("p_brand", "doc_id"))
R.add("all_groups", "select distinct p_brand from part")(lambda s, d: G.all_groups(_parts(s, d), "p_brand"))
R.add("group_count", "select count(distinct p_brand)::bigint as groups from part")(lambda s, d: G.group_count(_parts(s, d), "p_brand"))
R.add("group_distinct_values", "select p_brand, array_to_string(list_sort(list(distinct p_size))[1:5], ',') as sizes from part group by 1")(lambda s, d: G.distinct_values(_parts(s, d), "p_brand", "p_size", 5).select("p_brand", F.array_join(F.col("values").cast("array<string>"), ",").alias("sizes")))
R.add("group_facets", "select p_size, count(distinct p_brand)::bigint as groups from part group by 1")(lambda s, d: G.group_facets(_parts(s, d), "p_brand", "p_size"))
R.add("group_reduce", "select p_brand, sum(p_size)::bigint as total, max(p_retailprice) as best from part group by 1")(lambda s, d: G.reduce(_parts(s, d), "p_brand", total=F.sum("p_size"), best=F.max("score")))
R.add("group_reduce_pandas", "select p_brand, (max(p_size) - min(p_size))::bigint as spread from part group by 1")(lambda s, d: G.reduce_in_pandas(_parts(s, d).select("p_brand", "p_size"), "p_brand", _spread, "p_brand string, spread long"))
R.add("group_long_range", "select case when p_size < 10 then 5.0 when p_size >= 40 then 40.0 else floor((p_size - 10) / 5) * 5 + 10 end as start, count(*)::bigint as n from part group by 1")(lambda s, d: _parts(s, d).groupBy(G.range_group(F.col("p_size"), 5, 10, 40).cast("double").alias("start")).agg(F.count("*").alias("n")))
R.add("group_double_range", "select case when p_retailprice >= 900 and p_retailprice < 1100 then 'low' when p_retailprice >= 1000 and p_retailprice < 1500 then 'mid' else null end as label, count(*)::bigint as n from part group by 1")(lambda s, d: _parts(s, d).groupBy(G.first_range(F.col("score"), [("low", 900, 1100), ("mid", 1000, 1500)]).alias("label")).agg(F.count("*").alias("n")))
R.add("group_value_source", "select p_size % 7 as g, max(p_retailprice) as best from part group by 1")(lambda s, d: _parts(s, d).groupBy((F.col("p_size") % 7).alias("g")).agg(F.max("score").alias("best")))
R.add("diversified_top", "select p_partkey as doc_id from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part) where r <= 2 order by p_retailprice desc, p_partkey limit 15")(lambda s, d: G.diversified(_parts(s, d), "p_brand", 2, 15).select("doc_id"))
R.add("merge_groups", "select p_brand, max(p_retailprice) as score, count(*)::bigint as hits from part group by 1 order by score desc, p_brand limit 6")(lambda s, d: G.merge_groups([_parts(s, d).where(f"doc_id % 2 = {i}").groupBy("p_brand").agg(F.max("score").alias("score"), F.count("*").alias("hits")) for i in range(2)], "p_brand", 6))
R.add("window_functions", "select p_partkey as doc_id, sum(p_size) over (partition by p_brand order by p_partkey rows between 2 preceding and current row)::bigint as s, lag(p_size) over (partition by p_brand order by p_partkey) ::double as before from part")(lambda s, d: _windows(_parts(s, d)))


def _spread(pdf):
    import pandas as pd

    return pd.DataFrame({"p_brand": [pdf["p_brand"].iloc[0]], "spread": [int(pdf["p_size"].max() - pdf["p_size"].min())]})


def _windows(parts):
    w = Window.partitionBy("p_brand").orderBy("doc_id")
    return parts.select("doc_id", F.sum("p_size").over(w.rowsBetween(-2, 0)).alias("s"), F.lag("p_size").over(w).cast("double").alias("before"))


QUERIES, ORACLES = R.queries, R.oracles
