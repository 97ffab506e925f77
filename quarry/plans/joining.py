"""Query-time and parent/child joins over orders, line items, customers and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .base import Registry, table

R = Registry()


def _orders(s, d):
    return table(s, d, "orders")


def _items(s, d):
    return table(s, d, "lineitem").withColumn("score", F.col("l_quantity"))


R.add("join_query", "select c_custkey as doc_id, 1.0::double as score from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")(lambda s, d: J.join_query(_orders(s, d).where("o_totalprice > 200000"), "o_custkey", table(s, d, "customer"), "c_custkey", "c_custkey"))
_AGG = {"none": "1.0::double", "avg": "avg(o_totalprice)", "max": "max(o_totalprice)", "total": "sum(o_totalprice)", "min": "min(o_totalprice)"}
for _m, _f in _AGG.items():
    R.add(f"join_query_score_{_m}", f"select c_custkey as doc_id, round(v, 6) as score from customer join (select o_custkey, {_f} as v from orders where o_totalprice > 150000 group by 1) on c_custkey = o_custkey")(
        lambda s, d, m=_m: J.join_query_scored(_orders(s, d).where("o_totalprice > 150000").withColumn("score", F.col("o_totalprice")), "o_custkey", table(s, d, "customer"), "c_custkey", m, "c_custkey").withColumn("score", F.round("score", 6))
    )
    R.add(f"block_join_to_parent_{_m}", f"select o_orderkey as doc_id, round(v, 6) as score from orders join (select l_orderkey, {_f.replace('o_totalprice', 'l_quantity')} as v from lineitem where l_discount > 0.05 group by 1) on o_orderkey = l_orderkey")(
        lambda s, d, m=_m: J.to_parents(_items(s, d).where("l_discount > 0.05"), "l_orderkey", _orders(s, d), "o_orderkey", m).withColumn("score", F.round("score", 6))
    )
R.add("join_min_max_matches", "select c_custkey as doc_id, v as score from customer join (select o_custkey, max(o_totalprice) as v from orders group by 1 having count(*) between 5 and 10) on c_custkey = o_custkey")(lambda s, d: J.join_query_scored(_orders(s, d).withColumn("score", F.col("o_totalprice")), "o_custkey", table(s, d, "customer"), "c_custkey", "max", "c_custkey", 5, 10))
R.add("join_point", "select s_suppkey as doc_id, v as score from supplier join (select l_suppkey, max(l_quantity) as v from lineitem where l_returnflag = 'R' group by 1) on s_suppkey = l_suppkey")(lambda s, d: J.join_query_scored(_items(s, d).where("l_returnflag = 'R'"), "l_suppkey", table(s, d, "supplier"), "s_suppkey", "max", "s_suppkey"))
R.add("join_multi_valued", "select p_partkey as doc_id, 1.0::double as score from part where p_partkey in (select l_partkey from lineitem)")(lambda s, d: J.join_query(table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts")), "parts", table(s, d, "part"), "p_partkey", "p_partkey", True))
R.add("block_join_to_child", "select l_orderkey, l_linenumber, o_totalprice as score from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' and o_totalprice > 200000")(lambda s, d: J.to_children(_orders(s, d).where("o_orderstatus = 'F' and o_totalprice > 200000").withColumn("score", F.col("o_totalprice")), "o_orderkey", table(s, d, "lineitem"), "l_orderkey", ["l_orderkey", "l_linenumber"]))
R.add("children_of_one", "select l_orderkey, l_linenumber from lineitem where l_orderkey = 7")(lambda s, d: J.children_of(table(s, d, "lineitem"), "l_orderkey", 7).select("l_orderkey", "l_linenumber"))
R.add("children_of_several", "select l_orderkey, l_linenumber from lineitem where l_orderkey in (1, 2, 3, 4)")(lambda s, d: J.children_of(table(s, d, "lineitem"), "l_orderkey", 1, 2, 3, 4).select("l_orderkey", "l_linenumber"))
R.add("children_of_hits", "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")(lambda s, d: J.children_of_hits(table(s, d, "lineitem"), "l_orderkey", _orders(s, d).where("o_orderpriority = '1-URGENT'"), "o_orderkey").select("l_orderkey", "l_linenumber"))
for _m, _f in {"min": "min(l_linenumber)", "max": "max(l_linenumber)", "sum": "sum(l_linenumber)::bigint", "avg": "trunc(sum(l_linenumber) / count(*))::bigint"}.items():
    R.add(f"block_join_selector_{_m}", f"select l_orderkey as parent, {_f} as value from lineitem group by 1")(lambda s, d, m=_m: J.select_child_value(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", m, True))
R.add("block_join_sort", "select o_orderkey as doc_id, v as value from orders left join (select l_orderkey, min(l_quantity) as v from lineitem where l_quantity > 40 group by 1) on o_orderkey = l_orderkey")(lambda s, d: J.sort_parents(_orders(s, d), "o_orderkey", table(s, d, "lineitem").where("l_quantity > 40"), "l_orderkey", "l_quantity", "min"))
R.add("block_join_collect", "select l_orderkey as parent, string_agg(l_linenumber::varchar, ',' order by l_quantity desc, l_linenumber) as children from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) as r from lineitem) where r <= 3 group by 1")(lambda s, d: J.collect_children(_items(s, d), "l_orderkey", "l_linenumber", 3).select("parent", F.array_join(F.transform("hits", lambda h: h["doc_id"].cast("string")), ",").alias("children")))
R.add("block_join_integrity", "select 'child without parent' as problem, count(*)::bigint as count from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 2 = 0)")(lambda s, d: J.check_integrity(table(s, d, "lineitem"), "l_orderkey", _orders(s, d).where("o_orderkey % 2 = 0"), "o_orderkey"))
R.add("block_join_conversations", "select conv_id as doc_id, count(*)::double as score from conversations where role = 'assistant' and conv_id in (select conv_id from conversations where turn = 0) group by 1")(lambda s, d: J.to_parents(table(s, d, "conversations").where("role = 'assistant'").withColumn("score", F.lit(1.0)), "conv_id", table(s, d, "conversations").where("turn = 0"), "conv_id", "total"))

QUERIES, ORACLES = R.queries, R.oracles
