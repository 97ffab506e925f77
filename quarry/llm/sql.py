"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as t from documents
), sh as (
  select doc_id, unnest(list_distinct(case when len(t) = 0 then []::varchar[] when len(t) < 4 then [array_to_string(t, ' ')] else [array_to_string(t[i:i + 3], ' ') for i in range(1, len(t) - 2)] end)) as g from w
), n as (
  select doc_id, count(*) as n from sh group by 1
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), reach as (
  select doc_id as a, doc_id as root from documents
  union
  select links.b, reach.root from reach join links on links.a = reach.a
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, r.root as component_id
from documents d left join n using (doc_id) join (select a, min(root) as root from reach group by 1) r on r.a = d.doc_id
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATE = rf"""
with d as (
  select doc_id, regexp_extract_all({_LOWER}, {_WORDS}) as t from documents
), b as (
  select item_id, regexp_extract_all({_LOWER}, {_WORDS}) as t from benchmark
), win as (
  select distinct item_id, least(8, len(t)) as s, unnest([array_to_string(t[i:i + least(8, len(t)) - 1], ' ') for i in range(1, len(t) - least(8, len(t)) + 2)]) as g from b where len(t) > 0
), place as (
  select doc_id, s, unnest(range(1, len(t) - s + 2)) as i, t from d, (select distinct s from win)
), found as (
  select doc_id, place.s, i, item_id from place join win on win.s = place.s and win.g = array_to_string(t[i:i + place.s - 1], ' ')
), items as (
  select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from found group by 1
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + s)) as p from found) group by 1
)
select d.doc_id, len(d.t)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join items using (doc_id) left join hit using (doc_id)
"""
