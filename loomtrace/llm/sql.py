"""DuckDB SQL for the operators' queries that SQL can express on whole tables."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, array_to_string(w[i:i+9], ' ') as k, least(len(w), 10) as n
       from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select rid, i, n, array_to_string(w[i:i+n-1], ' ') as k
       from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
h as (select rid, i, n, item_id from dw join bw using (k, n)),
hw as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(i, i + n)) as p from h) group by rid),
hi as (select rid, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct rid, cast(item_id as varchar) as x from h) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (rid) left join hi using (rid)
"""

OP3 = """
with d as (select row_number() over (order by doc_id nulls first, text) as rid, doc_id, encode(coalesce(text, '')) as b from documents),
s as (select rid, i, b[i:i+99] as x from (select rid, b, unnest(range(1, octet_length(b) - 98)) as i from d where octet_length(b) >= 100)),
r as (select rid, i from (select rid, i, row_number() over (partition by x order by rid, i) as k from s) where k > 1),
g as (select rid, i, sum(case when i <= p + 100 then 0 else 1 end) over (partition by rid order by i) as island
      from (select rid, i, lag(i, 1, -1000) over (partition by rid order by i) as p from r)),
spans as (select rid, min(i) as a, max(i) + 99 as z from g group by rid, island),
parts as (select rid, a, z, lag(z, 1, 0) over (partition by rid order by a) as before from spans),
kept as (select rid, string_agg(hex(b[before + 1 : a - 1]), '' order by a) || hex(any_value(b)[max(z) + 1 : octet_length(any_value(b))]) as h,
                sum(z - a + 1) as n, count(*) as spans from parts join d using (rid) group by rid)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
       case when n is null then sha256(b) else sha256(unhex(h)) end as kept_sha256
from d left join kept using (rid)
"""

OP7 = """
with p as (select page_id, coalesce(html, '') as h, cast(strlen(coalesce(html, '')) as bigint) as n from pages),
t as (select *, max(page_id) over (partition by h) as top from p)
select page_id, n as payload_bytes, sha1(h) as payload_digest,
       case when n >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> top then top end as refers_to
from t
"""

OP9 = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as x,
         embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0 as ok
  from embeddings),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.ok and b.ok and a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.9),
reach as (select vec_id as a, vec_id as b from v union select reach.a, links.b from reach join links on reach.b = links.a),
component as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from component left join (select a as vec_id, count(*) as n from links group by a) using (vec_id)
"""
