"""The driver's queries over its tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.bindings import bound
from loomtrace.engine import Engine

_W = "with w as (select *, user_id || '|' || cast(cast(ts as date) as varchar) as tr, cast(ts as date) as d from events)"
_SEQ = _W + ", s as (select tr, min(user_id) u, min(d) dd, string_agg(event_type, ',' order by ts, event_id) v, count(*) n, sum(value) total from w group by tr)"
_RANKS = """, r as (select *, row_number() over (partition by tr order by ts, event_id) re from w),
 h as (select tr, row_number() over (order by user_id, d) rt from r where re = 1)"""

#: name -> (binding, query, output columns or None to keep those of the query, SQL). Doubles are rounded to 4 digits.
SPECS: dict[str, tuple[str, str, str, str]] = {
    "project_event": ("web", "select e:name, e:total", "name total", "select event_type as name, round(value, 4) as total from events"),
    "project_literal": ("web", "select [e:k], [e:concept:name]", "k name", "select round(cast(json_extract_string(props, '$.k') as double), 4) as k, event_type as name from events"),
    "project_constant": ("web", "select e:name, 5, 'x'", "name five x", "select event_type as name, 5.0::double as five, 'x' as x from events"),
    "select_scope": ("web", "select t:* where t:name = '8|2024-01-01'", "name user_id day", _W + " select tr as name, user_id, cast(d as varchar) as day from w where tr = '8|2024-01-01' limit 1"),
    "filter_eq": ("web", "select e:name, e:total where e:name = 'click'", "name total", "select event_type as name, round(value, 4) as total from events where event_type = 'click'"),
    "filter_neq": ("web", "select e:name, e:total where e:name != 'click'", "name total", "select event_type as name, round(value, 4) as total from events where event_type <> 'click'"),
    "filter_range": ("web", "select e:name, e:total where e:total > 10 and e:total <= 50", "name total", "select event_type as name, round(value, 4) as total from events where value > 10 and value <= 50"),
    "filter_number_text": ("web", "select e:name, [e:k] where [e:k] = '42'", "name k", "select event_type as name, 42.0::double as k from events where cast(json_extract_string(props, '$.k') as double) = 42"),
    "filter_in": ("web", "select e:name, e:total where e:name in ('click', view)", "name total", "select event_type as name, round(value, 4) as total from events where event_type in ('click', 'view')"),
    "filter_in_number": ("web", "select e:name, [e:k] where [e:k] in (1, 2, '3')", "name k", "select event_type as name, cast(json_extract_string(props, '$.k') as double) as k from events where cast(json_extract_string(props, '$.k') as double) in (1, 2, 3)"),
    "filter_not_in": ("web", "select e:name, e:total where e:name not in ('click', 'view')", "name total", "select event_type as name, round(value, 4) as total from events where event_type not in ('click', 'view')"),
    "filter_like": ("web", "select e:name, e:total where e:name like '%i%'", "name total", "select event_type as name, round(value, 4) as total from events where event_type like '%i%'"),
    "filter_like_unanchored": ("web", "select e:name, e:total where e:name like 'i%k'", "name total", "select event_type as name, round(value, 4) as total from events where event_type like '%i%k%'"),
    "filter_matches": ("web", "select e:name, e:total where e:name matches '^c.*k$'", "name total", "select event_type as name, round(value, 4) as total from events where regexp_matches(event_type, '^c.*k$')"),
    "filter_null": ("web", "select e:name, e:total where e:resource is not null and not (e:total is null)", "name total", "select event_type as name, round(value, 4) as total from events where user_id is not null and value is not null"),
    "filter_null_literal": ("web", "select e:name where e:name = null", "name", "select event_type as name from events where false"),
    "filter_bool": ("web", "select e:name, e:total where not (e:name = 'click' or e:total > 50)", "name total", "select event_type as name, round(value, 4) as total from events where not (event_type = 'click' or value > 50)"),
    "filter_false": ("web", "select e:name where 0=1 or not (1=1)", "name", "select event_type as name from events where false"),
    "filter_true": ("web", "select e:name where 'a'='a' and e:total > 100", "name", "select event_type as name from events where value > 100"),
    "filter_expr": ("web", "select e:name, e:total where hour(e:timestamp) = 3", "name total", "select event_type as name, round(value, 4) as total from events where hour(ts) = 3"),
    "filter_columns": ("web", "select e:name, e:total where e:total > [e:k] * 2", "name total", "select event_type as name, round(value, 4) as total from events where value > cast(json_extract_string(props, '$.k') as double) * 2"),
    "filter_time": ("web", "select e:name, e:total where e:timestamp >= '2024-01-10T00:00:00.000+00:00' and e:timestamp < D2024-01-20T12:00", "name total", "select event_type as name, round(value, 4) as total from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20 12:00:00'"),
    "filter_classifier": ("web", "select e:name where [e:c:Event Name] = 'click'", "name", "select event_type as name from events where event_type = 'click'"),
    "semi_trace": ("web", "select e:name, e:total where t:name = '8|2024-01-01'", "name total", _W + " select event_type as name, round(value, 4) as total from w where tr = '8|2024-01-01'"),
    "semi_log": ("sales", "select e:id where l:name = 'O' and t:custkey < 100", "id", "select o_orderkey as id from orders where o_orderstatus = 'O' and o_custkey < 100"),
    "semi_up": ("web", "select t:name where e:name = 'error' and e:total > 100", "name", _W + " select distinct tr as name from w where event_type = 'error' and value > 100"),
    "semi_up_log": ("sales", "select l:name where e:total > 400000", "name", "select distinct o_orderstatus as name from orders where o_totalprice > 400000"),
    "join_parent": ("web", "select e:name, t:name, l:name", "name trace log", _W + " select event_type as name, tr as trace, 'web' as log from w"),
    "mixed_or": ("web", "select e:name, e:total where t:name = '8|2024-01-01' or e:name = 'error'", "name total", _W + " select event_type as name, round(value, 4) as total from w where tr = '8|2024-01-01' or event_type = 'error'"),
    "collection_trace": ("web", "select t:name, [t:user]", "name user_id", _W + " select distinct tr as name, user_id from w"),
    "scope_inference": ("web", "select name, t:name where t:user = 8", "name trace", _W + " select distinct tr as name, tr as trace from w where user_id = 8"),
    "agg_global": ("web", "select count(e:name), sum(e:total), avg(e:total), min(e:total), max(e:total)", "n total mean low high rows", "select count(event_type) as n, round(sum(value), 4) as total, round(avg(value), 4) as mean, round(min(value), 4) as low, round(max(value), 4) as high, count(*) as rows from events"),
    "agg_text": ("web", "select min(e:name), max(e:name)", "low high rows", "select min(event_type) as low, max(event_type) as high, count(*) as rows from events"),
    "agg_hoist": ("web", "select avg(^^e:total), count(^^e:name)", "mean n rows", "select round(avg(value), 4) as mean, count(event_type) as n, count(*) as rows from events"),
    "agg_empty": ("web", "select count(e:name) where e:name = 'nothing'", "n rows", "select cast(null as bigint) as n, cast(0 as bigint) as rows"),
    "agg_count_distinct": ("web", "select count(t:name), count(l:name), count(e:name)", "traces logs events rows", _W + " select count(distinct tr) as traces, cast(1 as bigint) as logs, count(*) as events, count(*) as rows from w"),
    "agg_parent_weighted": ("web", "select avg(t:user), count(e:name)", "mean n rows", "select round(avg(user_id), 4) as mean, count(*) as n, count(*) as rows from events"),
    "agg_first": ("web", "select t:name, count(e:name)", "trace n rows", _W + " select (select tr from w order by user_id, d, ts, event_id limit 1) as trace, count(*) as n, count(*) as rows from w"),
    "group_flat": ("web", "select e:name, count(e:name), avg(e:total), max(e:total) group by e:name", "name n mean high rows", "select event_type as name, count(*) as n, round(avg(value), 4) as mean, round(max(value), 4) as high, count(*) as rows from events group by 1"),
    "group_auto_keys": ("web", "select t:name, e:name, count(e:name) group by e:name", "trace name n rows", _W + " select tr as trace, event_type as name, count(*) as n, count(*) as rows from w group by 1, 2"),
    "group_hoist2": ("web", "select sum(e:total) group by ^^e:name", "total rows", "select round(sum(value), 4) as total, count(*) as rows from events group by event_type"),
    "group_implicit_order": ("web", "order by avg(e:total) desc", "log trace rows", _W + " select 'web' as log, tr as trace, count(*) as rows from w group by tr"),
    "group_date_diff": ("web", "select t:name, max(e:timestamp) - min(e:timestamp) group by t:name", "trace days rows", _W + " select tr as trace, round((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 86400000.0, 4) as days, count(*) as rows from w group by tr"),
    "group_expr": ("web", "select e:name, sum([e:total*2]), round(avg(e:total)) group by e:name", "name total mean rows", "select event_type as name, round(sum(value * 2), 4) as total, cast(floor(avg(value) + 0.5) as bigint) as mean, count(*) as rows from events group by 1"),
    "group_first_expr": ("web", "select upper(e:name), count(e:name) group by t:name", "name n rows", _W + " select upper(arg_min(event_type, (ts, event_id))) as name, count(*) as n, count(*) as rows from w group by tr"),
    "group_classifier": ("web", "select count(e:name) group by c:Resource", "n rows", "select count(*) as n, count(*) as rows from events group by user_id"),
    "group_order_limit": ("web", "select t:name, sum(e:total) group by t:name order by sum(e:total) desc, t:name limit 10 offset 5", "trace total rows", _W + " select tr as trace, round(sum(value), 4) as total, count(*) as rows from w group by tr order by sum(value) desc, tr limit 10 offset 5"),
    "variants": ("web", "select count(t:name) group by ^e:name", "variant n rows", _SEQ + " select v as variant, count(*) as n, count(*) as rows from s group by v"),
    "variants_sorted": ("web", "select count(t:name) group by ^e:name order by name", "variant n rows", _W + ", s as (select tr, string_agg(event_type, ',' order by event_type) v from w group by tr) select v as variant, count(*) as n, count(*) as rows from s group by v"),
    "variants_sorted_desc": ("web", "select count(t:name) group by ^e:name order by e:total desc", "variant n rows", _W + ", s as (select tr, string_agg(event_type, ',' order by value desc, ts, event_id) v from w group by tr) select v as variant, count(*) as n, count(*) as rows from s group by v"),
    "variants_by_trace": ("web", "select sum(e:total) group by t:name, ^e:name", "variant trace total rows", _SEQ + " select v as variant, tr as trace, round(total, 4) as total, cast(1 as bigint) as rows from s"),
    "variants_aggregates": ("web", "select count(e:name), sum(e:total), min(e:name) group by ^e:name order by count(t:name) desc", "variant n total low rows", _SEQ + ", x as (select s.v, w.value, w.event_type, w.tr from s join w using (tr)) select v as variant, count(*) as n, round(sum(value), 4) as total, min(event_type) as low, count(distinct tr) as rows from x group by v"),
    "variants_users": ("users", "select count(t:name) group by ^e:name", "variant n rows", "with s as (select string_agg(event_type, ',' order by ts, event_id) v from events group by user_id) select v as variant, count(*) as n, count(*) as rows from s group by v"),
    "order_multi": ("web", "select e:name, e:total, e:resource order by e:name desc, e:total, e:timestamp limit 50", "name total resource", "select event_type as name, round(value, 4) as total, cast(user_id as varchar) as resource from events order by event_type desc, value, ts limit 50"),
    "order_expr": ("web", "select e:name, e:total order by round(e:total) desc, e:timestamp limit 40", "name total", "select event_type as name, round(value, 4) as total from events order by floor(value + 0.5) desc, ts limit 40"),
    "order_parent": ("web", "select e:name, t:name order by [t:user] desc, e:timestamp limit 30", "name trace", _W + " select event_type as name, tr as trace from w order by user_id desc, ts limit 30"),
    "topk": ("web", "select e:name, e:total order by e:total desc, e:timestamp limit 20", "name total", "select event_type as name, round(value, 4) as total from events order by value desc, ts limit 20"),
    "limit_offset": ("web", "select e:name, e:total order by e:timestamp limit 10 offset 5", "name total", "select event_type as name, round(value, 4) as total from events order by ts limit 10 offset 5"),
    "limit_event": ("web", "select e:name, t:name limit e:2", "name trace", _W + _RANKS + " select event_type as name, tr as trace from r where re <= 2"),
    "limit_trace": ("web", "select e:name, t:name limit t:7, e:3", "name trace", _W + _RANKS + " select event_type as name, r.tr as trace from r join h using (tr) where re <= 3 and rt <= 7"),
    "limit_ordered": ("web", "select e:name, t:name order by e:total desc, e:timestamp limit t:5, e:2", "name trace", _W + ", r as (select *, row_number() over (partition by tr order by value desc, ts) re from w), h as (select tr, row_number() over (order by value desc, ts) rt from r where re = 1) select event_type as name, r.tr as trace from r join h using (tr) where re <= 2 and rt <= 5"),
    "limit_log": ("sales", "select e:id, l:name limit l:2, t:3, e:2", "id log", "with r as (select *, row_number() over (partition by o_orderstatus, o_custkey order by o_orderdate, o_orderkey) re from orders), h as (select o_orderstatus, o_custkey, row_number() over (partition by o_orderstatus order by o_custkey) rt from r where re = 1), l as (select o_orderstatus, row_number() over (order by o_orderstatus) rl from h where rt = 1) select o_orderkey as id, o_orderstatus as log from r join h using (o_orderstatus, o_custkey) join l using (o_orderstatus) where re <= 2 and rt <= 3 and rl <= 2"),
    "offset_scoped": ("web", "select e:name, t:name limit e:1, t:20 offset t:3, e:1", "name trace", _W + _RANKS + " select event_type as name, r.tr as trace from r join h using (tr) where re = 2 and rt > 3 and rt <= 23"),
    "limit_traces_only": ("web", "select t:name limit t:10, e:1", "name", _W + _RANKS + " select tr as name from h where rt <= 10"),
    "limit_before_group": ("web", "select e:name, count(e:name) group by e:name limit e:1", "name n rows", _W + _RANKS + " select event_type as name, count(*) as n, count(*) as rows from r where re = 1 group by 1"),
    "scalar_text": ("web", "select upper(e:name), lower(t:name), e:name + '!'", "up low mark", _W + " select upper(event_type) as up, lower(tr) as low, event_type || '!' as mark from w"),
    "scalar_math": ("web", "select round(e:total), (e:total + 1) * 2 - 3, e:total / 4, e:total / 0", "r m q z", "select cast(floor(value + 0.5) as bigint) as r, round((value + 1) * 2 - 3, 4) as m, round(value / 4, 4) as q, cast(null as double) as z from events"),
    "scalar_date": ("web", "select year(e:timestamp), month(e:timestamp), day(e:timestamp), hour(e:timestamp), minute(e:timestamp), second(e:timestamp), millisecond(e:timestamp), quarter(e:timestamp), dayofweek(e:timestamp)", "y mo d h mi s ms q w", "select year(ts) as y, month(ts) as mo, day(ts) as d, hour(ts) as h, minute(ts) as mi, second(ts) as s, millisecond(ts) - 1000 * second(ts) as ms, quarter(ts) as q, dayofweek(ts) + 1 as w from events"),
    "scalar_day_text": ("web", "select date(e:timestamp)", "day", "select strftime(ts, '%Y-%m-%dT00:00Z') as day from events"),
    "scalar_days": ("web", "select e:timestamp - '2024-01-01T00:00:00.000+00:00'", "days", "select round((epoch_ms(ts) - epoch_ms(timestamp '2024-01-01')) / 86400000.0, 4) as days from events"),
    "classifier_event": ("chat", "select e:name, [e:c:Event Name], [e:c:Role and turn], [e:c:concept:name+turn]", "name both own split", "select role as name, role || '+' || case when text is null then 'empty' else 'complete' end as both, role || '+' || turn as own, role || '+' || turn as split from conversations"),
    "classifier_variants": ("chat", "select count(t:name) group by [^e:c:Event Name]", "variant n rows", "with s as (select conv_id, string_agg(role || '+' || case when text is null then 'empty' else 'complete' end, ',' order by turn) v from conversations group by 1) select v as variant, count(*) as n, count(*) as rows from s group by 1"),
    "sales_variants": ("sales", "select sum(e:total) group by l:name, ^e:name", "variant log total rows", "with s as (select o_orderstatus l, o_custkey, string_agg(o_orderpriority, ',' order by o_orderdate, o_orderkey) v, sum(o_totalprice) t from orders group by 1, 2) select v as variant, l as log, round(sum(t), 4) as total, count(*) as rows from s group by 1, 2"),
    "base_q3_regex": ("web", "select e:concept:name where e:concept:name matches '.*(li|ro).*'", "name", "select event_type as name from events where regexp_matches(event_type, '.*(li|ro).*')"),
    "base_q5_global": ("web", "select count(e:concept:name), min(e:total)", "n low rows", "select count(event_type) as n, round(min(value), 4) as low, count(*) as rows from events"),
    "base_q6_sorting": ("web", "select e:concept:name order by e:time:timestamp desc limit 1000", "name", "select event_type as name from events order by ts desc limit 1000"),
    "base_q8_variants": ("web", "select count(t:concept:name) group by ^e:concept:name order by count(t:concept:name) desc", "variant n rows", _SEQ + " select v as variant, count(*) as n, count(*) as rows from s group by v"),
}

#: name -> (binding, delete, SQL over the events that stay).
DELETES = {
    "delete_event": ("web", "delete event where e:name = 'click'", "select event_id from events where event_type <> 'click'"),
    "delete_trace": ("web", "delete trace where t:user < 10", "select event_id from events where user_id >= 10"),
    "delete_log": ("web", "delete log where l:name = 'web'", "select event_id from events where false"),
    "delete_topk": ("web", "delete event where e:name = 'view' order by e:total desc, e:timestamp limit 7 offset 2", "select event_id from events where event_id not in (select event_id from events where event_type = 'view' order by value desc, ts limit 7 offset 2)"),
    "delete_traces_by_event": ("web", "delete trace where e:total > 300", _W + " select event_id from w where tr not in (select tr from w where value > 300)"),
}


def tidy(df: DataFrame, names: str) -> DataFrame:
    """SQL-safe names; doubles rounded, sequences and days as text."""
    out = df.toDF(*names.split())
    for f in out.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "double":
            out = out.withColumn(f.name, F.round(f.name, 4))
        elif kind.startswith("array"):
            out = out.withColumn(f.name, F.array_join(f.name, ","))
        elif kind == "date" or kind.startswith("timestamp"):
            out = out.withColumn(f.name, F.to_date(f.name).cast("string"))
    return out


def _spec(name: str) -> Callable[[SparkSession, str], DataFrame]:
    binding, text, names, _ = SPECS[name]
    return lambda spark, sf_dir: tidy(Engine(bound(spark, sf_dir, binding)).query(text), names)


def _delete(name: str) -> Callable[[SparkSession, str], DataFrame]:
    binding, text, _ = DELETES[name]
    return lambda spark, sf_dir: Engine(bound(spark, sf_dir, binding)).remaining(text).select(F.col("_event").cast("bigint").alias("event_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _spec(n) for n in SPECS} | {n: _delete(n) for n in DELETES}


def oracle_sql() -> dict[str, str]:
    return {n: s[3] for n, s in SPECS.items()} | {n: s[2] for n, s in DELETES.items()}


FLAGSHIP = "select e:name, count(e:name), avg(e:total) where e:total > 50 group by e:name order by count(e:name) desc"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(Engine(bound(spark, sf_dir, "web")).query(FLAGSHIP), "name events mean rows")
