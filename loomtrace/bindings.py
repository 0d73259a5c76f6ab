"""Bindings of the driver's tables as event logs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from loomtrace.sources.layouts import Binding, BoundLayout

_EVENT = {"concept:name": "event_type", "time:timestamp": "ts", "cost:total": "value", "org:resource": "cast(user_id as string)", "k": "cast(get_json_object(props, '$.k') as double)"}
WEB = Binding(
    log="'web'", trace="concat(user_id, '|', cast(ts as date))", event="event_id", trace_order=("user_id", "cast(ts as date)"), event_order=("ts", "event_id"),
    attributes={"e": _EVENT, "t": {"concept:name": "concat(user_id, '|', cast(ts as date))", "user": "user_id", "day": "cast(ts as date)"}, "l": {"concept:name": "'web'"}},
    implied={("t", "concept:name"): {"user": "try_cast(substring_index(:v, '|', 1) as bigint)"}},
)
USERS = Binding(
    log="'users'", trace="user_id", event="event_id", trace_order=("user_id",), event_order=("ts", "event_id"),
    attributes={"e": _EVENT, "t": {"concept:name": "cast(user_id as string)"}, "l": {"concept:name": "'users'"}},
)
CHAT = Binding(
    log="'chat'", trace="conv_id", event="concat(conv_id, '#', turn)", trace_order=("conv_id",), event_order=("turn",),
    attributes={"e": {"concept:name": "role", "lifecycle:transition": "case when text is null then 'empty' else 'complete' end", "turn": "turn", "chars": "length(text)"}, "t": {"concept:name": "cast(conv_id as string)"}, "l": {"concept:name": "'chat'"}},
    classifiers={"Role and turn": ("concept:name", "turn")},
)
SALES = Binding(
    log="o_orderstatus", trace="concat(o_orderstatus, '|', o_custkey)", event="o_orderkey", trace_order=("o_custkey",), event_order=("o_orderdate", "o_orderkey"),
    attributes={"e": {"concept:name": "o_orderpriority", "time:timestamp": "cast(o_orderdate as timestamp)", "cost:total": "o_totalprice", "identity:id": "o_orderkey"}, "t": {"concept:name": "cast(o_custkey as string)", "custkey": "o_custkey"}, "l": {"concept:name": "o_orderstatus"}},
)
#: The same events as four logs, by user; what the queries over imported logs write and read back.
SHARDS = Binding(
    log="concat('web-', user_id % 4)", trace="concat(user_id, '|', cast(ts as date))", event="event_id", trace_order=("user_id", "cast(ts as date)"), event_order=("ts", "event_id"),
    attributes={
        "e": {"concept:name": "event_type", "time:timestamp": "ts", "cost:total": "value", "org:resource": "cast(user_id as string)", "k": "cast(get_json_object(props, '$.k') as bigint)", "number": "event_id"},
        "t": {"concept:name": "concat(user_id, '|', cast(ts as date))", "user": "user_id", "early": "day(ts) < 8"},
        "l": {"concept:name": "concat('web-', user_id % 4)", "identity:id": "concat('00000000-0000-0000-0000-00000000000', user_id % 4)"},
    },
)
TABLES = {"web": ("events", WEB), "shards": ("events", SHARDS), "users": ("events", USERS), "chat": ("conversations", CHAT), "sales": ("orders", SALES)}


def bound(spark: SparkSession, sf_dir: str, name: str) -> BoundLayout:
    table, binding = TABLES[name]
    return BoundLayout(spark.read.parquet(f"{sf_dir}/{table}.parquet"), binding)
