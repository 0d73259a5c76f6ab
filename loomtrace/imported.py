"""The driver's queries over imported logs: its events are written as XES files, plain, gzipped and zipped, and imported."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.bindings import bound
from loomtrace.engine import to_json
from loomtrace.queries import tidy
from loomtrace.sources.shared import job_folder
from loomtrace.sources.xes_writer import write_logs
from loomtrace.store import Store

CLASSIFIERS = {"Activity and user": ("concept:name", "org:resource")}
_FILES: dict[tuple[str, str], str] = {}
_STORES: dict[tuple[str, str], Store] = {}
_FLAT: dict[tuple[str, str], Store] = {}


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The folder of files with the events as four logs; made once for an application, as are the stores of them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FILES:
        folder = f"{job_folder(spark)}/logs-{uuid.uuid4().hex}/files"
        write_logs(bound(spark, sf_dir, "shards"), folder, {"k": ("container", "props")}, CLASSIFIERS, ("xes", "xes.gz", "xes.zip"))
        _FILES[key] = folder
    return _FILES[key]


def imported(spark: SparkSession, sf_dir: str) -> Store:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = Store(spark, f"{job_folder(spark)}/store-{uuid.uuid4().hex}")
        store.import_log(_written(spark, sf_dir))
        _STORES[key] = store
    return _STORES[key]


def flat(spark: SparkSession, sf_dir: str) -> Store:
    """The same logs, with their parents' attributes on the events."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FLAT:
        _FLAT[key] = Store(spark, f"{job_folder(spark)}/flat-{uuid.uuid4().hex}")
        _FLAT[key].import_log(_written(spark, sf_dir), parents=True)
    return _FLAT[key]


_W = "with w as (select *, user_id || '|' || cast(cast(ts as date) as varchar) as tr, 'web-' || (user_id % 4) as lg, cast(json_extract_string(props, '$.k') as bigint) as k from events)"
_SEQ = _W + ", s as (select tr, min(lg) as lg, string_agg(event_type, ',' order by ts, event_id) as v, count(*) as n, sum(value) as total from w group by tr)"
_ONE = "8|2024-01-01"

#: name -> (query, output columns, SQL).
SPECS: dict[str, tuple[str, str, str]] = {
    "log_semi_trace": (f"select e:name, e:total * 1 where t:name = '{_ONE}'", "name total", _W + f" select event_type as name, round(value, 4) as total from w where tr = '{_ONE}'"),
    "log_semi_trace_number": ("select e:name, e:total * 1 where t:user < 12 and t:early = true", "name total", _W + " select event_type as name, round(value, 4) as total from w where user_id < 12 and day(ts) < 8"),
    "log_semi_log": ("select t:name where l:name = 'web-1'", "name", _W + " select distinct tr as name from w where lg = 'web-1'"),
    "log_semi_both": ("select e:name, e:total * 1 where l:name = 'web-1' and t:user < 40 and e:total > 20", "name total", _W + " select event_type as name, round(value, 4) as total from w where lg = 'web-1' and user_id < 40 and value > 20"),
    "log_semi_up": ("select t:name where e:name = 'error' and e:total > 100", "name", _W + " select distinct tr as name from w where event_type = 'error' and value > 100"),
    "log_semi_up_log": ("select l:name where e:number = 17", "name", _W + " select lg as name from w where event_id = 17"),
    "log_join_parent": ("select e:number, e:name, t:name, l:name", "number name trace log", _W + " select event_id || '.0' as number, event_type as name, tr as trace, lg as log from w"),
    "log_mixed_or": (f"select e:name, e:total * 1 where t:name = '{_ONE}' or e:total > 200", "name total", _W + f" select event_type as name, round(value, 4) as total from w where tr = '{_ONE}' or value > 200"),
    "log_parent_null": ("select e:name where t:nothing is null and l:name = 'web-2'", "name", _W + " select event_type as name from w where lg = 'web-2'"),
    "log_group_log": ("select l:name, count(e:name), sum(e:total) group by l:name", "log n total rows", _W + " select lg as log, count(*) as n, round(sum(value), 4) as total, count(*) as rows from w group by lg"),
    "log_group_trace": ("select t:name, count(e:name), avg(e:total) group by t:name", "trace n mean rows", _W + " select tr as trace, count(*) as n, round(avg(value), 4) as mean, count(*) as rows from w group by tr"),
    "log_group_parent_weighted": ("select avg(t:user), count(e:name) group by e:name", "mean n rows", _W + " select round(avg(user_id), 4) as mean, count(*) as n, count(*) as rows from w group by event_type"),
    "log_count_parents": ("select count(l:name), count(t:name), count(e:name), sum(e:total)", "logs traces n total rows", _W + " select count(distinct lg) as logs, count(distinct tr) as traces, count(*) as n, round(sum(value), 4) as total, count(*) as rows from w"),
    "log_nested": ("select e:name, [e:props:k] * 1 where [e:props:k] = 42", "name k", _W + " select event_type as name, 42.0::double as k from w where k = 42"),
    "log_nested_group": ("select [e:props:k], count(e:name) group by [e:props:k]", "k n rows", _W + " select cast(k as varchar) || '.0' as k, count(*) as n, count(*) as rows from w group by k"),
    "log_time": ("select hour(time(e:timestamp)), minute(time(e:timestamp)), second(time(e:timestamp)), year(time(e:timestamp)), day(time(e:timestamp))", "h mi s y d", "select hour(ts) as h, minute(ts) as mi, second(ts) as s, cast(1970 as bigint) as y, cast(1 as bigint) as d from events"),
    "log_now": ("select e:name where e:timestamp < now() and e:total > 100", "name", "select event_type as name from events where value > 100"),
    "log_uuid": ("select l:name where l:id = 00000000-0000-0000-0000-000000000002", "name", "select 'web-2' as name"),
    "log_function_scope": ("select e:upper(e:name), t:lower(t:name) where e:total > 150", "up low", _W + " select upper(event_type) as up, lower(tr) as low from w where value > 150"),
    "log_time_filter": ("select e:name, e:total * 1 where e:timestamp >= '2024-01-10T00:00:00.000+00:00' and e:timestamp < D2024-01-20T12:00", "name total", "select event_type as name, round(value, 4) as total from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20 12:00:00'"),
    "log_matches": ("select e:name where e:name matches '^c.*k$' and e:resource in ('8', '9', '10')", "name", "select event_type as name from events where regexp_matches(event_type, '^c.*k$') and user_id in (8, 9, 10)"),
    "log_variants": ("select count(t:name) group by ^e:name", "variant n rows", _SEQ + " select v as variant, count(*) as n, count(*) as rows from s group by v"),
    "log_variants_by_log": ("select sum(e:total) group by l:name, ^e:name", "variant log total rows", _SEQ + " select v as variant, lg as log, round(sum(total), 4) as total, count(*) as rows from s group by v, lg"),
    "log_classifier": ("select [e:c:Activity and user] where e:total > 50", "own", _W + " select event_type || '+' || user_id as own from w where value > 50"),
    "log_classifier_group": ("select count(e:name) group by [e:c:Activity and user]", "n rows", _W + " select count(*) as n, count(*) as rows from w group by event_type, user_id"),
    "log_limit": ("select e:name, t:name limit l:2, t:3, e:2", "name trace", _W + ", r as (select *, row_number() over (partition by tr order by ts, event_id) re from w), h as (select tr, lg, row_number() over (partition by lg order by user_id, cast(ts as date)) rt from r where re = 1) select event_type as name, r.tr as trace from r join h using (tr) where re <= 2 and rt <= 3 and h.lg in ('web-0', 'web-1')"),
    "log_order": ("select e:name, t:name order by e:timestamp desc limit 20 offset 3", "name trace", _W + " select event_type as name, tr as trace from w order by ts desc limit 20 offset 3"),
    "log_order_parent": ("select e:name, t:name order by t:user desc, e:timestamp limit 25", "name trace", _W + " select event_type as name, tr as trace from w order by user_id desc, ts limit 25"),
    "log_sources": ("select l:name, l:source", "name source", "select 'web-' || i as name, s as source from (values (0, 'web-0.xes'), (1, 'web-1.xes.gz'), (2, 'web-2.xes.zip!web-2.xes'), (3, 'web-3.xes')) v(i, s)"),
}


def _select_all(text: str, ids: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = imported(spark, sf_dir).query(text, ids=ids)
        item = lambda scope, key: F.col(f"`{scope}:*`")[key]
        return rows.select(
            item("e", "concept:name").alias("name"), F.round(item("e", "cost:total").cast("double"), 4).alias("total"), item("e", "props:k").cast("double").alias("k"),
            item("t", "concept:name").alias("trace"), item("l", "concept:name").alias("log"), *[F.size(f"`{s}:*`").cast("bigint").alias(f"{s}_size") for s in "etl"],
            F.col("_id").startswith(F.col("traceId")).alias("event_of_trace"), F.col("traceId").startswith(F.col("logId")).alias("trace_of_log"),
        )

    return run


_ALL_SQL = _W + " select event_type as name, round(value, 4) as total, cast(k as double) as k, tr as trace, lg as log, cast(6 as bigint) as e_size, cast(3 as bigint) as t_size, cast(2 as bigint) as l_size, true as event_of_trace, true as trace_of_log from w"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imported(spark, sf_dir).query("select e:name, t:name", ids=True)
    return rows.groupBy(F.col("`t:name`").alias("trace")).agg(F.count_distinct("_id").alias("events"), F.count_distinct("traceId").alias("traces"), F.count_distinct("logId").alias("logs"))


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imported(spark, sf_dir).query("select e:name, count(t:name) group by e:name, t:name", payload=True)
    first = F.get("events", 0)
    return rows.select(F.col("`e:name`").alias("name"), F.col("count").alias("n"), F.size("events").cast("bigint").alias("payload"), first["e:number"].cast("double").alias("first"), first["t:concept:name"].alias("trace"), first["l:concept:name"].alias("log"))


def _variant_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imported(spark, sf_dir).query("select count(t:name) group by ^e:name", payload=True)
    names = F.transform("events", lambda e: e["e:concept:name"])
    return rows.select(F.array_join("variant", ",").alias("variant"), F.array_join(names, ",").alias("names"), F.col("count").alias("n"))


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_json(imported(spark, sf_dir).query(f"select e:number, t:* where t:name = '{_ONE}'"))
    item = lambda key: F.from_json("json", "map<string,string>")[key]
    return rows.select(item("e:number").cast("double").alias("number"), item("t:concept:name").alias("trace"), item("t:user").cast("double").alias("user_id"), item("t:early").alias("early"))


def _left(store: Store, told: dict) -> DataFrame:
    """What a delete says, and the rows that it leaves."""
    left = [store.table(t).count() for t in ("logs", "traces", "events")]
    return store.spark.createDataFrame([(told["deleted"], *left)], "deleted bigint, logs bigint, traces bigint, events bigint")


def _delete(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _written(spark, sf_dir)
        store = Store(spark, f"{job_folder(spark)}/deletes-{uuid.uuid4().hex}")
        store.import_log(files)
        return _left(store, store.delete(text))

    return run


#: name -> (delete, SQL).
DELETES = {
    "log_delete_default": ("delete where e:name = 'click'", _W + " select count_if(event_type = 'click') as deleted, count(distinct lg) as logs, count(distinct tr) as traces, count_if(event_type <> 'click') as events from w"),
    "log_delete_event": ("delete event where t:user < 30 and e:total > 50", _W + " select count_if(user_id < 30 and value > 50) as deleted, count(distinct lg) as logs, count(distinct tr) as traces, count_if(not (user_id < 30 and value > 50)) as events from w"),
    "log_delete_trace": ("delete trace where t:user < 30", _W + " select count_if(user_id < 30) + count(distinct tr) filter (user_id < 30) as deleted, count(distinct lg) as logs, count(distinct tr) filter (user_id >= 30) as traces, count_if(user_id >= 30) as events from w"),
    "log_delete_log": ("delete log where l:name = 'web-3'", _W + " select 1 + count_if(lg = 'web-3') + count(distinct tr) filter (lg = 'web-3') as deleted, count(distinct lg) filter (lg <> 'web-3') as logs, count(distinct tr) filter (lg <> 'web-3') as traces, count_if(lg <> 'web-3') as events from w"),
    "log_delete_ordered": ("delete event order by e:timestamp desc limit 25", _W + " select 25::bigint as deleted, count(distinct lg) as logs, count(distinct tr) as traces, count(*) - 25 as events from w"),
}


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export every log, import the files elsewhere, and query those."""
    store, root = imported(spark, sf_dir), f"{job_folder(spark)}/export-{uuid.uuid4().hex}"
    for i, r in enumerate(store.table("logs").select("log_id").orderBy("log_seq").collect()):
        store.export_log(r["log_id"], f"{root}/{i}.xes{['', '.gz'][i % 2]}")
    again = Store(spark, f"{root}/store")
    again.import_log(root)
    return tidy(again.query("select l:name, e:name, count(t:name), sum(e:total), max(e:timestamp), sum([e:props:k]) group by l:name, e:name").drop("max(e:timestamp)"), "log name traces total k rows")


CUSTOM: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "log_select_all": (_select_all(f"select * where t:name = '{_ONE}'", False), _ALL_SQL + f" where tr = '{_ONE}'"),
    "log_implicit_all": (_select_all("where e:total > 100", True), _ALL_SQL + " where value > 100"),
    "log_ids": (_ids, _W + " select tr as trace, count(*) as events, 1::bigint as traces, 1::bigint as logs from w group by tr"),
    "log_payload": (_payload, _W + " select event_type as name, count(*) as n, 1::bigint as payload, cast(arg_min(event_id, (ts, event_id)) as double) as first, tr as trace, min(lg) as log from w group by event_type, tr"),
    "log_variant_payload": (_variant_payload, _SEQ + " select v as variant, v as names, count(*) as n from s group by v"),
    "log_json": (_json, _W + f" select cast(event_id as double) as number, tr as trace, cast(user_id as double) as user_id, 'true' as early from w where tr = '{_ONE}'"),
    "log_export": (_exported, _W + " select lg as log, event_type as name, count(distinct tr) as traces, round(sum(value), 4) as total, cast(sum(k) as double) as k, count(*) as rows from w group by 1, 2"),
}


#: Queries of SPECS that also run on the logs whose events hold their parents' attributes.
FLAT = ("semi_trace", "semi_trace_number", "semi_both", "semi_up", "join_parent", "mixed_or", "group_log", "group_trace", "nested", "classifier", "variants_by_log", "limit", "order_parent")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def spec(name: str) -> Callable[[SparkSession, str], DataFrame]:
        text, names, _ = SPECS[name]
        return lambda spark, sf_dir: tidy(imported(spark, sf_dir).query(text), names)

    def on_flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
        text, names, _ = SPECS[f"log_{name}"]
        return lambda spark, sf_dir: tidy(flat(spark, sf_dir).query(text), names)

    return {n: spec(n) for n in SPECS} | {f"flat_{n}": on_flat(n) for n in FLAT} | {n: _delete(d[0]) for n, d in DELETES.items()} | {n: c[0] for n, c in CUSTOM.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s[2] for n, s in SPECS.items()} | {f"flat_{n}": SPECS[f"log_{n}"][2] for n in FLAT} | {n: d[1] for n, d in DELETES.items()} | {n: c[1] for n, c in CUSTOM.items()}
