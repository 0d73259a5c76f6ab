"""Where attributes live. A query is compiled against a layout only, never against a storage format.

A layout gives a frame for a collection (events, traces or logs) that holds what the asked scopes need. Frames have
identity columns _log, _trace, _event and order columns _ls, _ts, _ei (document order of logs, traces, events).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import values
from loomtrace.functions.names import CLASSIFIERS, standard_name
from loomtrace.functions.values import Value
from loomtrace.plans.syntax import EVENT, LEVEL, LOG, TRACE, Attribute

IDS = {LOG: ["_log"], TRACE: ["_log", "_trace"], EVENT: ["_log", "_trace", "_event"]}
ORDER = {LOG: ["_ls"], TRACE: ["_ls", "_ts"], EVENT: ["_ls", "_ts", "_ei"]}
_SYSTEM = {"_id": None, "logid": "_log", "traceid": "_trace"}


@dataclass
class Frame:
    df: DataFrame
    scope: str
    find: Callable[[str, str], Value | None]
    classifier: Callable[[str], Value | None]
    #: scope -> column of a map of all its attributes, or a list of (name, Column)
    everything: Callable[[str], list[tuple[str, Column]]]
    #: Whether a name that find() gives may still be missing from every row.
    dynamic: bool = False

    @property
    def order(self) -> Column:
        return F.struct(*ORDER[self.scope])

    def resolve(self, a: Attribute) -> Value | None:
        """The attribute's value, or None if the layout has none of that name."""
        if a.classifier is not None:
            return self.classifier(a.classifier)
        # a row of a shallower collection that is asked for a deeper scope looks at its own attributes
        scope = a.scope if LEVEL[a.scope] <= LEVEL[self.scope] else self.scope
        name = standard_name(a.name, a.literal)
        if name.lower() in _SYSTEM:
            return Value("string", F.col(_SYSTEM[name.lower()] or IDS[scope][-1]))
        found = self.find(scope, name)
        if found is None and scope == EVENT:
            if "timestamp" in name.lower():
                return self.find(EVENT, "time:timestamp")
            if name.lower() in ("name", "activity"):
                return self.find(EVENT, "concept:name")
        return found


def joined(parts: list[Value]) -> Value | None:
    """Classifier values: the non-blank parts joined by +."""
    if not parts:
        return None
    shown = [F.when((p.text != "") & (p.text != "null"), p.text) for p in parts]
    text = F.concat_ws("+", *shown)
    return Value("string", F.when(text != "", text))


@dataclass(frozen=True)
class Binding:
    """A flat table read as an event log, a row for each event.

    log, trace and event are identity expressions (SQL); *_order give document order; attributes maps a scope to
    {standard name: SQL expression}. Expressions of traces and logs must not vary within one.
    """

    log: str
    trace: str
    event: str
    trace_order: tuple[str, ...]
    event_order: tuple[str, ...]
    attributes: dict[str, dict[str, str]]
    log_order: tuple[str, ...] = ()
    classifiers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: (scope, name) -> {name of another attribute of the scope: SQL of the value that it has where the first is :v}
    implied: dict[tuple[str, str], dict[str, str]] = field(default_factory=dict)


class BoundLayout:
    """A binding over a table. Attributes are typed columns, so filters and columns reach the scan."""

    flat = True

    def __init__(self, table: DataFrame, binding: Binding):
        self.table, self.binding = table, binding
        self.names = {s: {n.lower(): f"{s}__{i}" for i, n in enumerate(names)} for s, names in binding.attributes.items()}
        b = binding
        columns = [
            F.expr(b.log).cast("string").alias("_log"), F.expr(b.trace).cast("string").alias("_trace"), F.expr(b.event).cast("string").alias("_event"),
            F.struct(*[F.expr(x) for x in (b.log_order or (b.log,))]).alias("_ls"), F.struct(*[F.expr(x) for x in b.trace_order]).alias("_ts"),
            F.struct(*[F.expr(x) for x in b.event_order]).alias("_ei"),
        ]
        for s, names in b.attributes.items():
            columns += [F.expr(e).alias(self.names[s][n.lower()]) for n, e in names.items()]
        self.events = table.select(*columns)
        self.types = {f.name: f.dataType.simpleString() for f in self.events.schema.fields}

    def frame(self, scope: str, needed: set[str], early: Iterable[Callable[[Frame], DataFrame]] = ()) -> Frame:
        """early: filters over attributes that don't vary within a row of the scope; they apply before events are grouped."""

        def find(s: str, name: str) -> Value | None:
            column = self.names.get(s, {}).get(name.lower())
            return values.of_column(F.col(column), self.types[column]) if column else None

        def classifier(name: str) -> Value | None:
            keys = next((k for n, k in self.binding.classifiers.items() if n.lower() == name.lower()), None) or CLASSIFIERS.get(name.lower())
            keys = keys or tuple(name.split("+"))
            scopes = (EVENT, TRACE, LOG) if scope == EVENT else (TRACE, LOG) if scope == TRACE else (LOG,)
            parts = [next((v for s in scopes if (v := find(s, k.strip())) is not None), None) for k in keys]
            return joined([p for p in parts if p is not None])

        def everything(s: str) -> list[tuple[str, Column]]:
            return [(f"{s}:{n}", F.col(self.names[s][n.lower()])) for n in self.binding.attributes.get(s, {})]

        frame = Frame(self.events, scope, find, classifier, everything)
        for test in early:
            frame.df = test(frame)
        if scope != EVENT:
            own = [c for s in (LOG, TRACE) if LEVEL[s] <= LEVEL[scope] for c in self.names.get(s, {}).values()]
            frame.df = frame.df.groupBy(*IDS[scope]).agg(*[F.min(c).alias(c) for c in ORDER[scope]], *[F.first(c, ignorenulls=True).alias(c) for c in own])
        return frame


ENTRY = "struct<tag:string,s:string,n:double,b:boolean,chain:string>"
LOGS = f"log_id string, log_seq bigint, source string, import_ts timestamp, extensions array<struct<name:string,prefix:string,uri:string>>, globals array<struct<scope:string,attrs:map<string,{ENTRY}>>>, classifiers array<struct<name:string,keys:array<string>>>, name string, attrs map<string,{ENTRY}>"
TRACES = f"log_id string, log_seq bigint, trace_id string, trace_seq bigint, name string, attrs map<string,{ENTRY}>"
EVENTS = f"log_id string, log_seq bigint, trace_id string, trace_seq bigint, event_id string, event_idx bigint, activity string, ts_raw string, resource string, transition string, attrs map<string,{ENTRY}>"
#: What events have of their traces and logs, where an import copies it there.
PARENTS = f"trace_concept string, trace_name string, trace_attrs map<string,{ENTRY}>, log_name string, log_attrs map<string,{ENTRY}>, log_source string, log_import timestamp, log_classifiers array<struct<name:string,keys:array<string>>>"
#: Attributes of events that have columns of their own, which parquet can filter and prune.
HOT = {"concept:name": "activity", "time:timestamp": "ts_raw", "org:resource": "resource", "lifecycle:transition": "transition"}


def _text(entry: Column) -> Column:
    return F.coalesce(entry["s"], entry["n"].cast("string"), entry["b"].cast("string"))


def entry_of(attrs: Column, name: str) -> Column:
    """A map's entry of a name, or else of one that differs in case."""
    other = F.get(F.map_values(F.map_filter(attrs, lambda k, _: F.lower(k) == name.lower())), 0)
    return F.coalesce(attrs[name], F.when(F.size(attrs) > 0, other))


def texts_of(attrs: Column) -> Column:
    return F.transform_values(attrs, lambda _, v: _text(v))


def keys_of(classifier: str) -> Column:
    """The keys of a log's classifier, from its column `classifiers`."""
    return F.get(F.filter("classifiers", lambda c: F.lower(c["name"]) == classifier.lower()), 0)["keys"]


def part_of(maps: list[Column], key: Column) -> Column:
    """A classifier's part: the first text under the key that isn't empty."""
    return F.coalesce(*[F.when(_text(m[key]) != "", _text(m[key])) for m in maps])


class LogLayout:
    """Imported logs: tables of logs, traces and events with attribute maps.

    flat: events hold their parents' attributes (PARENTS), so queries over events join nothing, and conditions on
    parents are filters of the scan.
    """

    def __init__(self, logs: DataFrame, traces: DataFrame, events: DataFrame, flat: bool = False):
        self.logs, self.traces, self.events, self.flat = logs, traces, events, flat

    def frame(self, scope: str, needed: set[str], used: Iterable[Attribute] = (), shown: bool = False) -> Frame:
        """used: attributes that will be looked up, and shown: whether all will be, as text. Where events are joined with
        their traces, these are taken from the maps before, so that no maps are shuffled."""
        logs = self.logs.select(F.col("log_id").alias("_log"), F.col("log_seq").alias("_ls"), F.col("name").alias("l_name"), F.col("attrs").alias("l_attrs"), F.col("source").alias("l_source"), F.col("import_ts").alias("l_import"), "classifiers")
        traces = self.traces.select(F.col("log_id").alias("_log"), F.col("log_seq").alias("_ls"), F.col("trace_id").alias("_trace"), F.col("trace_seq").alias("_ts"), F.col("name").alias("t_name"), F.col("attrs").alias("t_attrs"))
        own = self.flat and scope == EVENT
        taken: dict[tuple[str, str], str] = {}
        early: dict[str, str] = {}
        if scope == LOG:
            df = logs
        elif scope == TRACE:
            df = traces
        else:
            copied = {"trace_concept": "t_concept", "trace_name": "t_name", "trace_attrs": "t_attrs", "log_name": "l_name", "log_attrs": "l_attrs", "log_source": "l_source", "log_import": "l_import", "log_classifiers": "classifiers"}
            df = self.events.select(
                F.col("log_id").alias("_log"), F.col("log_seq").alias("_ls"), F.col("trace_id").alias("_trace"), F.col("trace_seq").alias("_ts"), F.col("event_id").alias("_event"), F.col("event_idx").alias("_ei"), *HOT.values(), F.col("attrs").alias("e_attrs"),
                *([F.col(c).alias(n) for c, n in copied.items()] if own else []),
            )
            if needed & {TRACE, "classifier"} and not own:
                wanted = dict.fromkeys((a.scope, standard_name(a.name, literal)) for a in used for literal in (a.literal, False) if a.classifier is None and a.scope != LOG)
                asked = dict.fromkeys(a.classifier.lower() for a in used if a.classifier is not None)
                wanted |= dict.fromkeys((EVENT, k.strip()) for c in asked for k in CLASSIFIERS.get(c) or c.split("+"))
                wanted |= dict.fromkeys((EVENT, k.strip()) for a in used if a.classifier is not None for k in a.classifier.split("+"))
                taken = {w: f"{w[0]}_a{i}" for i, w in enumerate(w for w in wanted if w[0] == TRACE or w[1] not in HOT)}
                early = {c: f"e_parts{i}" for i, c in enumerate(asked)}
                if early:
                    df = df.join(logs.select("_log", "classifiers"), "_log", "left")
                df = df.select(
                    *[c for c in df.columns if c != "classifiers"], *[entry_of(F.col("e_attrs"), n).alias(c) for (s, n), c in taken.items() if s == EVENT],
                    *[F.transform(keys_of(c), lambda k: part_of([F.col("e_attrs")], k)).alias(n) for c, n in early.items()], *([texts_of(F.col("e_attrs")).alias("e_shown")] if shown else []),
                )
                of_traces = traces.select("*", *[entry_of(F.col("t_attrs"), n).alias(c) for (s, n), c in taken.items() if s == TRACE], *([texts_of(F.col("t_attrs")).alias("t_shown")] if shown else []))
                df = df.join(of_traces.drop("_ls", "_ts"), ["_log", "_trace"], "left")
        if scope != LOG and needed & {LOG, "classifier"} and not own:
            df = df.join(logs.drop("_ls"), "_log", "left")
        have = set(df.columns)

        def find(s: str, name: str) -> Value | None:
            if s == EVENT and name in HOT:
                return Value("string", F.col(HOT[name]))
            if own and s == TRACE and name == "concept:name":
                return Value("string", F.col("t_concept"))
            if s == LOG and name.lower() in ("source", "importtimestamp"):
                return Value("string", F.col("l_source")) if name.lower() == "source" else Value("time", F.col("l_import"))
            if (s, name) in taken:
                return values.of_attribute(F.col(taken[s, name]))
            return values.of_attribute(entry_of(F.col(f"{s}_attrs"), name)) if f"{s}_attrs" in have else None

        def classifier(name: str) -> Value | None:
            """As its log defines it, else as implied by the name."""
            implied = joined([p for k in (CLASSIFIERS.get(name.lower()) or name.split("+")) if (p := find(scope, k.strip())) is not None])
            if "classifiers" not in have:
                return implied
            maps = [F.col(f"{s}_attrs") for s in (EVENT, TRACE, LOG) if f"{s}_attrs" in have]
            at = early.get(name.lower())
            if at:
                parts = F.transform(keys_of(name), lambda k, i: F.coalesce(F.get(F.col(at), i), part_of(maps[1:], k)))
            else:
                parts = F.transform(keys_of(name), lambda k: part_of(maps, k))
            own = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "+")
            return Value("string", F.coalesce(F.when(own != "", own), implied.text if implied else F.lit(None)))

        def everything(s: str) -> list[tuple[str, Column]]:
            if f"{s}_attrs" not in have:
                return []
            return [(f"{s}:*", F.col(f"{s}_shown") if f"{s}_shown" in have else texts_of(F.col(f"{s}_attrs")))]

        return Frame(df, scope, find, classifier, everything, dynamic=True)
