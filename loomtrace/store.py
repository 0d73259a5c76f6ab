"""A store of imported event logs: import, query, delete, export.

Each change (an import or a delete) writes the parquet files of the logs that it touches, and no others, into folders of
its own: data/TABLE/change=X/log_id=Y. A manifest says which change each log of each table is read from. Versions of the
manifest are numbered; a new one is put in place by a rename that fails if that number is taken, so of two writers one
sees the other's version first. It then applies its change to that version, unless both touched the same log, which is
a Conflict. Readers see one version as a whole. `vacuum` deletes files that the last version doesn't name.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtrace.engine import Engine, to_json
from loomtrace.plans.syntax import EVENT, LOG, TRACE, Delete, QueryError, parse
from loomtrace.sources import xes
from loomtrace.sources.layouts import ENTRY, EVENTS, HOT, IDS, LOGS, PARENTS, TRACES, LogLayout
from loomtrace.sources.shared import qualified
from loomtrace.sources.xes_writer import HEAD, Fragments, assemble, elements

TABLES = {"logs": LOGS, "traces": TRACES, "events": EVENTS}
#: Columns with bloom filters: a lookup by one of their values reads only the row groups that may have it.
LOOKUPS = {"logs": (), "traces": ("trace_id", "name"), "events": ("trace_id", "event_id", "activity", "resource", "trace_concept")}
_FIELDS = ("tag", "s", "n", "b", "chain")
_HEADER = f"struct<extensions:array<struct<name:string,prefix:string,uri:string>>,globals:array<struct<scope:string,attrs:map<string,{ENTRY}>>>,classifiers:array<struct<name:string,keys:array<string>>>>"


class Conflict(QueryError):
    """Another writer changed the same log meanwhile."""


def _shown(attrs: str, key: str):
    e = F.col(attrs)[key]
    return F.coalesce(e["s"], e["n"].cast("string"), e["b"].cast("string"))


class Store:
    """path: a folder of any file system that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        xes.register(spark)

    # --- versions ---

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _listed(self, path: str) -> list:
        fs, folder = self._fs(path)
        return list(fs.listStatus(folder)) if fs.exists(folder) else []

    def _state(self) -> dict:
        """The last version: {"version": n, "logs": {log_id: {table: change}}, "sizes": {change: {table: logs}}}."""
        last = max((f.getPath().getName() for f in self._listed(f"{self.path}/manifests") if f.getPath().getName().endswith(".json")), default=None)
        if last is None:
            return {"version": 0, "logs": {}, "sizes": {}}
        fs, where = self._fs(f"{self.path}/manifests/{last}")
        stream = fs.open(where)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _publish(self, state: dict) -> bool:
        """Make a version the last one; False if its number is taken."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, made = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(json.dumps(state).encode())
        stream.close()
        _, name = self._fs(f"{self.path}/manifests/{state['version']:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(made).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(made), fs.makeQualified(name), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            fs.delete(made, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _commit(self, read: dict, logs: dict[str, dict[str, str] | None], change: str, sizes: dict[str, int]) -> None:
        """Give logs new entries (None: none any more) in the next version. `read` is the version that they were made from."""
        while True:
            state = self._state()
            changed = [x for x in logs if state["logs"].get(x) != read["logs"].get(x)]
            if changed:
                raise Conflict(f"log {changed[0]!r} was changed by another writer")
            kept = {x: e for x, e in state["logs"].items() if x not in logs} | {x: e for x, e in logs.items() if e}
            used = {c for e in kept.values() for c in e.values()}
            all_sizes = {c: n for c, n in (state["sizes"] | {change: sizes}).items() if c in used}
            if self._publish({"version": state["version"] + 1, "logs": kept, "sizes": all_sizes}):
                return

    def _write(self, name: str, df: DataFrame, change: str) -> set[str]:
        """Write rows as a change's part of a table; the logs that it has rows of."""
        keys = [c for c in ("log_id", "trace_seq", "event_idx") if c in df.columns]  # by folder first, as the writer needs it: one sort
        out = df.sortWithinPartitions(*keys).write.partitionBy("log_id")
        for c in set(LOOKUPS[name]) & set(df.columns):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        folder = f"{self.path}/data/{name}/change={change}"
        out.parquet(folder)
        return {n.removeprefix("log_id=") for f in self._listed(folder) if (n := f.getPath().getName()).startswith("log_id=")}

    def _flat(self, state: dict, logs: set[str] | None = None) -> bool:
        """Whether the events of all these logs hold their parents' attributes."""
        changes = {e["events"] for x, e in state["logs"].items() if "events" in e and (logs is None or x in logs)}
        return bool(changes) and all(state["sizes"].get(c, {}).get("flat") for c in changes)

    def table(self, name: str, state: dict | None = None, logs: set[str] | None = None, parents: bool = False) -> DataFrame:
        """A table of the last or another version, of all or some logs; events also with their parents' attributes."""
        state = state or self._state()
        schema = StructType.fromDDL(TABLES[name] + (f", {PARENTS}" if parents else ""))
        by: dict[str, list[str]] = {}
        for log, entry in state["logs"].items():
            if name in entry and (logs is None or log in logs):
                by.setdefault(entry[name], []).append(log)
        root, paths = f"{self.path}/data/{name}", []
        for change, own in by.items():
            whole = len(own) == state["sizes"].get(change, {}).get(name)
            paths += [f"{root}/change={change}"] if whole else [f"{root}/change={change}/log_id={x}" for x in own]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(StructType([*schema.fields]).add("change", "string")).option("basePath", root).parquet(*paths).select(*schema.names)

    def layout(self, state: dict | None = None) -> LogLayout:
        state = state or self._state()
        flat = self._flat(state)
        return LogLayout(self.table("logs", state), self.table("traces", state), self.table("events", state, parents=flat), flat)

    def vacuum(self, hours: float = 24) -> int:
        """Delete folders that the last version doesn't name, and past versions, if older than that; how many. Readers
        of past versions lose their files."""
        state, before, gone = self._state(), (time.time() - 3600 * hours) * 1000, 0
        live = {(t, c, x) for x, e in state["logs"].items() for t, c in e.items()}
        for t in TABLES:
            for change in self._listed(f"{self.path}/data/{t}"):
                for log in self._listed(change.getPath().toString()):
                    names = (t, change.getPath().getName().removeprefix("change="), log.getPath().getName().removeprefix("log_id="))
                    if log.isDirectory() and names not in live and log.getModificationTime() <= before:
                        gone += self._fs(log.getPath().toString())[0].delete(log.getPath(), True)
        last = f"{state['version']:012d}.json"
        for f in [*self._listed(f"{self.path}/manifests"), *self._listed(f"{self.path}/staging")]:
            if f.getPath().getName() != last and f.getModificationTime() <= before:
                gone += self._fs(f.getPath().toString())[0].delete(f.getPath(), True)
        return gone

    # --- import ---

    def import_log(self, path: str, parents: bool = False) -> list[str]:
        """Add the logs of a file or folder; their ids, in order. Unknown file types are an error.

        parents: copy the attributes of traces and logs to their events. Where all logs of a store have that, queries
        over events join nothing, and conditions on parents prune the events at the scan.
        """
        started, read = time.time_ns(), self._state()
        staging = f"{qualified(self.spark, self.path)}/staging/{uuid.uuid4().hex}"
        pieces = self.spark.read.format("xes").option("pieces", f"{staging}/pieces").load(path).collect()  # a row for each 4 MB of a log
        head = xes.parsed(self.spark, pieces, "log").withColumn("h", F.from_json("header", _HEADER))
        by = W.orderBy("source", "log_id")  # a row for each imported log
        logs = head.select(
            "log_id", (F.row_number().over(by) + F.lit(started)).cast("bigint").alias("log_seq"), "source", F.timestamp_micros(F.lit(started // 1000)).alias("import_ts"),
            "h.extensions", "h.globals", "h.classifiers", F.coalesce(_shown("attrs", "concept:name"), "log_id").alias("name"), "attrs",
        )
        order = [(r["log_id"], r["log_seq"]) for r in logs.select("log_id", "log_seq").orderBy("log_seq").collect()]
        seq = F.broadcast(self.spark.createDataFrame(order, "log_id string, log_seq bigint"))  # a row for each imported log
        name_of = lambda attrs: F.coalesce(_shown(attrs, "concept:name"), F.substring_index("trace_id", "_", -1))
        traces = xes.parsed(self.spark, pieces, "trace").join(seq, "log_id").select("log_id", "log_seq", "trace_id", "trace_seq", name_of("attrs").alias("name"), "attrs")
        of_trace = [_shown("trace_attrs", "concept:name").alias("trace_concept"), name_of("trace_attrs").alias("trace_name"), "trace_attrs"] if parents else []
        events = xes.parsed(self.spark, pieces, "event", parents).join(seq, "log_id").select(
            "log_id", "log_seq", "trace_id", "trace_seq", "event_id", "event_idx", *[_shown("attrs", k).alias(c) for k, c in HOT.items()], "attrs", *of_trace
        )
        if parents:
            of_log = logs.select("log_id", F.col("name").alias("log_name"), F.col("attrs").alias("log_attrs"), F.col("source").alias("log_source"), F.col("import_ts").alias("log_import"), F.col("classifiers").alias("log_classifiers"))
            events = events.join(F.broadcast(of_log), "log_id", "left")
        change = uuid.uuid4().hex
        held = {t: self._write(t, df, change) for t, df in {"logs": logs, "traces": traces, "events": events}.items()}
        self._commit(read, {x: {t: change for t in TABLES if x in held[t]} for x, _ in order}, change, {t: len(x) for t, x in held.items()} | {"flat": int(parents)})
        self._drop(staging)
        return [x for x, _ in order]

    def _staged(self, df: DataFrame) -> str:
        path = f"{self.path}/staging/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _drop(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    # --- query and delete ---

    def query(self, text: str, ids: bool = False, payload: bool = False) -> DataFrame:
        return Engine(self.layout()).query(text, ids, payload=payload)

    def execute(self, text: str) -> str:
        """A query's rows, or a delete's result, as a JSON array; for small results."""
        if isinstance(parse(text), Delete):
            return json.dumps([self.delete(text)], indent=2)
        return json.dumps([json.loads(r["json"]) for r in to_json(self.query(text, ids=True, payload=True)).collect()], indent=2)

    def delete(self, text: str) -> dict:
        """Delete what a delete statement selects, with all below it: {"deleted": rows, "status": "success"}.

        Only logs that lose rows are written again, and of them only the tables that do.
        """
        read = self._state()
        scope, gone = Engine(self.layout(read)).victims(text)
        names = {"_log": "log_id", "_trace": "trace_id", "_event": "event_id"}
        key = names[IDS[scope][-1]]
        staged = self._staged(gone.select(F.col("_log").alias("log_id"), *([F.col(IDS[scope][-1]).alias(key)] if scope != LOG else [])).distinct())
        gone = self.spark.read.parquet(staged)
        logs = {r[0] for r in gone.select("log_id").distinct().collect()}  # a row for each log
        hit = {LOG: ("logs", "traces", "events"), TRACE: ("traces", "events"), EVENT: ("events",)}[scope]
        flat = self._flat(read, logs)
        frames = {t: self.table(t, read, logs, flat and t == "events") for t in hit}
        deleted = sum(df.join(gone, ["log_id", key] if key != "log_id" else key, "left_semi").count() for df in frames.values())
        if deleted:
            change, held = uuid.uuid4().hex, {}
            if scope != LOG:
                held = {t: self._write(t, df.join(gone, ["log_id", key], "left_anti").select(*df.columns), change) for t, df in frames.items()}
            entries = {x: None if scope == LOG else {t: c for t, c in read["logs"][x].items() if t not in hit} | {t: change for t in hit if x in held[t]} for x in logs}
            self._commit(read, entries, change, {t: len(x) for t, x in held.items()} | {"flat": int(flat)})
        self._drop(staged)
        return {"deleted": deleted, "status": "success"} if deleted else {"deleted": 0}

    def delete_all(self) -> None:
        self._drop(self.path)

    # --- export ---

    def export_log(self, log_id: str, target: str) -> None:
        """Write a log as XES to a file, of the driver or of a file system that a URI names. 
        Ranges of traces are written as fragments beside the store's tables, by all tasks; the driver copies their bytes."""
        log = self.table("logs").where(F.col("log_id") == log_id).first()
        if log is None:
            raise QueryError(f"log {log_id!r} not found")
        events = self.table("events").where(F.col("log_id") == log_id).select("trace_seq", "event_idx", F.map_entries("attrs").alias("attrs"))
        traces = self.table("traces").where(F.col("log_id") == log_id).select("trace_seq", F.lit(-1).cast("bigint").alias("event_idx"), F.map_entries("attrs").alias("attrs"))
        rows = traces.unionByName(events).repartitionByRange("trace_seq").sortWithinPartitions("trace_seq", "event_idx")
        parts = f"{qualified(self.spark, self.path)}/staging/{uuid.uuid4().hex}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, out, trace = TaskContext.get().partitionId(), None, None
            for b in batches:
                ends, (keys, held) = b.column(2).offsets.to_pylist(), b.column(2).values.flatten()
                items = [(k, dict(zip(_FIELDS, v))) for k, *v in zip(keys.to_pylist(), *(x.to_pylist() for x in held.flatten()))]
                for i, (seq, idx) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    shown = items[ends[i] : ends[i + 1]]
                    if idx < 0:
                        out = out or Fragments(f"{parts}/{task}", target)
                        out.write(f"{'  </trace>\n' if trace is not None else ''}  <trace>\n{elements(shown, 2)}")
                        trace = seq
                    elif seq == trace:
                        out.write(f"    <event>\n{elements(shown, 3)}    </event>\n")
            if out is not None:
                out.write("  </trace>\n")
                out.close()
                yield pa.RecordBatch.from_pylist([{"task": task, "path": out.path}])

        made = sorted((r["task"], r["path"]) for r in rows.mapInArrow(run, "task bigint, path string").collect())  # a row for each fragment
        head = HEAD
        for e in log["extensions"] or ():
            head += "  <extension" + "".join(f" {k}={quoteattr(e[k])}" for k in ("name", "prefix", "uri") if e[k] is not None) + "/>\n"
        for g in log["globals"] or ():
            head += f"  <global scope={quoteattr(g['scope'] or 'event')}>\n{elements(g['attrs'].items(), 2)}  </global>\n"
        for c in log["classifiers"] or ():
            keys = " ".join(f"'{k}'" if " " in k else k for k in c["keys"])
            head += f"  <classifier name={quoteattr(c['name'] or '')} keys={quoteattr(keys)}/>\n"
        assemble(target, head + elements(log["attrs"].items(), 1), [path for _, path in made], "</log>\n")
        self._drop(parts)
