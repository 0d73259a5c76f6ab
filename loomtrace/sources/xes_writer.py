"""XES as text: attributes as elements, and a sink that writes bound tables as logs, a file for each log."""

from __future__ import annotations

import gzip
import re
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.plans.syntax import EVENT, LOG, TRACE
from loomtrace.sources.layouts import ORDER, BoundLayout
from loomtrace.workers import reach_workers

#: Bytes that are held to be written or copied together.
COPIED = 4_000_000
#: Characters that XML can't hold.
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_TAGS = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "boolean": "boolean", "timestamp": "date", "timestamp_ntz": "date"}


def _place(target: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(target) if "://" in target else (pafs.LocalFileSystem(), target)


@contextmanager
def output(target: str) -> Iterator:
    """A file of bytes to write, zipped by the name: of this machine, or of the file system that a URI names. It gets its name when it is whole."""
    store, path = _place(target)
    made = f"{path}.{uuid.uuid4().hex}.part"
    store.create_dir(path.rpartition("/")[0] or ".", recursive=True)
    with store.open_output_stream(made, compression=None) as raw:
        name = path.rpartition("/")[2]
        if name.endswith(".zip"):
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z, z.open(name.removesuffix(".zip").removesuffix(".xes") + ".xes", "w", force_zip64=True) as member:
                yield member
        else:
            yield raw
    store.move(made, path)


def packed(target: str, data: bytes) -> bytes:
    """Bytes as a part of the target: a .gz file is a chain of gzip members, so that its parts are made apart."""
    return gzip.compress(data, 6, mtime=0) if target.endswith(".gz") else data


def assemble(target: str, head: str, fragments: list[str], tail: str) -> None:
    """A file of its head, its fragments in order, already packed for it, and its tail; bytes are copied as they stand."""
    with output(target) as out:
        out.write(packed(target, head.encode()))
        for f in fragments:
            store, path = _place(f)
            with store.open_input_stream(path, compression=None) as part:
                while data := part.read(COPIED):
                    out.write(data)
        out.write(packed(target, tail.encode()))


class Fragments:
    """Texts of one task that go to files of theirs, in blocks."""

    def __init__(self, path: str, target: str):
        store, inner = _place(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        self.path, self.target, self.held, self.size = path, target, [], 0
        self.raw = store.open_output_stream(inner, compression=None)

    def write(self, text: str | bytes | memoryview) -> None:
        self.held.append(text.encode() if isinstance(text, str) else text)
        self.size += len(self.held[-1])
        if self.size >= COPIED:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.raw.write(packed(self.target, b"".join(self.held)))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.raw.close()


def _starts(ids: pa.Array, before) -> np.ndarray:
    """Which rows have another id than the row before them; `before` is that of the row before the first."""
    previous = pa.concat_arrays([pa.array([before], ids.type), ids[:-1]])
    differ = pc.or_(pc.fill_null(pc.not_equal(ids, previous), False), pc.xor(ids.is_null(), previous.is_null()))
    return differ.to_numpy(zero_copy_only=False)


def _text(value) -> str | None:
    if value["b"] is not None:
        return "true" if value["b"] else "false"
    if value["n"] is not None:
        return str(int(value["n"])) if value["tag"] == "int" else repr(value["n"])
    return value["s"]


@lru_cache(10_000)
def _steps(chain: str) -> list[tuple[str, str]]:
    """A type chain tag[key]|tag[key] as pairs."""
    out = []
    for step in chain.split("]|"):
        tag, _, key = step.partition("[")
        out.append((tag, key))
    out[-1] = (out[-1][0], out[-1][1].removesuffix("]"))
    return out


def elements(attributes, depth: int) -> str:
    """Flat attributes as nested elements again, by their type chains; values of parents are kept."""
    root: dict = {}
    for _, value in attributes:
        at = root
        steps = _steps(value["chain"])
        for tag, key in steps:
            node = at.setdefault(key, {"tag": tag, "value": None, "in": {}})
            at = node["in"]
        node["tag"], node["value"] = value["tag"], _text(value)

    def shown(nodes: dict, level: int) -> str:
        out = []
        for key, n in nodes.items():
            head = "  " * level + f"<{n['tag']} key={quoteattr(key)}" + (f" value={quoteattr(_ILLEGAL.sub("", n['value']))}" if n["value"] is not None else "")
            out.append(f"{head}>\n{shown(n['in'], level + 1)}{'  ' * level}</{n['tag']}>\n" if n["in"] else head + "/>\n")
        return "".join(out)

    return shown(root, depth)


def _quoted(text: Column) -> Column:
    """A text as the value of an XML attribute. Most hold nothing to replace, which one look tells."""
    quoted = F.regexp_replace(text, _ILLEGAL.pattern, "")
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        quoted = F.replace(quoted, F.lit(c), F.lit(name))
    return F.when(text.rlike("[&<>\"\t\n\r" + _ILLEGAL.pattern[1:]), quoted).otherwise(text)


def _elements_column(values: list[tuple[str, str, Column]], nested: dict[str, tuple[str, str]], depth: int) -> Column:
    """The text that elements() gives for columns (name, tag, value as text), in Spark: those in a list or container under its key."""
    nodes: dict[str, dict] = {}
    for name, tag, column in values:
        outer = nested.get(name)
        node = nodes.setdefault(outer[1] if outer else name, {"own": None, "in": []})
        if outer:
            node["in"].append((outer[0], name, tag, column))
        else:
            node["own"] = tag, column

    def single(name: str, tag: Column | str, column: Column, level: int, end: str = "/>\n") -> Column:
        shown = F.lit("  " * level + "<")
        return F.concat(shown, F.lit(tag) if isinstance(tag, str) else tag, F.lit(f" key={quoteattr(_ILLEGAL.sub('', name))} value=\""), column, F.lit('"' + end))

    def text(tag: str, column: Column) -> Column:
        return _quoted(column) if tag in ("string", "id") else column

    out = []
    for key, node in nodes.items():
        own = (node["own"][0], text(*node["own"])) if node["own"] else None
        if not node["in"]:
            out.append(F.coalesce(single(key, own[0], own[1], depth), F.lit("")))
            continue
        inner = F.concat(*[F.coalesce(single(n, t, text(t, c), depth + 1), F.lit("")) for _, n, t, c in node["in"]])
        outer_tag = F.coalesce(*[F.when(c.isNotNull(), F.lit(o)) for o, _, _, c in node["in"]])
        tag = F.coalesce(F.when(own[1].isNotNull(), F.lit(own[0])), outer_tag) if own else outer_tag
        start = F.concat(F.lit("  " * depth + "<"), tag, F.lit(f" key={quoteattr(_ILLEGAL.sub('', key))}"))
        value = F.coalesce(F.concat(F.lit(' value="'), own[1], F.lit('"')), F.lit("")) if own else F.lit("")
        whole = F.concat(start, value, F.lit(">\n"), inner, F.lit("  " * depth + "</"), tag, F.lit(">\n"))
        alone = F.coalesce(single(key, own[0], own[1], depth), F.lit("")) if own else F.lit("")
        out.append(F.when(inner != "", whole).otherwise(alone))
    return F.concat(F.lit(""), *out)


HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="1.0" xmlns="http://www.xes-standard.org/">\n'


def write_logs(layout: BoundLayout, folder: str, nested: dict[str, tuple[str, str]] | None = None, classifiers: dict[str, tuple[str, ...]] | None = None, forms: tuple[str, ...] = ("xes",)) -> None:
    """Write a bound table as XES, a file for each log: FOLDER/LOG.FORM, forms taken in turn by a hash of the log's name.

    nested: of an event's attribute, the (list or container, key) to write it in. Ranges of traces are written as
    fragments, by as many tasks as there are partitions; then a task for each log puts its fragments together. A task
    that runs again replaces its files.
    """
    spark = layout.table.sparkSession
    reach_workers(spark)
    frame = layout.frame(EVENT, {LOG, TRACE, EVENT})

    def body(s: str, depth: int) -> Column:
        values = []
        for name in layout.binding.attributes.get(s, {}):
            column = layout.names[s][name.lower()]
            tag = _TAGS.get(layout.types[column], "string")
            values.append((name, tag, F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'") if tag == "date" else F.col(column).cast("string")))
        return _elements_column(values, (nested or {}) if s == EVENT else {}, depth)

    own = [c for s in (LOG, TRACE, EVENT) for c in layout.names.get(s, {}).values()]
    rows = frame.df.select("_log", "_trace", *ORDER[EVENT], *own)
    rows = rows.repartitionByRange("_ls", "_log", "_ts", "_trace").sortWithinPartitions("_ls", "_log", "_ts", "_trace", "_ei")
    event = F.concat(F.lit("    <event>\n"), body(EVENT, 3), F.lit("    </event>\n"))
    rows = rows.select("_log", "_trace", body(LOG, 1).alias("l"), F.concat(F.lit("  <trace>\n"), body(TRACE, 2)).alias("t"), event.alias("e"))
    parts = f"{folder}/.fragments-{uuid.uuid4().hex}"

    def target(log: str) -> str:
        return f"{folder}/{log}.{forms[sum(log.encode()) % len(forms)]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made, log, trace, out = [], None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            new = _starts(b.column(0), log)
            new[0] |= out is None
            first = np.flatnonzero(new | _starts(b.column(1), trace))
            log, trace = b.column(0)[-1].as_py(), b.column(1)[-1].as_py()
            events = b.column(4).cast(pa.binary())  # their texts lie behind each other, so those of a trace are one slice
            ends, text = np.frombuffer(events.buffers()[1], np.int32)[events.offset :], memoryview(events.buffers()[2])
            cuts = ends[[*first, b.num_rows]].tolist()
            if cuts[0] > ends[0]:
                out.write(text[ends[0] : cuts[0]])
            for at, t_text, start, end in zip(first.tolist(), b.column(3).take(pa.array(first)).to_pylist(), cuts, cuts[1:]):
                if out is not None:
                    out.write("  </trace>\n")
                if new[at]:
                    if out is not None:
                        out.close()
                    log_id = b.column(0)[at].as_py()
                    out = Fragments(f"{parts}/{len(made)}-{task}", target(log_id))
                    made.append((log_id, task, out.path, b.column(2)[at].as_py()))
                out.write(t_text)
                out.write(text[start:end])
        if out is not None:
            out.write("  </trace>\n")
            out.close()
        names = ["log", "task", "path", "text"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, m)) for m in made], schema=pa.schema([("log", pa.string()), ("task", pa.int64()), ("path", pa.string()), ("text", pa.string())]))

    found: dict[str, list] = {}
    for r in sorted(rows.mapInArrow(run, "log string, task bigint, path string, text string").collect(), key=lambda r: r["task"]):  # a row for each fragment
        found.setdefault(r["log"], []).append(r)
    head = HEAD + '  <extension name="Concept" prefix="concept" uri="http://www.xes-standard.org/concept.xesext"/>\n'
    head += "".join(f"  <classifier name={quoteattr(n)} keys={quoteattr(' '.join(keys))}/>\n" for n, keys in (classifiers or {}).items())
    jobs = [(target(log), head + own[0]["text"], [r["path"] for r in own]) for log, own in found.items()]
    if jobs:
        spark.sparkContext.parallelize(jobs, len(jobs)).foreach(lambda j: assemble(*j, "</log>\n"))
        store, inner = _place(parts)
        store.delete_dir(inner)
