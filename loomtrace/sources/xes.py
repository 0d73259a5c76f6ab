"""XES event logs as a Spark data source, in Python: .xes, .xes.gz and every .xes entry of a .zip.

A partition is one log: a file or a zip entry. Its rows are one `log` row, then `trace` rows each followed by its
`event` rows, in document order. The XML is pulled element by element and never held whole.

An import reads logs in pieces instead, as a log may be of any size: with the option `pieces`, a task for each log only
finds where its traces end (for zipped logs it also writes the unzipped bytes, at that folder), and `parsed` reads the
rows of one level from the pieces by as many tasks as they fill. A piece is a run of whole elements below the root, of
PIECE bytes or one trace. Texts between values repeat from event to event, so a piece is split at its values, and each
different sequence of such texts is parsed once (_Shapes); a piece that isn't written so is parsed as a whole.
"""

from __future__ import annotations

import gc
import gzip
import io
import hashlib
import json
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loomtrace.workers import reach_workers

ENTRY = "struct<tag:string,s:string,n:double,b:boolean,chain:string>"
SCHEMA = (
    "level string, source string, log_id string, trace_id string, event_id string, trace_seq bigint, event_idx bigint, "
    f"header string, attrs map<string,{ENTRY}>"
)
TYPES = ("string", "date", "int", "float", "boolean", "id", "list", "container")
_ENTRY = pa.struct([("tag", pa.string()), ("s", pa.string()), ("n", pa.float64()), ("b", pa.bool_()), ("chain", pa.string())])
_ROW = pa.schema([
    ("level", pa.string()), ("source", pa.string()), ("log_id", pa.string()), ("trace_id", pa.string()), ("event_id", pa.string()),
    ("trace_seq", pa.int64()), ("event_idx", pa.int64()), ("header", pa.string()), ("attrs", pa.map_(pa.string(), _ENTRY)),
])
_PIECES = pa.schema([
    ("source", pa.string()), ("log_id", pa.string()), ("piece", pa.int64()), ("path", pa.string()), ("member", pa.string()), ("start", pa.int64()),
    ("length", pa.int64()), ("zipped", pa.bool_()), ("prefix", pa.binary()), ("suffix", pa.binary()),
])
BATCH = 2000


def file_type(path: str) -> str:
    """xes, gz, zip, json or unknown, by extension."""
    end = path.lower().rpartition(".")[2]
    return end if end in ("xes", "gz", "zip", "json") else "unknown"


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def entry(tag: str, text: str | None, chain: str) -> dict:
    """A typed value; what can't be read as its type stays text."""
    out = {"tag": tag, "s": None, "n": None, "b": None, "chain": chain}
    if text is None:
        return out
    try:
        if tag == "int":
            out["n"] = float(int(text))
        elif tag == "float":
            out["n"] = float(text)
        elif tag == "boolean" and text in ("true", "false"):
            out["b"] = text == "true"
        elif tag == "id":
            out["s"] = str(uuid.UUID(text))
        else:
            out["s"] = text
    except ValueError:
        out["s"] = text
    return out


def flatten(element: ET.Element, into: dict[str, dict], prefix: str = "", chain: str = "") -> None:
    """An attribute and its children as keys parent:child, each with the chain of types above it; the last key wins."""
    tag, key = local_name(element.tag), element.get("key")
    if tag not in TYPES or key is None:
        return
    step = f"{tag}[{key}]"
    key, chain = prefix + key, f"{chain}|{step}" if chain else step
    if tag not in ("list", "container"):
        into.pop(key, None)
        into[key] = entry(tag, element.get("value"), chain)
    for child in element:
        if local_name(child.tag) == "values":  # the list form of newer files
            for inner in child:
                flatten(inner, into, key + ":", chain)
        else:
            flatten(child, into, key + ":", chain)


def classifier_keys(text: str) -> list[str]:
    """Keys divided by spaces or commas; a key in quotes may hold spaces."""
    out, held, quote = [], "", ""
    for c in text:
        if quote:
            if c == quote:
                quote = ""
            else:
                held += c
        elif c in "'\"":
            quote = c
        elif c in " ,\t\n\r":
            out += [held] if held else []
            held = ""
        else:
            held += c
    return [*out, held] if held else out


def rows_of(stream, source: str, log_id: str | None = None) -> Iterator[dict]:
    """The rows of one log."""
    log_id = log_id or f"log_{uuid.uuid4()}"
    header: dict = {"extensions": [], "globals": [], "classifiers": []}
    attrs: dict[str, dict] = {}
    base = {"source": source, "log_id": log_id, "trace_id": None, "event_id": None, "trace_seq": None, "event_idx": None, "header": None}
    trace = 0
    path: list[ET.Element] = []
    told = False

    def head() -> dict:
        return base | {"level": "log", "header": json.dumps(header), "attrs": attrs}

    for kind, element in ET.iterparse(stream, events=("start", "end")):
        if kind == "start":
            path.append(element)
            continue
        path.pop()
        tag = local_name(element.tag)
        if len(path) != 1:
            continue
        if tag == "extension":
            header["extensions"].append({k: element.get(k) for k in ("name", "prefix", "uri")})
        elif tag == "global":
            own: dict[str, dict] = {}
            for a in element:
                flatten(a, own)
            header["globals"].append({"scope": element.get("scope"), "attrs": own})
        elif tag == "classifier":
            header["classifiers"].append({"name": element.get("name"), "keys": classifier_keys(element.get("keys") or "")})
        elif tag == "trace":
            if not told:
                yield head()
                told = True
            own, events = {}, []
            for a in element:
                if local_name(a.tag) == "event":
                    events.append(a)
                else:
                    flatten(a, own)
            trace_id = f"{log_id}_{uuid.uuid4()}"
            yield base | {"level": "trace", "trace_id": trace_id, "trace_seq": trace, "attrs": own}
            for i, e in enumerate(events):
                own = {}
                for a in e:
                    flatten(a, own)
                yield base | {"level": "event", "trace_id": trace_id, "trace_seq": trace, "event_id": f"{trace_id}_{uuid.uuid4()}", "event_idx": i, "attrs": own}
            trace += 1
        elif not told:
            flatten(element, attrs)
        path[0].clear()  # what has been read is let go
    if not told:
        yield head()


PIECE = 4_000_000
PIECES = "source string, log_id string, piece bigint, path string, member string, start bigint, length bigint, zipped boolean, prefix binary, suffix binary"
PARSED = SCHEMA.replace("level string, ", "") + f", trace_attrs map<string,{ENTRY}>, level string"
#: The root's tag without a prefix, and where the first trace or event can't be yet.
_ROOT = re.compile(rb"""\s*(?:<\?(?:.(?!\?>))*.\?>\s*|<!--.*?-->\s*)*<([^\s<>/:!?]+)((?:\s(?:[^"'<>]|"[^"<]*"|'[^'<]*')*)?)>""", re.DOTALL)
_ENCODING = re.compile(rb"""^(?:\xef\xbb\xbf)?<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")
_MARKS = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!--|<!\[CDATA\[|<\?|<trace(?:\s[^<>]*)?>|</trace\s*>", re.DOTALL)
_OPENED = re.compile(rb"<trace(?:\s[^<>]*)?(?<!/)>")
_CLOSED = re.compile(rb"</trace\s*>")


def _plain_end(text: bytes) -> int | None:
    """last_end of a text with no marks but <trace> and </trace> in turn, looked at in one go; None if it isn't such a text."""
    a = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(a[:-7] == ord("<"))  # a mark that starts later can't be before an end
    after = a[at + 1]
    opened, closed = at[after == ord("t")], at[after == ord("/")]
    for i, c in enumerate(b"race", 2):
        opened = opened[a[opened + i] == c]
    for i, c in enumerate(b"trace", 2):
        closed = closed[a[closed + i] == c]
    if ((after == ord("!")) | (after == ord("?"))).any() or (a[opened + 6] != ord(">")).any() or (a[closed + 7] != ord(">")).any():
        return None
    if not len(closed):
        return 0
    end = int(closed[-1]) + 8
    return end if np.count_nonzero(opened < end) == len(closed) else None


def last_end(text: bytes) -> int:
    """Where the last trace ends before which all are closed; 0 if none does. Comments, CDATA and instructions don't count."""
    end = _plain_end(text)
    if end is not None:
        return end
    if b"<!" not in text and b"<?" not in text:
        at = max(text.rfind(b"</trace>"), 0)
        end = at + 8 if at else 0
        if end and len(_OPENED.findall(text, 0, end)) == len(_CLOSED.findall(text, 0, end)):
            return end
    depth = end = 0
    for m in _MARKS.finditer(text):
        mark = m.group()
        if mark in (b"<!--", b"<![CDATA[", b"<?"):  # not closed in this text
            break
        if mark.startswith(b"</"):
            depth -= 1
            end = m.end() if depth == 0 else end
        elif mark.startswith(b"<trace") and not mark.endswith(b"/>"):
            depth += 1
    return end


def cut(stream, size: int = PIECE) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """A log as (start, text, prefix, suffix): texts that are whole documents between prefix and suffix.

    A log whose root has a prefix, that has a document type or is in an encoding of more bytes a character than one,
    other than UTF-8, comes as (0, its first bytes, b"", None): it is to be read whole, as a stream.
    """
    held = stream.read(size)
    while 0 < len(held) < size and (more := stream.read(size - len(held))):
        held += more
    named = _ENCODING.match(held)
    encoding = named.group(1).lower() if named else b"utf-8"
    root = _ROOT.match(held.removeprefix(b"\xef\xbb\xbf"))
    if not root or root.group(2).endswith(b"/") or encoding.startswith((b"utf-16", b"utf16", b"utf-32", b"ucs", b"iso-10646")) or b"<!DOCTYPE" in held[: len(root.group()) + 3]:
        yield 0, held, b"", None
        return
    opening = b'<?xml version="1.0" encoding="' + encoding + b'"?><' + root.group(1) + root.group(2) + b">"
    start, prefix, asked = 0, b"", size
    while True:
        more = stream.read(asked)
        if not more:
            yield start, held, prefix, b""
            return
        held += more
        end = last_end(held)
        if end:
            yield start, held[:end], prefix, b"</" + root.group(1) + b">"
            start, held, prefix, asked = start + end, held[end:], opening, size
        else:
            asked = len(held)  # a long trace is looked at again each time that it has doubled


def _id(*of) -> str:
    h = hashlib.md5(repr(of).encode(), usedforsecurity=False).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _event_id(trace_id: str, at: int) -> str:
    """As `_event_ids` gives: the trace's id and its own last part once more, with the event's number for its last digits."""
    return f"{trace_id}_{trace_id[-36:-12]}{at:012x}"


def _event_ids(trace_ids: pa.Array, owner: pa.Array, places: pa.Array) -> pa.Array:
    """Ids of events from those of all traces of a piece, the number of each event's trace, and its own number there."""
    starts = pc.binary_join_element_wise(trace_ids, pc.utf8_slice_codeunits(trace_ids, -36, -12), "_")
    numbers = pa.array([f"{i:012x}" for i in range(1 + (pc.max(places).as_py() or 0))], pa.string())
    return pc.binary_join_element_wise(starts.take(owner), numbers.take(places), "")


class _Maps:
    """Attribute maps, held as columns: what flatten() gives, with the steps of names seen before looked up."""

    def __init__(self):
        self.ends, self.keys, self.entries = [0], [], []
        self.steps: dict[tuple, tuple] = {}

    def add(self, elements) -> None:
        own: dict[str, tuple] = {}
        for a in elements:
            self._put(own, a, "", "")
        self.keys += own
        self.entries += own.values()
        self.ends.append(len(self.keys))

    def _put(self, own: dict[str, tuple], a: ET.Element, prefix: str, chain: str) -> None:
        name, key = a.tag, a.get("key")
        step = self.steps.get((prefix, chain, name, key))
        if step is None:
            tag = local_name(name)
            known = tag in TYPES and key is not None
            step = self.steps[prefix, chain, name, key] = (tag, prefix + key, (f"{chain}|" if chain else "") + f"{tag}[{key}]") if known else ()
        if not step:
            return
        tag, key, chain = step
        if tag not in ("list", "container"):
            own.pop(key, None)
            text = a.get("value")
            own[key] = (tag, text, None, None, chain) if tag in ("string", "date") else tuple(entry(tag, text, chain).values())
        for child in a:
            if local_name(child.tag) == "values":
                for inner in child:
                    self._put(own, inner, key + ":", chain)
            else:
                self._put(own, child, key + ":", chain)

    def array(self) -> pa.MapArray:
        columns = list(zip(*self.entries)) or [()] * 5
        structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY)], fields=list(_ENTRY))
        return pa.MapArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.keys, pa.string()), structs)


class _Irregular(Exception):
    """A text that has to be parsed as a whole."""


_VALUE = re.compile(r' value="([^"<\t\n\r]*)"')
_REFERENCE = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#([0-9]{1,7})|#x([0-9A-Fa-f]{1,6}));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: Stands for a value in the text of a shape; a text that holds it is parsed as a whole.
_PLACE = "\ue000"
#: What XML can't hold, as bytes.
_CONTROL = bytes(c for c in range(32) if c not in b"\t\n\r")


def _character(m: re.Match) -> str:
    if m.group(1):
        return _NAMED[m.group(1)]
    c = int(m.group(2)) if m.group(2) else int(m.group(3), 16)
    if not (c in (9, 10, 13) or 0x20 <= c < 0xD800 or 0xE000 <= c <= 0xFFFD or 0x10000 <= c <= 0x10FFFF):
        raise _Irregular
    return chr(c)


def _unescaped(text: str) -> str:
    if text.count("&") != len(_REFERENCE.findall(text)):
        raise _Irregular
    return _REFERENCE.sub(_character, text)


class _Shapes:
    """Attribute maps of elements of one name, from their texts: what _Maps gives for the parsed elements.

    A shape is the texts around the values. Each is parsed once, with places for the values, and says which value is
    that of which attribute.
    """

    def __init__(self, tag: str):
        self.tag, self.shapes, self.steps = tag, {}, {}
        self.ids, self.values = [], []

    def add(self, text: str) -> None:
        """text: all behind the element's opening tag, up to its end and white space."""
        parts = _VALUE.split(text)
        around = tuple(parts[::2])
        shape = self.shapes.get(around)
        if shape is None:
            shape = self.shapes[around] = self._shape(around)
        ids, order = shape
        self.ids.append(ids)
        self.values += parts[1::2] if order is None else [None if i is None else parts[2 * i + 1] for i in order]

    def _shape(self, around: tuple[str, ...]) -> tuple[np.ndarray, list | None]:
        n = len(around) - 1
        try:
            root = ET.fromstring(f"<{self.tag}>" + "".join(f'{a} value="{_PLACE}{i}"' for i, a in enumerate(around[:-1])) + around[-1])
        except ET.ParseError:
            raise _Irregular from None
        if sorted(v for e in root.iter() if (v := e.get("value")) is not None) != sorted(f"{_PLACE}{i}" for i in range(n)):
            raise _Irregular
        if self.tag == "trace" and any(local_name(a.tag) == "event" for a in root):
            raise _Irregular
        own: dict[str, tuple] = {}
        maps = _Maps()
        for a in root:
            maps._put(own, a, "", "")
        order = [None if v is None else int(v.removeprefix(_PLACE)) for _, v, *_ in own.values()]
        ids = [self.steps.setdefault((tag, key, chain), len(self.steps)) for key, (tag, _, _, _, chain) in own.items()]
        return np.array(ids, np.int64), None if order == list(range(n)) else order

    def array(self, references: bool) -> pa.MapArray:
        ends = np.zeros(len(self.ids) + 1, np.int32)
        np.cumsum([len(x) for x in self.ids], out=ends[1:])
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int64)
        tags, keys, chains = zip(*self.steps) if self.steps else ((), (), ())
        texts = [_unescaped(v) if v and "&" in v else v for v in self.values] if references else self.values
        n, shown, of = len(texts), list(texts), ids.tolist()
        numbers, booleans = [None] * n, {}
        for i in np.flatnonzero(np.array([t not in ("string", "date") for t in tags], bool)[ids]).tolist() if n else ():
            text, tag = texts[i], tags[of[i]]
            try:  # as entry() does, without a row of its own for each
                numbers[i] = float(text) if tag == "float" else float(int(text)) if tag == "int" else None
            except (ValueError, TypeError):
                continue
            if numbers[i] is not None:
                shown[i] = None
            else:
                e = entry(tag, text, "")
                shown[i] = e["s"]
                if e["b"] is not None:
                    booleans[i] = e["b"]
        flags = pa.array([booleans.get(i) for i in range(n)], pa.bool_()) if booleans else pa.nulls(n, pa.bool_())
        at = pa.array(ids)
        named = [pa.array(x, pa.string()).take(at) for x in (tags, keys, chains)]
        structs = pa.StructArray.from_arrays([named[0], pa.array(shown, pa.string()), pa.array(numbers, pa.float64()), flags, named[2]], fields=list(_ENTRY))
        return pa.MapArray.from_arrays(pa.array(ends), named[1], structs)


def _by_shapes(text: bytes, piece: int, of_events: bool) -> tuple[pa.MapArray, pa.MapArray, list[int]]:
    """Maps of a piece's traces and events, and each trace's number of events."""
    named = _ENCODING.match(text)
    bare = text.removeprefix(b"\xef\xbb\xbf")
    root = _ROOT.match(bare)
    if not root or (named and named.group(1).lower() != b"utf-8") or len(text.translate(None, _CONTROL)) != len(text) or b"\xef\xbf\xbe" in text or b"\xef\xbf\xbf" in text:
        raise _Irregular
    try:
        head, *found = bare.decode().split("<trace>")
    except UnicodeDecodeError:
        raise _Irregular from None
    start = len(head.encode())
    inside = bare[start:]
    if not found or bare.count(b"<trace") != len(found) or inside.count(b"<event") != inside.count(b"<event>") or any(x in inside for x in (b"<!", b"<?", b"]]>", _PLACE.encode())):
        raise _Irregular
    if bare[root.end() : start].strip() if piece else re.search(r":trace[\s/>]", head) or head.count("<!--") != head.count("-->"):
        raise _Irregular
    closing = f"</{root.group(1).decode()}>"
    traces, events, counts = _Shapes("trace"), _Shapes("event"), []
    for i, t in enumerate(found):
        body, end, rest = t.rpartition("</trace>")
        if not end or rest.strip() != ("" if i < len(found) - 1 else closing):
            raise _Irregular
        own, *below = body.split("<event>")
        traces.add(own + end)
        counts.append(len(below))
        if of_events:
            for e in below:
                events.add(e)
    references = b"&" in inside
    return traces.array(references), events.array(references), counts


def _by_elements(text: bytes) -> tuple[pa.MapArray, pa.MapArray, list[int]]:
    traces, events, counts = _Maps(), _Maps(), []
    for t in ET.fromstring(text):
        if local_name(t.tag) != "trace":
            continue
        own, inside = [], []
        for a in t:
            (inside if local_name(a.tag) == "event" else own).append(a)
        traces.add(own)
        counts.append(len(inside))
        for e in inside:
            events.add(e)
    return traces.array(), events.array(), counts


_PARSED = pa.schema([*list(_ROW)[1:], ("trace_attrs", pa.map_(pa.string(), _ENTRY)), ("level", pa.string())])
LEVELS = ("log", "trace", "event")


def piece_rows(text: bytes, source: str, log_id: str, piece: int, parents: bool, levels: tuple[str, ...] = LEVELS) -> Iterator[pa.RecordBatch]:
    """The rows of a piece: those of rows_of with its attributes of the log in the first one. Ids follow from the log's id,
    so that a task that runs again makes the same; traces are numbered from a number of their piece."""
    if piece == 0 and "log" in levels:
        log = next(rows_of(io.BytesIO(text), source, log_id))
        yield pa.RecordBatch.from_pylist([log | {"attrs": list(log["attrs"].items()), "trace_attrs": None}], schema=_PARSED)
    if levels == ("log",):
        return
    try:
        maps, entries, counts = _by_shapes(text, piece, "event" in levels)
    except _Irregular:
        maps, entries, counts = _by_elements(text)
    trace_ids = [f"{log_id}_{_id(log_id, piece, at)}" for at in range(len(counts))]
    seqs = [(piece << 32) + at for at in range(len(counts))]

    def batch(level: str, n: int, columns: dict) -> pa.RecordBatch:
        same = {"source": source, "log_id": log_id, "level": level}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.repeat(pa.scalar(same[f.name], f.type), n) if f.name in same else pa.nulls(n, f.type) for f in _PARSED], schema=_PARSED)

    ids, numbers = pa.array(trace_ids, pa.string()), pa.array(seqs, pa.int64())
    if "trace" in levels:
        yield batch("trace", len(seqs), {"trace_id": ids, "trace_seq": numbers, "attrs": maps})
    if "event" not in levels:
        return
    owner = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
    places = pa.array(np.concatenate([np.arange(n) for n in counts]) if counts else [], pa.int64())
    names = _event_ids(ids, owner, places)
    for start in range(0, len(owner), BATCH):
        own, i = owner.slice(start, BATCH), places.slice(start, BATCH)
        columns = {"trace_id": ids.take(own), "trace_seq": numbers.take(own), "event_id": names.slice(start, BATCH), "event_idx": i, "attrs": entries.slice(start, BATCH)}
        yield batch("event", len(own), columns | ({"trace_attrs": maps.take(own)} if parents else {}))


def _streamed(path: str, member: str | None, raw):
    if member:
        return io.BufferedReader(zipfile.ZipFile(raw).open(member))
    return gzip.GzipFile(fileobj=raw) if file_type(path) == "gz" else raw


def whole_rows(path: str, member: str | None, source: str, log_id: str, parents: bool, level: str) -> Iterator[pa.RecordBatch]:
    """The rows of one level of a log that can't be cut, as a stream, with ids that are the same each time."""
    with _open(path) as raw:
        held, above, trace_id = [], None, None
        for row in rows_of(_streamed(path, member, raw), source, log_id):
            if level == "log" and row["level"] != "log":
                break
            if row["level"] == "trace":
                above, trace_id = list(row["attrs"].items()), f"{log_id}_{_id(log_id, 0, row['trace_seq'])}"
            if row["level"] == level:
                event_id = _event_id(trace_id, row["event_idx"]) if level == "event" else None
                held.append(row | {"trace_id": trace_id, "event_id": event_id, "attrs": list(row["attrs"].items()), "trace_attrs": above if parents and level == "event" else None})
            if len(held) >= BATCH:
                yield pa.RecordBatch.from_pylist(held, schema=_PARSED)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_PARSED)


def _packed(text: bytes) -> bytes:
    """A piece for the staging folder: zstandard at its lightest takes a third of the time that deflate does."""
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "zstd") as packed:
        packed.write(text)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> bytes:
    with pa.CompressedInputStream(pa.BufferReader(data), "zstd") as text:
        return text.read()


#: Pieces that one task reads, at most.
TOGETHER = 8


def parsed(spark: SparkSession, pieces: list, level: str, parents: bool = False) -> DataFrame:
    """The rows of one level from pieces, of which each task has at most TOGETHER, whatever the size of the logs.
    parents: events hold the attributes of their traces."""
    found = sorted((tuple(p) for p in pieces if level != "log" or p["piece"] == 0), key=lambda p: (p[1], p[2]))
    n = max(1, -(-len(found) // TOGETHER), min(len(found), 2 * spark.sparkContext.defaultParallelism))
    where = spark.createDataFrame(spark.sparkContext.parallelize(found, n), PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # trees of elements hold no cycles, and looking for some takes half of the time
        try:
            yield from read(batches)
        finally:
            gc.enable()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                if p["suffix"] is None:
                    yield from whole_rows(p["path"], p["member"], p["source"], p["log_id"], parents, level)
                    continue
                with _open(p["path"]) as f:
                    f.seek(p["start"])
                    text = f.read(p["length"])
                text = _unpacked(text) if p["zipped"] else text
                yield from piece_rows(p["prefix"] + text + p["suffix"], p["source"], p["log_id"], p["piece"], parents, (level,))

    return where.mapInArrow(run, PARSED)


@dataclass
class LogFile(InputPartition):
    path: str
    member: str | None

    def __init__(self, path: str, member: str | None):
        super().__init__(path)
        self.path, self.member = path, member


def _open(path: str):
    store, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_file(inner)


class XesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pieces = options["path"], options.get("pieces")

    def partitions(self) -> list[LogFile]:
        store, root = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = store.get_file_info(root)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        if info.type == pafs.FileType.Directory:
            found = [i.path for i in store.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File and file_type(i.path) in ("xes", "gz", "zip")]
        elif info.type == pafs.FileType.File:
            found = [root]
        else:
            raise FileNotFoundError(self.path)
        out = []
        for p in sorted(found):
            kind = file_type(p)
            if kind not in ("xes", "gz", "zip"):
                raise ValueError(f"not an event log: {p}")
            # other stores than the local one are named by the scheme alone, their root being the default one
            full = p if scheme == "file://" else scheme + p
            if kind == "zip":
                with _open(full) as f, zipfile.ZipFile(f) as z:
                    out += [LogFile(full, n) for n in z.namelist() if n.lower().endswith(".xes")]
            else:
                out.append(LogFile(full, None))
        return out

    def read(self, partition: LogFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no log at all
            return
        name = partition.path.rpartition("/")[2] + (f"!{partition.member}" if partition.member else "")
        if self.pieces:
            yield pa.RecordBatch.from_pylist(list(self._cut(partition, name)), schema=_PIECES)
            return
        with _open(partition.path) as raw:
            held: list[dict] = []
            for row in rows_of(_streamed(partition.path, partition.member, raw), name):
                row["attrs"] = list(row["attrs"].items())
                held.append(row)
                if len(held) >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=_ROW)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=_ROW)


    def _cut(self, log: LogFile, name: str) -> Iterator[dict]:
        """Where the pieces of a log lie: in its file, or unzipped and packed lightly in the folder `pieces`."""
        log_id = f"log_{_id(self.pieces, log.path, log.member)}"
        plain = log.member is None and file_type(log.path) == "xes"
        with _open(log.path) as raw:
            for i, (start, text, prefix, suffix) in enumerate(cut(_streamed(log.path, log.member, raw))):
                row = {"source": name, "log_id": log_id, "piece": i, "path": log.path, "member": log.member, "start": start, "length": len(text), "zipped": False, "prefix": prefix, "suffix": suffix}
                if suffix is not None and not plain:
                    store, inner = pafs.FileSystem.from_uri(f"{self.pieces}/{log_id}/{i}")
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    data = _packed(text)
                    with store.open_output_stream(inner, compression=None) as out:
                        out.write(data)
                    row |= {"path": f"{self.pieces}/{log_id}/{i}", "start": 0, "length": len(data), "zipped": True}
                yield row


class XesSource(DataSource):
    """spark.read.format("xes").load(path): a file or a folder of files."""

    @classmethod
    def name(cls) -> str:
        return "xes"

    def schema(self) -> str:
        return PIECES if "pieces" in self.options else SCHEMA

    def reader(self, schema: StructType) -> XesReader:
        return XesReader(self.options)


def register(spark: SparkSession) -> None:
    reach_workers(spark)
    spark.dataSource.register(XesSource)
