"""WARC archives as a Spark data source, in Python.

Writing: every task writes gzip archives of its own, a member for each record, and the driver commits them by a
manifest; files of tasks that failed or ran twice are in no manifest and are never read. Each member's gzip header
has its compressed and full size in an extra field (the `sl` skip lengths), so a reader can step over a record.

Reading: a partition for each archive (for each manifest's archives, or else every *.warc and *.warc.gz in the folder).
Filters on record type and header fields are pushed down. A record's headers are parsed first, from as little of the
member as they need; the payload is inflated only if the filters pass and the requested schema has a payload.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from loomtrace.llm.common import fresh_path, session

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, payload_length bigint, refers_to string, payload binary"
#: Column -> WARC header field.
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To",
}
#: A task starts another archive when one has so many bytes.
ARCHIVE_BYTES = 64 << 20
HEAD = 1024
#: Bytes that are read, and inflated, at a time.
PIECE = 1 << 18
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Above so many groups of equal payloads they are joined by shuffle.
BROADCAST_ROWS = 500_000


def encode_record(values: dict, payload: bytes) -> bytes:
    """One record, as a gzip member with skip lengths."""
    lines = ["WARC/1.1"]
    for column, name in FIELDS.items():
        if values.get(column) is not None:
            lines.append(f"{name}: {str(values[column]).replace(chr(13), ' ').replace(chr(10), ' ')}")
    if values.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines.append(f"Content-Length: {len(payload)}")
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continuation lines are joined."""
    out: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


class _Member:
    """A gzip member that is inflated as far as is asked; `data` is what has been inflated and not been dropped."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.end = file, at, size
        start = file.read_at(min(HEAD, size - at), at)
        if start[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        flags, skip, self.length, self.full = start[3], 10, None, None
        if flags & 4:
            extra = struct.unpack_from("<H", start, 10)[0]
            while len(start) < min(12 + extra + HEAD, size - at):
                start += file.read_at(min(12 + extra + HEAD, size - at) - len(start), at + len(start))
            if extra >= 12 and start[12:14] == b"sl":
                self.length, self.full = struct.unpack_from("<II", start, 16)
            skip += 2 + extra
        for bit in (8, 16):
            if flags & bit:
                skip = start.index(b"\0", skip) + 1
        skip += 2 if flags & 2 else 0
        self.inflate, self.data, self.next, self.gone = zlib.decompressobj(-15), bytearray(), at + len(start), 0
        self._feed(start[skip:])

    def _feed(self, raw: bytes) -> None:
        self.data += self.inflate.decompress(raw, PIECE)

    def _more(self) -> bool:
        """Inflate a further piece; False at the member's end."""
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail
        if not raw:
            size = min(PIECE, self.end - self.next, (self.at + self.length - self.next) if self.length else PIECE)
            if size <= 0:
                return False
            raw = self.file.read_at(size, self.next)
            self.next += len(raw)
        self._feed(raw)
        return True

    def until(self, enough) -> None:
        """Inflate until enough(data), or to the end."""
        while not enough(self.data) and self._more():
            pass

    def follows(self, used: int) -> bool:
        """Whether something comes after the next `used` bytes; they are dropped then. Skip lengths tell without inflating."""
        if self.full is not None and self.gone + used >= self.full:
            return False
        while len(self.data) <= used:
            used -= len(self.data)
            self.gone += len(self.data)
            self.data.clear()
            if not self._more():
                return False
        del self.data[:used]
        self.gone += used
        return True

    def after(self) -> int:
        """Where the next member starts, by skip length if there is one."""
        if self.length:
            return self.at + self.length
        while self._more():
            self.data.clear()
        return self.next - len(self.inflate.unused_data) + 8


class _Plain:
    """An archive without compression, as one member; only what is asked is read."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.end, self.data = file, at, size, bytearray()

    def until(self, enough) -> None:
        while not enough(self.data) and self.at + len(self.data) < self.end:
            self.data += self.file.read_at(max(HEAD, len(self.data)), self.at + len(self.data))

    def follows(self, used: int) -> bool:
        self.at += used
        del self.data[:used]
        return self.at < self.end

    def after(self) -> int:
        return self.end


def _head_end(data: bytearray) -> int:
    """Where the blank line after a record's headers starts, or -1; line ends before the record don't count."""
    start = 0
    while start < len(data) and data[start] in b"\r\n":
        start += 1
    return data.find(b"\r\n\r\n", start)


def read_archive(file, size: int, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(header fields, payload or None) of the records whose fields satisfy `wanted`. A gzip member may hold any number of records."""
    at = 0
    kind = _Member if size and file.read_at(2, 0) == b"\x1f\x8b" else _Plain
    while at < size:
        member = kind(file, at, size)
        more = True
        while more:
            member.until(lambda d: _head_end(d) >= 0)
            cut = _head_end(member.data)
            if cut < 0:
                if member.data.strip():
                    raise ValueError(f"record without end of headers in the member at byte {at}")
                break
            fields, body = parse_head(bytes(member.data[:cut]).lstrip(b"\r\n")), cut + 4
            length = int(fields.get("content-length", 0))
            if wanted(fields):
                payload = None
                if with_payload:
                    member.until(lambda d: len(d) >= body + length)
                    payload = bytes(member.data[body : body + length])
                yield fields, payload
            more = member.follows(body + length + 4)
        at = member.after()


@dataclass
class Archive(InputPartition):
    path: str
    size: int

    def __init__(self, path: str, size: int):
        super().__init__(path)
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.tests = schema, options["path"], []

    def pushFilters(self, filters: list[Filter]):
        """Take equality, membership, presence and prefix tests on header columns; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in FIELDS and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                value = frozenset(f.value) if isinstance(f, In) else None if isinstance(f, IsNotNull) else f.value
                self.tests.append((type(f).__name__, name, value))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        store, root = pafs.FileSystem.from_uri(self.path)
        listed = {i.path: i.size for i in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if i.type == pafs.FileType.File}
        manifests = [p for p in listed if p.endswith(".manifest.json")]
        names = [p for p in listed if p.endswith((".warc", ".warc.gz"))]
        if manifests:
            names = []
            for m in manifests:
                with store.open_input_stream(m, compression=None) as f:
                    names += [f"{m.rpartition('/')[0]}/{n}" for n in json.loads(f.read())]
        return [Archive(p, listed[p]) for p in sorted(names)]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archive at all
            return
        columns = self.schema.fieldNames()
        tests = self.tests

        def value(fields: dict[str, str], column: str):
            got = fields.get(FIELDS[column].lower())
            return int(got) if column == "payload_length" and got is not None else got

        def wanted(fields: dict[str, str]) -> bool:
            for kind, column, given in tests:
                got = value(fields, column)
                if got is None or (kind == "EqualTo" and got != given) or (kind == "In" and got not in given) or (kind == "StringStartsWith" and not got.startswith(given)):
                    return False
            return True

        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        types = [pa.field(c, kinds.get(c, pa.string())) for c in columns]
        rows, held = [], 0
        store, _ = pafs.FileSystem.from_uri(self.path)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(types)], schema=pa.schema(types))

        with store.open_input_file(partition.path) as file:
            for fields, payload in read_archive(file, partition.size, wanted, "payload" in columns):
                rows.append([payload if c == "payload" else value(fields, c) for c in columns])
                held += len(payload or b"")
                if len(rows) >= 2000 or held >= 8 << 20:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for b in iterator:
            columns = b.schema.names
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                values = dict(zip(columns, row))
                if out is None or size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                size += out.write(record := encode_record(values, values.get("payload") or b"")) or len(record)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{uuid.uuid4().hex}.manifest.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for n in m.names if m else ():
                store.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    """spark.read.format("warc") / df.write.format("warc"); option path: a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    session(spark).dataSource.register(WarcSource)


def _urn(column) -> object:
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("")), F.lit(">"))


def archive(pages: DataFrame, path: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row. Of rows with equal payloads of `least` bytes or more, those with the largest id are
    responses and the others revisit records without a payload, which name it; all smaller ones are responses.

    Null html is an empty payload. A null id is smaller than all others (a group of null ids only is all responses).
    """
    register(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("bigint"))
    groups = rows.where(F.col("payload_length") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    few = groups.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(groups) if few else groups, (F.col("digest") == F.col("d")) & (F.col("payload_length") >= least), "left")
    again = F.coalesce(F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")), F.lit(False))
    rows.select(
        _urn(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"), F.lit("text/html; charset=utf-8").alias("content_type"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        "payload_length", F.when(again, _urn(F.col("top"))).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): archive the rows, then read the archives back.

    Digest and size of responses are those of the payload as read; of revisits, those that the record's headers state,
    read without a payload. An empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    archive(pages, path, least)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as {pages.schema['page_id'].dataType.simpleString()})")
    full = read(spark, path).where("record_type = 'response'")
    slim = read(spark, path, SCHEMA.replace(", payload binary", "")).where("record_type = 'revisit'")
    return full.select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    ).unionByName(slim.select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.expr("substring(payload_digest, 6)").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    ))
