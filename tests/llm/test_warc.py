import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from loomtrace.llm import warc

LONG = "<p>é" + "x" * 1200 + "</p>"
PAGES = [(1, "http://a", LONG), (2, "http://b", LONG), (9, "http://c\r\nX: y", LONG), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "z" * 300_000), (None, "n", LONG), (8, "u", "\r\n\r\nWARC/1.1\r\n")]


def expected(pages):
    tops = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000 and i is not None:
            tops[h] = max(tops.get(h, i), i)
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and h in tops and i != tops[h]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", tops[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == expected(PAGES)
    assert warc.round_trip(df.limit(0)).count() == 0
    again = spark.createDataFrame(PAGES * 2, "page_id bigint, url string, html string")
    assert sorted((tuple(r) for r in warc.round_trip(again).collect()), key=str) == sorted(expected(PAGES) * 2, key=str)


@pytest.fixture
def folder(spark, tmp_path):
    warc.archive(spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(2), f"file://{tmp_path}/w")
    return f"{tmp_path}/w"


def test_members_are_plain_gzip_and_skipped_by_length(folder, tmp_path):
    import pathlib

    files = sorted(pathlib.Path(folder).glob("*.warc.gz"))
    assert files
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Record-ID") == len(PAGES) and text.count(b"WARC-Type: revisit") == 3


def test_filters_and_columns_are_pushed_down(spark, folder):
    df = warc.read(spark, f"file://{folder}", "record_id string, record_type string").where("record_type = 'revisit' and record_id in ('<urn:page:1>', '<urn:page:3>')")
    assert [tuple(r) for r in df.collect()] == [("<urn:page:1>", "revisit")]
    assert warc.read(spark, f"file://{folder}").where("target_uri like 'http://%' and payload_length > 1000").count() == 3
    reader = warc.WarcReader(df.schema, {"path": f"file://{folder}"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 5)]))
    assert len(left) == 1 and len(reader.tests) == 1


def test_unwanted_payloads_are_not_inflated(folder, monkeypatch):
    fed = []
    feed = warc._Member._feed
    monkeypatch.setattr(warc._Member, "_feed", lambda self, raw: (fed.append(len(raw)), feed(self, raw))[1])
    reader = warc.WarcReader(warc.StructType().add("record_id", "string"), {"path": f"file://{folder}"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == len(PAGES) and max(fed) <= warc.HEAD


def test_uncommitted_files_are_not_read(spark, folder):
    import pathlib

    pathlib.Path(folder, "part-lost.warc.gz").write_bytes(warc.encode_record({"record_id": "lost", "record_type": "response"}, b"x"))
    assert warc.read(spark, f"file://{folder}").count() == len(PAGES)


def record(kind, body):
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Target-URI: http://x\r\n  /more\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@pytest.mark.parametrize("form", ["plain", "gz", "one member", "two members", "long extra field", "more line ends"])
def test_archives_of_others(spark, tmp_path, form):
    parts = [record(b"warcinfo", b"a: b\r\n\r\n"), record(b"response", b"y" * 2_000_000), record(b"request", b""), record(b"response", bytes(range(256)) * 9), record(b"metadata", b"\r\n\r\n")]
    if form in ("plain", "more line ends"):
        (tmp_path / "a.warc").write_bytes((b"\r\n\r\n\r\n" if form == "more line ends" else b"").join(parts))
    else:
        made = {"gz": [*map(gzip.compress, parts)], "one member": [gzip.compress(b"".join(parts))], "two members": [gzip.compress(b"".join(parts[:2])), gzip.compress(b"".join(parts[2:]))]}
        field = [x[:3] + b"\x04" + x[4:10] + b"\xd0\x07" + b"zz\xcc\x07" + b"\0" * 1996 + x[10:] for x in made["gz"]]
        (tmp_path / "a.warc.gz").write_bytes(b"".join(made.get(form, field)))
    rows = warc.read(spark, f"file://{tmp_path}").orderBy("record_type", "payload").collect()
    assert [(r["record_type"], len(r["payload"]), r["target_uri"]) for r in rows] == [(t, n, "http://x /more") for t, n in (("metadata", 4), ("request", 0), ("response", 2304), ("response", 2_000_000), ("warcinfo", 8))]
    assert rows[2]["payload"] == bytes(range(256)) * 9
    slim = warc.read(spark, f"file://{tmp_path}", "record_type string, target_uri string").where("record_type in ('response', 'metadata')")
    assert sorted(r["record_type"] for r in slim.collect()) == ["metadata", "response", "response"]
