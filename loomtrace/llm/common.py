"""Helpers that the training-data operators share: the shared folder, cut lineage, text access."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.sources.shared import job_folder
from loomtrace.workers import reach_workers

#: Bytes of text in one Arrow batch; bounds a Python worker's memory when long documents meet.
BATCH_BYTES = 24 << 20
BATCH_ROWS = 4000

#: Runs of ASCII letters, digits and any non-ASCII character, on UTF-8 bytes whose A-Z are lowered.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def session(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes as well as rows, where the session has no lower bounds, and let Python data sources see filters."""
    reach_workers(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(str(spark.conf.get(key)).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{job_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    return materialised(df, name)[0]


def materialised(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `materialise`, with the path, for tables that are deleted when the next is written."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, and of no other; results that still read them are lost."""
    delete(spark, job_folder(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower() changes A-Z only


def blocks(batches: Iterator[pa.RecordBatch], limit: int, column: str) -> Iterator[pa.Table]:
    """Join small batches until their text reaches `limit` bytes; a longer single batch is a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def labels_by_link(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n nodes under links a-b (min-label hooking with pointer jumps)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        if not open_.any():
            break
        a, b = a[open_], b[open_]
    return label


#: A key of more rows than both HUB and a HUBS-th of all is a hub: so there are fewer than HUBS of them at any size.
HUB, HUBS = 200, 100_000


def join_spread(rows: DataFrame, values: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Rows with the values of their key; values has one row for each key, whose column `size` is its number of rows.

    Hubs' values are broadcast, fewer than HUBS rows, so their rows stay where they are and no task gets a hub whole;
    all others meet by shuffle.
    """
    most = max(HUB, total // HUBS)
    hubs = F.broadcast(values.where(F.col(size) > most).drop(size))
    rest = rows.join(F.broadcast(values.where(F.col(size) > most).select(key)), key, "left_anti")
    return rows.join(hubs, key).unionByName(rest.join(values.where(F.col(size) <= most).drop(size), key))


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; LOOMTRACE_TOKENIZERS overrides the installed folder."""
    folder = os.environ.get("LOOMTRACE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
