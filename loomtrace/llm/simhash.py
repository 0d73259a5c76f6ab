"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are cut into five segments on a ring. If two fingerprints differ in at most `distance`
bits, then from some segment on, the differences of every chain of consecutive segments stay within the chain's
share of the budget: l segments differ in at most floor(l * distance / 5) bits. For a distance of 4 the first
segment is therefore equal (the shuffle key), the first two differ in at most 1 bit (probed in the bucket by the
at most 14 values of the second segment), three in at most 2, four in at most 3; only then comes the full check.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import join_spread, labels_by_link, materialise, session, text_rows, utf8
from loomtrace.llm.components import connected_components

SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIR_BLOCK = 1 << 20
#: Up to this size a bucket's pairs are all checked.
SMALL = 96
SHINGLE_BLOCK = 1 << 15


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each `width`-word shingle of the lowered text; fewer words give one whole shingle."""
    words = text.lower().split()  # splits at space and \t \n \v \f \r
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    cut = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in cut], "<u8")


def fingerprint(text: bytes, width: int = 4) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes; no words give 0."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), SHINGLE_BLOCK):
        part = h[at : at + SHINGLE_BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, tie, fp): one row per input row; tie is a hash of the text; null text counts as empty."""
    session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp, pa.int64())], names=["doc_id", "tie", "fp"])

    rows = text_rows(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tie bigint, fp bigint")


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    at, width = SEGMENTS[i % len(SEGMENTS)]
    return (fp >> np.uint64(at)) & np.uint64((1 << width) - 1)


def _chained(x: np.ndarray, first: int, distance: int) -> np.ndarray:
    """Which XOR values pass every chain that starts at segment `first`, and so the full check too."""
    keep = np.arange(len(x))
    used = np.zeros(len(x), np.uint8)
    for l in range(1, len(SEGMENTS) + 1):
        used = used + np.bitwise_count(_segment(x, first + l - 1))
        ok = used <= l * distance // len(SEGMENTS)
        x, used, keep = x[ok], used[ok], keep[ok]
    return keep


@lru_cache(maxsize=SMALL)
def _all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _bucket_links(fp: np.ndarray, first: int, distance: int) -> np.ndarray:
    """Component labels of one bucket's fingerprints; all are equal in segment `first` of the ring.

    A small bucket checks its pairs by the chains. In a larger one each fingerprint probes the few values of the next
    segment that its chain allows, among fingerprints not yet in its component; components are joined after each block
    of candidates, so a dense group costs few candidates, not its square.
    """
    n = len(fp)
    label = np.arange(n)
    if n <= SMALL:
        left, right = _all_pairs(n)
        ok = _chained(fp[left] ^ fp[right], first, distance)
        return labels_by_link(n, left[ok], right[ok])
    second = _segment(fp, first + 1).astype(np.int64)
    width = SEGMENTS[(first + 1) % len(SEGMENTS)][1]
    masks = [0, *(1 << k for k in range(width) if 2 * distance // len(SEGMENTS))]
    for mask in masks:
        at = 0
        while at < n:  # blocks of about PAIR_BLOCK candidates
            order = np.lexsort((label, second))
            keys = second[order] * n + label[order]
            want = (second[at:] ^ mask) * n
            bounds = [np.searchsorted(keys, want + x) for x in (0, label[at:], label[at:] + 1, n)]
            sizes = (bounds[1] - bounds[0]) + (bounds[3] - bounds[2])  # before and after those of the same component
            to = max(1, int(np.searchsorted(np.cumsum(sizes), PAIR_BLOCK, "right")))
            size = sizes[:to]
            left = np.repeat(np.arange(to), size)
            step = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
            below = (bounds[1] - bounds[0])[left]
            right = order[np.where(step < below, bounds[0][left] + step, bounds[2][left] + step - below)]
            left = left + at
            ok = _chained(fp[left] ^ fp[right], first, distance)
            if len(ok):
                tied = np.nonzero(label != np.arange(n))[0]
                label = labels_by_link(n, np.concatenate((left[ok], tied)), np.concatenate((right[ok], label[tied])))
            at += to
    return label


def links(reps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): edges that connect just what links of `distance` bits connect; reps: distinct (rid, fp).

    Each bucket sends a spanning forest, never its pairs. A distance above 4 is an error: only for 0 to 4 does some
    chain start with an equal segment, which is the key of a bucket.
    """
    if not 0 <= distance < len(SEGMENTS):
        raise ValueError(f"distance must be 0 to {len(SEGMENTS) - 1}")
    spark = reps.sparkSession
    keyed = reps.select(
        "rid", "fp",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("seg"), F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1).alias("val"))
            for i, (at, width) in enumerate(SEGMENTS)
        ])).alias("k"),
    ).select("rid", "fp", "k.seg", "k.val")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        rid, fp, seg, val = (rows.column(c).to_numpy() for c in ("rid", "fp", "seg", "val"))
        fp = fp.view(np.uint64)
        order = np.lexsort((val, seg))
        edge = np.nonzero(np.diff(seg[order]) | np.diff(val[order]))[0] + 1
        out_a, out_b = [], []
        for lo, hi in zip([0, *edge], [*edge, len(order)]):
            if hi - lo > 1:
                own = order[lo:hi]
                label = _bucket_links(fp[own], int(seg[own[0]]), distance)
                tied = np.nonzero(label != np.arange(len(label)))[0]
                out_a.append(rid[own[label[tied]]])
                out_b.append(rid[own[tied]])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return keyed.repartition(n, "seg", "val").mapInArrow(run, "a bigint, b bigint")


def _named(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, c): the component of each different fingerprint, named by a fingerprint."""
    reps = materialise(prints.select("fp").distinct(), "fingerprint-groups")
    found = connected_components(links(reps.select(F.col("fp").alias("rid"), "fp"), distance))
    return reps.join(found, reps["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    fingerprint: 16 lowercase hex digits. component_id: the smallest id reachable over links of `distance` or fewer
    differing bits. Null and empty texts have fingerprint zero and link like any other. Rows with equal fingerprints
    meet in one representative before any comparison, by map-side combination, so a large group of copies costs one
    row per task. Repeated rows keep their number; a null id links too but never names a component (null if no other
    id is in it). An empty table gives an empty result; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    low = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    named = materialise(_named(prints, distance).join(low, "fp"), "components")
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    named = join_spread(named, lowest, "c", "members", named.count()).select("fp", "component_id", "copies")
    return join_spread(prints, named, "fp", "copies", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (null last), then text hash."""
    prints = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    low = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("low"))
    chosen = _named(prints, distance).join(low, "fp").groupBy("c").agg(F.min("low").alias("low")).select(F.col("low.doc_id").alias("_id"), F.col("low.tie").alias("_tie"))
    rows = docs.withColumn("_text_hash", F.xxhash64(text_col))
    rows = rows.join(chosen, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_tie")), "left_semi")
    if prints.groupBy("doc_id", "tie").count().where("count > 1").limit(1).count():  # of equal rows one stays
        rows = rows.withColumn("_number", F.row_number().over(W.partitionBy(id_col, "_text_hash").orderBy(F.lit(0)))).where("_number = 1")
    return rows.select(*docs.columns)
