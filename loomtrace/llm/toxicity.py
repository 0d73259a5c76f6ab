"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presences of word unigrams, bigrams and skip-grams with one or two words left out, hashed to 2**BITS
coordinates. FTRL-proximal gives each coordinate its own learning rate and, by L1, leaves most weights at zero, so the
model is a short list of (coordinate, weight) that is broadcast to score every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import session, text_rows, utf8, words_of

BITS = 20
#: Labelled rows that training uses at most: those with the smallest hashes of their ids.
SAMPLE = 16000
EPOCHS = 3
#: Distances of word pairs: neighbours, and skip-grams over one or two words.
GAPS = (1, 2, 3)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Sparse weights; at most 2**BITS of them, so its size is bounded whatever the corpus."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.index] = self.weight
        return w


def _coordinates(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: (text number, coordinate) of every occurrence in the whole texts."""
    words, sizes = [], []
    for t in texts:
        own = words_of(t)
        words += own
        sizes.append(len(own))
    if not words:
        return
    coded = pa.array(words, pa.binary()).dictionary_encode()
    h = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(texts)), sizes)
    shift = np.uint64(64 - BITS)
    yield doc, (h >> shift).astype(np.int64)
    for gap in GAPS:
        same = doc[gap:] == doc[:-gap]
        pair = (h[:-gap] * _ODD + np.uint64(gap)) ^ (h[gap:] >> np.uint64(7))
        yield doc[gap:][same], ((pair * _ODD) >> shift).astype(np.int64)[same]


def feature_rows(texts: list[bytes]) -> list[np.ndarray]:
    """The different coordinates of each text."""
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        found = list(_coordinates(part))
        both = np.unique(np.concatenate([doc << BITS | x for doc, x in found])) if found else np.zeros(0, np.int64)
        cut = np.searchsorted(both >> BITS, np.arange(len(part) + 1))
        both &= (1 << BITS) - 1
        out += [both[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
    return out


def fit(texts: list[bytes], labels: np.ndarray, **settings) -> Model:
    return fit_rows(feature_rows(texts), labels, **settings)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1) -> Model:
    """One pass after another over the rows in the order given; no rows of either class give the constant model."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 30.0 if share else -30.0)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = float(np.log(share / (1 - share))), 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(EPOCHS):
        for x, y in zip(rows, labels):
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[x] = zi + g - sigma * w
            n[x] = ni + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    w = weights(z, n)
    index = np.nonzero(w)[0]
    return Model(index, w[index].astype(np.float32), bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, size: int) -> DataFrame:
    """(doc_id, text, y, h): at most `size` rows that have a 0/1 label and satisfy `keep`, a condition on doc_id.

    An id has one row, that of the smallest text hash (null text last), however often it comes.
    """
    y = labels.select("doc_id", F.col(label).alias("y")).where("doc_id is not null and y in (0, 1)").where(keep)
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(size)
    rows = text_rows(docs).join(F.broadcast(y), "doc_id")  # `size` rows of numbers at most
    first = F.min_by(F.struct("text"), F.struct(F.col("text").isNull(), F.xxhash64("text")))
    return rows.groupBy("doc_id").agg(first["text"].alias("text"), F.first("y").alias("y"), F.first("h").alias("h"))


def train(sample: DataFrame) -> Model:
    """Fit in one task on the bounded sample; only the sparse weights come back.

    Texts stream through the task, which keeps their coordinates alone.
    """
    session(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, rows = [], [], []
        for b in batches:
            rows += feature_rows(utf8(b.column(1)))
            labels += b.column(2).to_pylist()
            keys += zip(b.column(3).to_pylist(), b.column(0).to_pylist())
        order = sorted(range(len(rows)), key=keys.__getitem__)
        model = fit_rows([rows[i] for i in order], np.array([labels[i] for i in order], float))
        index, weight = np.concatenate(([-1], model.index)), np.concatenate(([model.bias], model.weight))
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(weight, pa.float64())], names=["i", "w"])

    got = sample.select("doc_id", "text", "y", "h").repartition(1).mapInArrow(run, "i bigint, w double").toPandas().sort_values("i")
    if got.empty:
        return fit_rows([], np.zeros(0))
    return Model(got["i"].to_numpy()[1:], got["w"].to_numpy()[1:].astype(np.float32), float(got["w"].iloc[0]))


def score_texts(texts: list[bytes], dense: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(texts), bias)
    hits = []
    for doc, x in _coordinates(texts):
        live = dense[x] != 0
        hits.append(doc[live] << BITS | x[live])
    if hits:
        once = np.unique(np.concatenate(hits))
        total += np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _scores(texts: list[bytes], dense: np.ndarray, bias: float) -> np.ndarray:
    """Scores of any number of texts, in parts of a few MB."""
    got, at = np.zeros(len(texts)), 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < 4 << 20):
            size += len(texts[to])
            to += 1
        got[at:to] = score_texts(texts[at:to], dense, bias)
        at = to
    return got


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row; the score of null and empty texts is the model's for no words."""
    spark = session(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = sent.value.dense()
        for b in batches:
            got = _scores(utf8(b.column(1)), dense, sent.value.bias)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["doc_id", "score"])

    rows = text_rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def accept(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold."""
    spark = session(docs.sparkSession)
    sent, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = sent.value.dense()
        for b in batches:
            yield b.filter(pa.array(_scores(utf8(b.column(at)), dense, sent.value.bias) < threshold))

    return docs.mapInArrow(run, docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, sample: int = SAMPLE) -> Model:
    """A model of the labels of rows with crc32(doc_id) mod `fold` other than `held`."""
    return train(labelled_sample(docs, labels, "toxic", F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != held, sample))


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs.

    Labels are learned from rows with crc32(doc_id) mod `fold` other than `held`. Without labels, or with one class
    only, every score is that class's constant. Null ids are never held out; null labels and ids are not learned from;
    of repeated labels the largest counts; repeated rows score alike. No text is an empty one. Other columns are
    ignored.
    """
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold
    return score(docs, fitted(docs, labels, fold, held, sample)).select(
        "doc_id", F.coalesce(part == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
