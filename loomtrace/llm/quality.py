"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted trees over the statistics of a bounded labelled sample give rules: every path from a root is a conjunction of
thresholds. A logistic model with an L1 penalty over the rules keeps a few of them. Rules and weights compile to one
Spark column expression, which scores every text's statistics inside Catalyst.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import session, text_rows, utf8
from loomtrace.llm.toxicity import labelled_sample
from loomtrace.llm.trees import Node, boost

#: Labelled rows that training uses at most: those with the smallest hashes of their ids.
SAMPLE = 8000
STATISTICS = (
    "log_bytes", "upper", "digits", "spaces", "newlines", "symbols", "shouts", "stops", "non_ascii", "controls",
    "log_words", "word_bytes", "distinct_words", "top_word", "short_words", "long_words", "marked_words", "repeated_lines", "line_bytes", "repeated_runs",
)
_CLASS = np.zeros((9, 256), np.float64)
for _row, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b"#$%&*@^~|<>{}[]\\/+=_", b"!?", b".,;:'\"()-", bytes(range(128, 256)), bytes([*range(9), 11, 12, *range(14, 32), 127]))):
    _CLASS[_row, list(_bytes)] = 1
_MARKS = frozenset(b"#$%&*@^~!<>|")


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of one whole text; all zero for an empty one."""
    size = len(text)
    if not size:
        return [0.0] * len(STATISTICS)
    share = (_CLASS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size).tolist()
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n = len(words) or 1
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    counts = Counter(words)
    runs = set(zip(words, words[1:], words[2:]))
    return [
        float(np.log1p(size)), *share, float(np.log1p(len(words))), float(lengths.sum()) / n, len(counts) / n, max(counts.values(), default=0) / n,
        float((lengths <= 3).sum()) / n, float((lengths >= 15).sum()) / n, sum(w[-1] in _MARKS for w in words) / n,
        1 - len(set(lines)) / (len(lines) or 1), size / (len(lines) or 1), 1 - len(runs) / max(1, len(words) - 2) if len(words) > 2 else 0.0,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the STATISTICS as doubles): one row per row; null text counts as empty."""
    session(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t) for t in utf8(b.column(1))]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in rows.T)], names=["doc_id", *STATISTICS])

    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Holds where every (statistic, cut, above) does: value > cut if above, else value <= cut."""

    parts: tuple[tuple[int, float, bool], ...]

    def matches(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, cut, above in self.parts:
            out &= (x[:, f] > cut) == above
        return out

    def column(self) -> Column:
        out = None
        for f, cut, above in self.parts:
            c = F.col(STATISTICS[f])
            part = c > F.lit(cut) if above else c <= F.lit(cut)
            out = part if out is None else out & part
        return out


def rules_of(trees: list[Node]) -> list[Rule]:
    """Every root path of every tree once, simplified to one bound a side for each statistic."""
    found: dict[Rule, None] = {}

    def walk(node: Node, path: dict[tuple[int, bool], float]) -> None:
        if path:
            found[Rule(tuple((f, cut, above) for (f, above), cut in sorted(path.items())))] = None
        if node.feature < 0:
            return
        f, cut = node.feature, node.cut
        walk(node.left, path | {(f, False): min(cut, path.get((f, False), cut))})
        walk(node.right, path | {(f, True): max(cut, path.get((f, True), cut))})

    for tree in trees:
        walk(tree, {})
    return list(found)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient; the intercept has no penalty."""
    n, k = x.shape
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    u = np.ones(k + 1)
    for _ in range(15):  # largest eigenvalue of the design's Gram matrix
        u = np.append(x.T @ (z := x @ u[:-1] + u[-1]), z.sum())
        top = np.linalg.norm(u)
        u /= top
    step = 4 * n / (1.05 * top)
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y) / n
        raw = v - step * (x.T @ r)
        w2 = np.sign(raw) * np.maximum(np.abs(raw) - step * penalty, 0)
        b2 = c - step * float(r.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.0005, trees: int = 30) -> Ensemble:
    """No rows of either class give a constant: 0.0 without rows, else nearly that class."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Ensemble((), 30.0 if share else -30.0)
    rules = rules_of(boost(x, y, trees=trees, depth=3, rate=0.3, least=2.0).trees)
    if not rules:
        return Ensemble((), float(np.log(share / (1 - share))))
    held = np.stack([r.matches(x) for r in rules], 1).astype(float)
    w, b = lasso(held, y, penalty)
    return Ensemble(tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4), b)


def quality(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs.

    Labels are learned from rows with crc32(doc_id) mod `fold` other than `held`; the statistics of at most `sample`
    such rows go to the driver. Without labels, or with one class only, every score is that class's constant. Null ids
    are never held out; null labels and ids are not learned from; of repeated labels the largest counts; repeated rows
    score alike. Null and empty texts have all-zero statistics. Other columns are ignored.
    """
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold
    chosen = labelled_sample(docs, labels, "quality", part != held, sample)
    got = with_statistics(chosen).toPandas().merge(chosen.select("doc_id", "y", "h").distinct().toPandas(), on="doc_id")
    got = got.sort_values(["h", "doc_id"])
    model = fit(got[list(STATISTICS)].to_numpy(float), got["y"].to_numpy(float))
    return with_statistics(docs).select(
        "doc_id", F.coalesce(part == held, F.lit(False)).alias("held_out"), model.column().alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
