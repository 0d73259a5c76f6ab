"""Benchmark decontamination over a distributed positional inverted index.

The index consists of self-contained segments, each a few MB of training text: a term dictionary, and for each term the
sorted positions of its occurrences, delta-coded. Segments are written to the shared folder, one row each. A phrase is
searched in every segment at once: the terms' list lengths rule out most segments, then the offset-adjusted lists are
intersected from the rarest term on. A search never moves a segment between tasks, as a document lies in one of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomtrace.llm.common import blocks, materialise, session, text_rows, utf8, words_of

#: Bytes of text in a segment, about; a longer document is a segment of its own.
SEGMENT_BYTES = 3 << 20
#: Bytes of test items that one pass over the index searches; more items take more passes. A pass sends some ten times
#: as much to each worker at the very most, if all words are of one letter, and about four times as much of prose.
QUERY_BYTES = 8 << 20
#: Places of rarest terms that are intersected at a time, and phrases whose terms are ordered at a time.
PLACES = 1 << 20
PHRASES = 1 << 15


@dataclass
class Segment:
    """Positions number a segment's words, with one left free after each document so no phrase runs across."""

    doc_ids: list
    sizes: np.ndarray
    terms: dict[bytes, int]
    counts: np.ndarray
    deltas: np.ndarray

    def __post_init__(self):
        self.ends = np.cumsum(self.counts)
        self.first = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.span = int((self.sizes + 1).sum()) + 1
        self._lists: dict[int, np.ndarray] = {}
        self._all: np.ndarray | None = None

    @property
    def combined(self) -> np.ndarray:
        """All postings lists one after the other, as term * span + position: in order, so one search finds a place in any list."""
        if self._all is None:
            whole = np.cumsum(self.deltas, dtype=np.int64)
            starts = self.ends - self.counts
            before = np.where(starts > 0, whole[np.maximum(starts, 1) - 1], 0)
            term = np.repeat(np.arange(len(self.counts)), self.counts)
            self._all = whole - before[term] + term * self.span
        return self._all

    def postings(self, term: int) -> np.ndarray:
        if term not in self._lists:
            self._lists[term] = np.cumsum(self.deltas[self.ends[term] - self.counts[term] : self.ends[term]], dtype=np.int64)
        return self._lists[term]

    def phrases(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase number, start) wherever the terms of a row stand consecutively, some phrases at a time.

        Each phrase takes the list of its rarest term, adjusted by the term's offset, and intersects it with the lists
        of its other terms from the next rarest on. All phrases take a step together.
        """
        counts, n = self.counts.astype(np.int64), terms.shape[1]
        ends = self.ends.astype(np.int64)
        for lo in range(0, len(terms), PHRASES):
            own = terms[lo : lo + PHRASES]
            order = np.argsort(counts[own], axis=1, kind="stable")
            rare = own[np.arange(len(own)), order[:, 0]]
            places = np.cumsum(counts[rare])
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(places, (places[a - 1] if a else 0) + PLACES, "right")))
                size = counts[rare[a:b]]
                which = np.repeat(np.arange(a, b), size)
                at = np.arange(len(which)) + np.repeat((ends - counts)[rare[a:b]] - (np.cumsum(size) - size), size)
                start = self.combined[at] - rare[which] * self.span - order[which, 0]
                keep = (start >= 0) & (start + n < self.span)
                which, start = which[keep], start[keep]
                for k in range(1, n):
                    if not len(which):
                        break
                    i = order[which, k]
                    sought = own[which, i] * self.span + start + i
                    at = np.minimum(np.searchsorted(self.combined, sought), len(self.combined) - 1)
                    keep = self.combined[at] == sought
                    which, start = which[keep], start[keep]
                if len(which):
                    yield which + lo, start
                a = b

    def near(self, terms: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) positions of the spans of at most `width` words that hold every term, in any order.

        One span for each place that begins one: the shortest. No span runs across documents.
        """
        lists = [self.postings(t) for t in sorted(set(terms), key=lambda t: self.counts[t])]
        rare = lists[0]  # a span holds one of these, with every other term less than `width` words away
        for held in lists[1:]:
            at = np.minimum(np.searchsorted(held, rare - width, "right"), len(held) - 1)
            rare = rare[np.abs(held[at] - rare) < width]
            if not len(rare):
                return rare, rare
        begins = []
        for held in lists:
            start = np.searchsorted(held, rare - width, "right")
            n = np.searchsorted(held, rare, "right") - start
            begins.append(held[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        first = np.unique(np.concatenate(begins))
        last = first.copy()
        for held in lists:
            at = np.searchsorted(held, first)
            first, last, at = (x[at < len(held)] for x in (first, last, at))
            last = np.maximum(last, held[at])
            ok = last - first < width
            first, last = first[ok], last[ok]
        same = np.searchsorted(self.first, first, "right") == np.searchsorted(self.first, last, "right")
        return first[same], last[same]


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table: a row for each segment."""
    session(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        for number, table in enumerate(t for b in blocks(batches, SEGMENT_BYTES, "text") for t in _parts(b)):
            words, sizes = [], []
            for text in utf8(table.column("text").combine_chunks()):
                own = words_of(text)
                words += own
                sizes.append(len(own))
            sizes = np.array(sizes, np.int64)
            coded = pa.array(words, pa.binary()).dictionary_encode()
            codes = coded.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            position = order + np.repeat(np.arange(len(sizes)), sizes)[order]
            counts = np.bincount(codes, minlength=len(coded.dictionary))
            delta = np.diff(position, prepend=0)
            head = (np.cumsum(counts) - counts)[counts > 0]
            delta[head] = position[head]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([pid << 32 | number], pa.int64()), pa.array([table.column("doc_id").to_pylist()], pa.list_(table.schema.field("doc_id").type)),
                    pa.array([sizes.astype("<u4").tobytes()], pa.binary()), pa.array([b" ".join(coded.dictionary.to_pylist())], pa.binary()),
                    pa.array([counts.astype("<u4").tobytes()], pa.binary()), pa.array([delta.astype("<u4").tobytes()], pa.binary()),
                ],
                names=["segment", "doc_ids", "sizes", "terms", "counts", "deltas"],
            )

    return rows.mapInArrow(run, f"segment bigint, doc_ids array<{kind}>, sizes binary, terms binary, counts binary, deltas binary")


def _parts(table: pa.Table) -> Iterator[pa.Table]:
    """Slices of about SEGMENT_BYTES of text."""
    sizes = np.array([len(t) for t in utf8(table.column("text").combine_chunks())])
    cut = np.nonzero(np.diff((np.cumsum(sizes) - 1) // SEGMENT_BYTES, prepend=-1))[0].tolist()
    cut = sorted({0, *cut})
    for a, b in zip(cut, [*cut[1:], table.num_rows]):
        yield table.slice(a, b - a)


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Segment]]:
    for b in batches:
        for i in range(b.num_rows):
            number, ids, sizes, terms, counts, deltas = (b.column(c)[i].as_py() for c in range(6))
            names = terms.split(b" ") if terms else []
            yield number, Segment(ids, np.frombuffer(sizes, "<u4").astype(np.int64), {t: j for j, t in enumerate(names)}, np.frombuffer(counts, "<u4"), np.frombuffer(deltas, "<u4"))


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All runs of `width` words; fewer words, but not none, are one window."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def _csr(group: np.ndarray, member: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each group's members start, members): distinct ones, in order."""
    pairs = np.unique(np.stack((group, member), 1), axis=0) if len(group) else np.zeros((0, 2), np.int64)
    return np.concatenate(([0], np.cumsum(np.bincount(pairs[:, 0], minlength=n)))), pairs[:, 1].astype(np.int32)


class Phrases:
    """Distinct phrases of a bounded set of test items, in flat arrays: a phrase is a place and a size in the items' term
    numbers, so overlapping windows share their terms.

    For proximity a phrase's terms may stand in any order within `reach` times its words, and an item longer than
    `width` words is one more such phrase as a whole.
    """

    def __init__(self, items: list[tuple[object, bytes]], width: int, reach: float | None = None):
        self.reach = reach
        known: dict[object, int] = {}
        words, sizes, owner = [], [], []
        for item, text in items:
            own = words_of(text)
            words += own
            sizes.append(len(own))
            owner.append(known.setdefault(item, len(known)))
        self.items = list(known)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        self.terms = b" ".join(coded.dictionary.to_pylist())
        self.codes = coded.indices.to_numpy().astype(np.int32)
        sizes, owner = np.array(sizes, np.int64), np.array(owner, np.int64)
        first = np.cumsum(sizes) - sizes
        #: By size of phrase: places of its distinct phrases, and the numbers of the items that have them.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(n, width) for n in sizes.tolist() if n}):
            own = np.nonzero(sizes == size if size < width else sizes >= width)[0]
            n = sizes[own] - size + 1
            at = np.arange(n.sum()) + np.repeat(first[own] - (np.cumsum(n) - n), n)
            self.windows[size] = self._distinct(at, size, np.repeat(owner[own], n))
        #: Whole items that are longer, each with its own size, where proximity is asked for.
        self.wholes: list[tuple[int, int, int]] = []
        if reach is not None:
            self.wholes = [(int(first[i]), int(sizes[i]), int(owner[i])) for i in np.nonzero(sizes > width)[0]]

    def _distinct(self, at: np.ndarray, size: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.codes, size)[at])
        _, index, inverse = np.unique(rows.view(np.dtype((np.void, rows.itemsize * size))).ravel(), return_index=True, return_inverse=True)
        return at[index].astype(np.int32), *_csr(inverse, owner, len(index))

    def search(self, segment: Segment) -> list[tuple[np.ndarray, list[set[int]]]]:
        """(whether each position is hit, the items found in each document), exactly and, with a reach, by proximity."""
        kinds = [(np.zeros(segment.span, np.int64), [set() for _ in segment.doc_ids]) for _ in range(1 if self.reach is None else 2)]
        if not len(self.codes) or not segment.terms:
            return [(np.cumsum(hit) > 0, found) for hit, found in kinds]
        local = np.array([segment.terms.get(t, -1) for t in self.terms.split(b" ")])[self.codes]
        present = np.concatenate(([0], np.cumsum(local >= 0)))

        def mark(kind: int, first: np.ndarray, stop: np.ndarray, owners: Iterable) -> None:
            hit, found = kinds[kind]
            np.add.at(hit, first, 1)
            np.add.at(hit, stop, -1)
            docs = np.searchsorted(segment.first, first, "right") - 1
            for d, own in {(d, o): None for d, o in zip(docs.tolist(), owners)}:
                found[d].update(own)

        def near(at: int, size: int, owners: tuple[int, ...]) -> None:
            first, last = segment.near(local[at : at + size].tolist(), int(self.reach * size))
            mark(1, first, last + 1, [owners] * len(first))

        for size, (places, heads, members) in self.windows.items():
            some = np.nonzero(present[places + size] - present[places] == size)[0]  # every term occurs
            if not len(some):
                continue
            owners = lambda i: tuple(members[heads[i] : heads[i + 1]].tolist())
            terms = np.lib.stride_tricks.sliding_window_view(local, size)[places[some]]
            for which, start in segment.phrases(terms):
                mark(0, start, start + size, map(owners, some[which].tolist()))
            if self.reach is not None:
                for i in some.tolist():
                    near(int(places[i]), size, owners(i))
        for at, size, owner in self.wholes:
            if present[at + size] - present[at] == size:
                near(at, size, (owner,))
        return [(np.cumsum(hit) > 0, found) for hit, found in kinds]


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """The items, brought to the driver in blocks of QUERY_BYTES of text."""
    held, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        held.append((r["i"], r["t"].encode()))
        size += len(held[-1][1])
        if size >= QUERY_BYTES:
            yield held
            held, size = [], 0
    yield held


SPANS = "array<struct<start:bigint,end:bigint>>"


def search(index: DataFrame, items: DataFrame, width: int = 10, item_col: str = "item_id", text_col: str = "text", reach: float | None = 2) -> DataFrame:
    """(doc_id, n_words, spans, items, near, near_items): one row per indexed row; spans are the hit word ranges [start, end).

    A window is `width` consecutive words of an item, or all words of a shorter one. items: the distinct ids of items
    that have a window in the text; a null item id marks words but isn't listed. near and near_items are the same for
    proximity: the ranges that hold all words of a window, or of a whole item, in any order, repeated words once, in at
    most `reach` times its number of words, from each word that begins such a range the shortest; ranges that overlap
    or touch are joined. No reach: exact matches alone, without these columns. Items are searched in blocks, so what
    is sent to the tasks is bounded; with several blocks their results meet by row.
    """
    spark = session(index.sparkSession)
    item_kind = items.schema[item_col].dataType.simpleString()
    doc_kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    columns = [("spans", "items")] if reach is None else [("spans", "items"), ("near", "near_items")]
    out = f"segment bigint, ordinal int, doc_id {doc_kind}, n_words bigint" + "".join(f", {s} {SPANS}, {i} array<{item_kind}>" for s, i in columns)

    def one(block: list[tuple[object, bytes]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Phrases(block, width, reach))  # QUERY_BYTES of text at most
        item_type, doc_type = pa.list_(to_arrow_type(items.schema[item_col].dataType)), to_arrow_type(index.schema["doc_ids"].dataType.elementType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, s in _segments(batches):
                names, arrays, n = sent.value.items, [], len(s.doc_ids)
                for hit, found in sent.value.search(s):
                    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                    begin, end = np.nonzero(edge > 0)[0], np.nonzero(edge < 0)[0]
                    doc = np.searchsorted(s.first, begin, "right") - 1
                    spans: list[list[dict]] = [[] for _ in s.doc_ids]
                    for d, a, b in zip(doc.tolist(), (begin - s.first[doc]).tolist(), (end - s.first[doc]).tolist()):
                        spans[d].append({"start": a, "end": b})
                    got = [[names[i] for i in sorted(f) if names[i] is not None] for f in found]
                    arrays += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(got, item_type)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(s.doc_ids, doc_type),
                        pa.array(s.sizes), *arrays,
                    ],
                    names=["segment", "ordinal", "doc_id", "n_words", *(c for pair in columns for c in pair)],
                )

        return index.mapInArrow(run, out)

    parts = [one(block) for block in _item_blocks(items, item_col, text_col)]
    if len(parts) == 1:
        return parts[0].drop("segment", "ordinal")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    both = both.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        *(F.sort_array(F.flatten(F.collect_list(s))).alias(s) for s, _ in columns), *(F.array_distinct(F.flatten(F.collect_list(i))).alias(i) for _, i in columns),
    )
    # hit ranges of several passes may overlap: fold the sorted ones into disjoint ones
    merged = lambda spans: F.expr(f"""
        aggregate({spans}, cast(array() as {SPANS}), (acc, x) ->
            case when size(acc) > 0 and element_at(acc, -1).end >= x.start
                 then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
                 else concat(acc, array(x)) end)
    """)  # noqa: E731
    return both.select("doc_id", "n_words", *(c for s, i in columns for c in (merged(s).alias(s), i)))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", reach: float | None = None) -> DataFrame:
    """(doc_id, n_words, spans, items): index the texts, write the index, search the items in it; see `search`.

    With a reach, near and near_items follow.

    Ids of documents and items may be of any type that compares; null ids are kept (see `search` for items). Null and
    empty texts have no words; repeated rows and ids each give their row; an empty table gives an empty
    result, no items give no hits; other columns are ignored.
    """
    return search(materialise(build(docs, id_col, text_col), "index"), items, width, reach=reach)
