"""Exact substring deduplication with suffix arrays built by two-stage sorting.

A string of `length` bytes that also starts earlier is to go. Every start of such a string (a window) has an anchor:
the GRAM-byte piece inside it with the smallest hash, leftmost on ties. Equal windows have equal anchors at equal
offsets, so windows are compared only within an anchor's group. Neighbouring windows with one anchor form a run; a
run's bytes are its context. Hashes only say which contexts meet; whether strings are equal is told by their bytes.

1. Texts are cut into runs. A task counts each anchor's runs and sends one of them, with the number, to the anchor's
   group; so a frequent anchor is a row for each task there, not one for each run. Runs that are alone are done.
2. The contexts of all others are cut from the texts and sent to their group. A group with more than `hot` of them is
   dealt window by window instead, by the hash of the whole window, and windows whose bytes were seen before in the
   task don't go.
3. Groups stream through a task in order of their keys. It lays their contexts end to end in document order and builds
   one suffix array by two-stage sorting: only suffixes smaller than their successors are sorted directly, all others
   are induced by scanning the buckets in order. Neighbours with a common prefix of `length` bytes are equal windows;
   all but the first in the text are repeats.
4. Repeats, merged to spans of bytes, are cut out of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomtrace.llm.common import blocks, materialise, session, utf8

GRAM = 32
#: Bytes of text that are cut into runs at a time, and that one suffix array covers (a larger group has its own).
BLOCK = 1 << 20
#: A place in such a block, with one window more, takes so many bits. Anchors are the least of the hashes' other bits.
PLACE_BITS = 21
CHUNK = 1 << 18
#: Runs that a task counts at a time, and rows of a batch that it sends.
COUNTED = 1 << 20
BATCH = 1 << 16
#: A group of more contexts is dealt by whole windows; of those a task remembers SEEN different ones.
HOT = 4_000
SEEN = 1 << 17
#: Up to so many anchors of such groups are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: A run's place is start * PLACE + number of windows, so a length has to be below.
PLACE = 1 << 16
#: Stands for a null id; the tie of such a row is negative, that of others isn't.
_NULL = -(1 << 63)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- suffix arrays -------------------------------------------------------------------------------------------------


def _word_keys(text: np.ndarray, beyond: int) -> np.ndarray:
    """For each position, and `beyond` more, the next eight bytes as a big-endian number; zeros follow the end."""
    padded = np.concatenate((text, np.zeros(beyond + 8, np.uint8)))
    return np.ndarray((len(text) + beyond,), ">u8", padded, strides=(1,)).astype(np.uint64)


def ascending(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the empty suffix is the smallest of all."""
    n = len(text)
    out = np.zeros(n, bool)
    if n > 1:
        nearer = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
        change = np.minimum.accumulate(nearer[::-1])[::-1]  # next place whose byte differs from its successor's
        known = change < n - 1
        out[:-1][known] = text[change[known]] < text[change[known] + 1]
    return out


def _gram_hashes(keys: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position where they fit, from `_word_keys`, by doubling."""
    h, size = keys * _A, 8
    while size < GRAM:
        x, y = h[:-size], h[size:]
        h = (x ^ (x >> np.uint64(29))) * _A + (y ^ (y >> np.uint64(32))) * _B
        size *= 2
    return h ^ (h >> np.uint64(31))


def _prefix_hashes(keys: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
    """A hash of the first `depth` bytes, or eight if that is more, of the `chosen` suffixes."""
    h = keys[chosen] * _A
    for at in [*range(8, depth - 7, 8), *([depth - 8] if depth > 8 and depth % 8 else [])]:
        h = ((h ^ (h >> np.uint64(29))) + keys[chosen + at]) * _A
    return (h ^ (h >> np.uint64(32))) * _B


def _by_rounds(keys: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
    """`chosen` suffixes in order of their first `depth` bytes or more, eight bytes a round.

    A round looks at suffixes that are still tied only, and sorts those of groups in which the eight bytes differ.
    """
    order = chosen[np.argsort(keys[chosen], kind="stable")]
    if len(order) < 2:
        return order
    first = keys[order]
    new = np.concatenate(([True], first[1:] != first[:-1]))  # where a group of tied suffixes starts
    for at in range(8, depth, 8):
        tied = np.nonzero(~new | np.append(~new[1:], False))[0]
        if not len(tied):
            break
        group = np.cumsum(new[tied])
        key = keys[order[tied] + at]
        differs = (key[1:] != key[:-1]) & ~new[tied[1:]]
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][differs]] = True
        some = mixed[group]
        tied, group, key = tied[some], group[some], key[some]
        by = np.lexsort((key, group))
        order[tied] = order[tied[by]]
        key = key[by]
        new[tied[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return order


def _sort_directly(keys: np.ndarray, chosen: np.ndarray, depth: int, hashed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(`chosen` suffixes in order of their first `depth` bytes or more, which of them were taken for equal to the one before).

    With `hashed`, suffixes whose first `depth` bytes have one hash are sorted as one, in order of the text; the caller
    has to check that they are equal.
    """
    if not hashed or len(chosen) < 2:
        return _by_rounds(keys, chosen, depth), np.zeros(len(chosen), bool)
    low = np.uint64((1 << int(len(chosen)).bit_length()) - 1)
    packed = np.sort((_prefix_hashes(keys, chosen, depth) & ~low) | np.arange(len(chosen), dtype=np.uint64))
    member = chosen[(packed & low).astype(np.int64)]
    first = keys[member]
    head = np.concatenate(([True], ((packed[1:] & ~low) != (packed[:-1] & ~low)) | (first[1:] != first[:-1])))
    start = np.nonzero(head)[0]
    size = np.diff(np.append(start, len(member)))
    block = np.empty(len(keys), np.int64)
    block[member[start]] = np.arange(len(start))
    block = block[_by_rounds(keys, member[start], depth)]
    size = size[block]
    at = np.repeat(start[block] - (np.cumsum(size) - size), size) + np.arange(len(member))
    return member[at], ~head[at]


def _suffix_array(text: np.ndarray, keys: np.ndarray, depth: int, wanted: np.ndarray, rising: np.ndarray, hashed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the wanted suffixes, ordered by at least their first `depth` bytes, and which were taken for equal to the one before."""
    n = len(text)
    counts = np.bincount(text[wanted], minlength=256)
    ends = np.cumsum(counts)
    heads = ends - counts
    sorted_rising, equal = _sort_directly(keys, np.nonzero(rising & wanted)[0], depth, hashed)
    first = text[sorted_rising]
    rising_counts = np.bincount(first, minlength=256)
    sa, same = np.full(ends[-1], -1, np.int64), np.zeros(ends[-1], bool)
    offsets = np.cumsum(rising_counts) - rising_counts
    place = (ends - rising_counts)[first] + np.arange(len(first)) - offsets[first]
    sa[place], same[place] = sorted_rising, equal
    fill = heads.copy()
    induced = np.append(wanted & ~rising, False)  # the last one is for the place before the first

    def induce(found: np.ndarray) -> None:
        """Put the predecessors of suffixes scanned in order at the fronts of their buckets, if not sorted directly."""
        before = found - 1
        before = before[induced[before]]
        byte = text[before]
        by = np.argsort(byte, kind="stable")
        byte, before = byte[by], before[by]
        got = np.bincount(byte, minlength=256)
        sa[fill[byte] + np.arange(len(byte)) - (np.cumsum(got) - got)[byte]] = before
        fill[:] += got

    induce(np.array([n]))
    for c in np.nonzero(counts)[0]:
        at = heads[c]
        while at < fill[c]:  # a bucket's own additions come in further rounds, one for each repeat of its byte
            to = fill[c]
            induce(sa[at:to])
            at = to
        induce(sa[ends[c] - rising_counts[c] : ends[c]])
    return sa, same


def common_prefixes(text: np.ndarray, keys: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the array, `cap` at most; 0 for the first.

    Where a suffix and the one that it follows in the array both step on by one, so do their prefixes: bytes are
    compared once along such a stretch, and in full only where it ends.
    """
    m = len(sa)
    if m < 2:
        return np.zeros(m, np.int64)
    before = np.full(len(text), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.sort(sa)
    other = before[own]
    equal = (other >= 0) & (text[own] == text[other])
    steps = np.append((other[1:] == other[:-1] + 1) & (own[1:] == own[:-1] + 1), False)
    stop = np.nonzero(~(equal & steps))[0]
    a, b = own[stop], other[stop]
    known = np.zeros(len(stop), np.int64)
    look = np.nonzero(equal[stop])[0]
    for at in range(0, cap, 8):
        if not len(look):
            break
        x = keys[a[look] + at] ^ keys[b[look] + at]
        known[look] = at
        for bits in range(8, 64, 8):
            known[look] += x < np.uint64(1 << bits)
        look = look[x == 0]
        known[look] = at + 8
    known = np.minimum(known, len(text) - np.maximum(a, b))
    before[own] = np.minimum(np.repeat(known + stop, np.diff(stop, prepend=-1)) - np.arange(m), cap)
    return before[sa]


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts of suffixes in order of their first `depth` bytes or more, common prefixes up to `depth`).

    All suffixes, or those that are `wanted` and what they are induced from. Ties beyond `depth` come in any order.
    Suffixes that only a hash took for equal are found by their common prefixes; then all are sorted by their bytes alone.
    """
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, rising = _word_keys(text, depth + 16), ascending(text)
    if wanted is None:
        wanted = np.ones(len(text), bool)
    else:  # up to the next suffix that is sorted directly
        direct = np.append(np.nonzero(rising)[0], len(text) - 1)
        at = np.nonzero(wanted & ~rising & ~np.append(wanted[1:], False))[0]
        to = direct[np.searchsorted(direct, at)]
        wanted = wanted.copy()
        wanted[np.repeat(at - (np.cumsum(to - at) - (to - at)), to - at) + np.arange((to - at).sum()) + 1] = True
    sa, same = _suffix_array(text, keys, depth, wanted, rising, True)
    lcp = common_prefixes(text, keys, sa, depth)
    at = np.nonzero(same)[0]
    if (lcp[at] < np.minimum(depth, len(text) - np.maximum(sa[at], sa[at - 1]))).any():
        sa, _ = _suffix_array(text, keys, depth, wanted, rising, False)
        lcp = common_prefixes(text, keys, sa, depth)
    return sa, lcp


# --- runs ----------------------------------------------------------------------------------------------------------


def _runs(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, start in it, windows, anchor hash) of each run of a block of texts."""
    fits = np.maximum(sizes - length + 1, 0)
    if not fits.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h = _gram_hashes(_word_keys(buffer, 0))[: len(buffer) - GRAM + 1]
    n = len(buffer) - length + 1
    shift = np.uint64(PLACE_BITS)
    low = (h >> shift << shift) | np.arange(len(h), dtype=np.uint64)  # equal hashes: the leftmost is smallest
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    anchor = (low & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), fits)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(fits) - fits, fits)
    a = anchor[starts[owner] + window]
    first = np.nonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1]))))[0]
    return owner[first], window[first], np.diff(np.append(first, len(a))), h[a[first]]


def _joined(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring repeated windows of a text as one entry."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, count = doc[order], tie[order], start[order], count[order]
    if not len(doc):
        return doc, tie, start, count
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1] + count[:-1])))
    head = np.nonzero(new)[0]
    return doc[head], tie[head], start[head], np.add.reduceat(count, head)


_RUN = "part bigint, key bigint, n bigint, doc bigint, tie bigint, place bigint"
_CONTEXT = "key bigint, doc bigint, tie bigint, start bigint, known bigint, context binary"
_REPEAT = "doc bigint, tie bigint, start bigint, count bigint"


def _mixed(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Spreads rows that need no group over the tasks."""
    return ((doc.view(np.uint64) * _A) ^ (tie.view(np.uint64) * _B)).view(np.int64)


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for at in range(0, n, BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + BATCH]) for c in columns.values()], names=list(columns))


def _cut_runs(length: int):
    """Texts -> runs. n: of one run of each anchor, the number of its runs that were counted together; 0 of the others."""

    def counted(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, tie, place, key = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        first = np.nonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]])))[0]
        n = np.zeros(len(key), np.int64)
        n[order[first]] = np.diff(np.append(first, len(key)))
        key = key.view(np.int64)
        yield from _batches({"part": np.where(n > 0, key, _mixed(doc, tie)), "key": key, "n": n, "doc": doc, "tie": tie, "place": place})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0
        for table in blocks(batches, BLOCK, "text"):
            texts = utf8(table.column("text").combine_chunks())
            doc, tie = table.column("doc").to_numpy(), table.column("tie").to_numpy()
            # a longer text comes in pieces that share no window; that only cuts a run in two
            pieces = [(i, at, t[at : at + BLOCK + length - 1] if len(t) > BLOCK else t) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), BLOCK)]
            at = 0
            while at < len(pieces):
                to, size = at, 0
                while to < len(pieces) and (to == at or size + len(pieces[to][2]) <= BLOCK):
                    size += len(pieces[to][2])
                    to += 1
                which, offset = (np.array([p[k] for p in pieces[at:to]]) for k in (0, 1))
                sizes = np.array([len(p[2]) for p in pieces[at:to]])
                buffer = np.frombuffer(b"".join(p[2] for p in pieces[at:to]), np.uint8)
                owner, start, count, key = _runs(buffer, np.cumsum(sizes) - sizes, sizes, length)
                if len(owner):
                    held.append((doc[which[owner]], tie[which[owner]], (start + offset[owner]) * PLACE + count, key))
                    total += len(owner)
                at = to
                if total >= COUNTED:
                    yield from counted(held)
                    held, total = [], 0
        if held:
            yield from counted(held)

    return run


def _windows(text: bytes, place: tuple[int, int], start: int, count: int, length: int, seen: dict[bytes, tuple]) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(key, start, known repeats, bytes): the windows of a run one by one; stretches of those seen earlier in the text order as one."""
    known = 0
    for p in range(start, start + count):
        window = text[p : p + length]
        before = seen.get(window)
        if before is not None and before < (*place, p):
            known += 1
            continue
        if known:
            yield 0, p - known, known, None
            known = 0
        if before is not None or len(seen) < SEEN:
            seen[window] = (*place, p)
        yield xxhash.xxh3_64_intdigest(window), p, 0, window
    if known:
        yield 0, start + count - known, known, None


def _cut_contexts(length: int):
    """Texts with their runs that aren't alone -> contexts; runs of crowded anchors go window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for b in batches:
            texts, doc, tie, runs = utf8(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)
            owner = np.repeat(np.arange(b.num_rows), runs.value_lengths().to_numpy())
            runs = runs.flatten()
            key, place, crowded = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("key", "place", "crowded"))
            start, count = place // PLACE, place % PLACE
            for at in range(0, len(owner), BATCH):
                own = np.arange(at, min(at + BATCH, len(owner)))
                own = own[~crowded[own]]
                o, s = owner[own], start[own]
                parts = [texts[i][x:y] for i, x, y in zip(o.tolist(), s.tolist(), (s + count[own] + length - 1).tolist())]
                yield _contexts(key[own], doc[o], tie[o], s, np.zeros(len(own), np.int64), parts)
            out: list[tuple] = []
            for r in np.nonzero(crowded)[0].tolist():
                i = int(owner[r])
                out += [(i, *w) for w in _windows(texts[i], (int(doc[i]), int(tie[i])), int(start[r]), int(count[r]), length, seen)]
                if len(out) >= BATCH or (out and r == len(owner) - 1):
                    yield _sent(out, doc, tie)
                    out = []
            if out:
                yield _sent(out, doc, tie)

    return run


def _contexts(key, doc, tie, start, known, parts) -> pa.RecordBatch:
    columns = [pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(start, pa.int64()), pa.array(known, pa.int64()), pa.array(parts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "doc", "tie", "start", "known", "context"])


def _sent(rows: list[tuple], doc: np.ndarray, tie: np.ndarray) -> pa.RecordBatch:
    owner, key, start, known, parts = zip(*rows)
    o, known = np.array(owner), np.array(known, np.int64)
    key = np.where(known > 0, _mixed(doc[o], tie[o]), np.array(key, np.uint64).view(np.int64))
    return _contexts(key, doc[o], tie[o], np.array(start, np.int64), known, list(parts))


def repeats(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(part number, offset) of each window that also starts earlier in the parts, which are in document order."""
    buffer = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # no UTF-8 text has this byte
    sizes = np.array([len(p) + 1 for p in parts])
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(parts)), sizes)
    begins = np.arange(len(buffer)) <= (base + sizes - 1 - length)[owner]
    sa, lcp = suffix_array(buffer, length, begins)
    whole = begins[sa]
    same = np.zeros(len(sa), bool)
    same[1:] = (lcp[1:] >= length) & whole[1:] & whole[:-1]
    if not same.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(~same) - 1
    lowest = np.minimum.reduceat(sa, np.nonzero(~same)[0])
    later = sa[lowest[group] != sa]
    return owner[later], later - base[owner[later]]


def _repeats(doc, tie, start, count) -> pa.RecordBatch:
    columns = _joined(doc, tie, start, count)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "tie", "start", "count"])


def _sort_contexts(length: int):
    """Contexts in order of their keys -> repeats. Holds CHUNK bytes, or one larger group."""

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, doc, tie, start, known = (table.column(c).to_numpy() for c in ("key", "doc", "tie", "start", "known"))
        parts = [p or b"" for p in table.column("context").to_pylist()]
        told = np.nonzero(known)[0]
        if len(told):
            yield _repeats(doc[told], tie[told], start[told], known[told])
        own = np.nonzero(known == 0)[0]
        own = own[np.lexsort((start[own], tie[own], doc[own]))].tolist()
        if own:
            copies: dict[bytes, int] = {}
            laid, alike = [], []
            for i in own:
                n = copies[parts[i]] = copies.get(parts[i], 0) + 1
                (laid if n <= 2 else alike).append(i)
            part, offset = repeats([parts[i] for i in laid], length)
            which = np.array(laid)[part]
            yield _repeats(doc[which], tie[which], start[which] + offset, np.ones(len(which), np.int64))
            # all windows of a second copy are repeats, so those of further ones, whose bytes were compared, are too
            if alike:
                yield _repeats(doc[alike], tie[alike], start[alike], np.array([len(parts[i]) - length + 1 for i in alike]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, enough = 0, CHUNK
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                held.append(b)
                size += b.column(5).nbytes
                if size < enough:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut:
                    yield from done(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), table.slice(cut).column("context").nbytes
                enough = max(CHUNK, 2 * size)  # a large group is looked at again when it has doubled
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def _apply(length: int, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans_out, kept_out = [], []
            for text, found, again in zip(utf8(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                spans: list[list[int]] = []
                if again:
                    spans = [[0, len(text)]] if len(text) >= length else []
                else:
                    for s, n in sorted((x["start"], x["count"]) for x in found or ()):
                        e = s + n - 1 + length
                        if spans and s <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], e)
                        else:
                            spans.append([s, e])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                kept_out.append(b"".join(kept))
                spans_out.append([{"start": s, "end": e} for s, e in spans])
            if as_text:
                kept = pa.array([k.decode("utf-8", "ignore") for k in kept_out], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), kept, b.column(4)], names=["doc_id", "text", "rest"])
                continue
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            n_bytes = [len(t) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans_out, kind), pa.array(kept_out, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def deduplicate(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): one row per row; kept are the bytes outside all removed spans, in order.

    With `carry`, instead: (doc_id, text, the carried columns), the text being the kept bytes without characters that
    a cut broke.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller id, or before it in the
    same text. Ids are integers (others are an error); a null id is before all others; texts with one id are ordered by their hashes, and
    all but one of several equal rows are removed whole (if of `length` bytes or more). Null texts are empty. Texts may
    be of any length, a text's runs and spans being bounded by it. An empty table gives an empty result; other columns
    are ignored.
    """
    if not 2 * GRAM <= length < PLACE:
        raise ValueError(f"length must be {2 * GRAM} at least and below {PLACE}")
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{id_col} must be an integer, not {docs.schema[id_col].dataType.simpleString()}: ids give the texts' order")
    spark = session(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL))
    rest = [F.struct(*carry).alias("rest")] if carry else []
    text, nobody = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull()
    twice = docs.select(doc.alias("doc")).groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    tie = F.when(nobody, F.lit(-1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    if twice:  # ids alone don't tell rows apart
        hashed = F.xxhash64(text)
        tie = F.when(nobody, hashed.bitwiseOR(F.lit(_NULL))).otherwise(hashed.bitwiseAND(F.lit(~_NULL)))
    rows = docs.select(doc.alias("doc"), tie.alias("tie"), text.alias("text"), *rest)
    twice = twice and rows.groupBy("doc", "tie").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    rows = rows.withColumn("again", F.row_number().over(W.partitionBy("doc", "tie").orderBy("doc")) > 1 if twice else F.lit(False))
    once = rows.where("not again").select("doc", "tie", "text")

    runs = once.mapInArrow(_cut_runs(length), _RUN).withColumn("total", F.sum("n").over(W.partitionBy("part")))
    runs = materialise(runs.where("n = 0 or total > 1").select("key", "doc", "tie", "place", F.when(F.col("n") > 0, F.col("total")).alias("total")), "runs")
    crowded = runs.where(F.col("total") > hot).select("key").distinct().withColumn("crowded", F.lit(True))
    many = crowded.count()
    if many:
        runs = runs.join(F.broadcast(crowded) if many <= BROADCAST_ROWS else crowded, "key", "left")
    runs = runs.select("doc", "tie", F.struct("key", "place", (F.coalesce("crowded", F.lit(False)) if many else F.lit(False)).alias("crowded")).alias("run"))
    runs = runs.groupBy("doc", "tie").agg(F.collect_list("run").alias("runs"))
    contexts = once.join(runs, ["doc", "tie"]).select("text", "doc", "tie", "runs").mapInArrow(_cut_contexts(length), _CONTEXT)
    spans = contexts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_sort_contexts(length), _REPEAT)
    spans = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "count")).alias("found"))
    out = rows.join(spans, ["doc", "tie"], "left")
    out = out.select(F.when(F.col("tie") >= 0, F.col("doc")).alias("doc_id"), "text", "found", "again", *(["rest"] if carry else []))
    if carry:
        kind = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), out.schema["rest"]])
        return out.mapInArrow(_apply(length, True), kind).select("doc_id", "text", "rest.*")
    return out.mapInArrow(_apply(length, False), "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
