"""Mixture-controlled packing of tokenised documents into fixed windows.

Every source is a queue: the concatenation of its documents' tokens in partition order. A window is filled in grains
of `grain` tokens. Deficit round-robin decides whose grains: each window, a queue's deficit grows by its quantum (its
target share of a window), it is served the whole grains it is owed, and what it is owed beyond that carries to the
next window. Windows are grouped in blocks; at a block's start the served totals have a closed form, so the deficits
carry across blocks and across partitions without anyone walking the windows before them. Only a task's own blocks
are played out, in the task. More than FLAT sources are dealt in two or more levels: sources in groups of FAN, those in
groups again, up to at most FLAT. The groups at the top take turns over the windows; a group's grains are dealt to its
members one by one, by the same method, so every source keeps a deficit of its own. What can't fill a grain, or is left when a queue of an explicit mixture runs dry, is
packed densely at the end, so only the very last window can be short.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import materialise, session, tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added tokens of a vocabulary. Their strings are cut out of a text before anything else is.
ADDED = {VOCABULARY: {"<|endoftext|>": 50256}}
#: Up to so many queues take turns directly; more do in groups of FAN.
FLAT = 128
FAN = 32
#: The queue of rows with a null source.
NO_SOURCE = "\0"
#: White-space runs of so many characters are cut out; tiktoken's pattern fails at a million.
LONG_SPACE = 1 << 16
#: Unicode's White_Space, which Python's own class for it exceeds.
SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_SPACE)
#: Above so many (partition, queue) sums they are joined by shuffle.
BROADCAST_ROWS = 500_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """The byte-level BPE; its ids are those of the same vocabulary in the tokenizers library (held in the tests)."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _added(vocabulary: str) -> re.Pattern | None:
    tokens = ADDED.get(vocabulary)
    return re.compile("|".join(map(re.escape, sorted(tokens, key=len, reverse=True)))) if tokens else None


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids of any text, without special tokens before or after it.

    Strings of the vocabulary's added tokens have those tokens' ids; what stands between them is encoded by itself.
    """
    added = _added(vocabulary)
    ids, at = [], 0
    for found in added.finditer(text) if added else ():
        ids += _plain(text[at : found.start()], vocabulary)
        ids.append(ADDED[vocabulary][found[0]])
        at = found.end()
    return ids + _plain(text[at:], vocabulary) if ids or at else _plain(text, vocabulary)


def _plain(text: str, vocabulary: str) -> list[int]:
    """The ids of a text without added tokens. Long white-space runs, on which the library's pattern overflows, are cut out at pre-token borders.

    Such a run is one pre-token, but for its last character if text follows, which belongs to what follows.
    """
    e = encoder(vocabulary)
    if len(text) < LONG_SPACE:
        return e.encode_ordinary(text)
    ids, at = [], 0
    for run in SPACES.finditer(text):
        stop = run.end() - (run.end() < len(text))
        ids += e.encode_ordinary(text[at : run.start()])
        ids += e._encode_single_piece(text[run.start() : stop].encode())
        at = stop
    return ids + e.encode_ordinary(text[at:])


def tokenise(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """(pid, queue, at, n, doc_id, ids): `at` is the tokens before it of the same partition and queue; ids are uint16."""
    session(docs.sparkSession)
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), queue.alias("queue"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, ahead = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            ids, n, at = [], [], []
            for text, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = encode(text or "", vocabulary)
                own.append(end_id)
                ids.append(np.array(own, "<u2").tobytes())
                n.append(len(own))
                at.append(ahead[q])
                ahead[q] += len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid] * len(n), pa.int32()), b.column(2), pa.array(at, pa.int64()), pa.array(n, pa.int64()), b.column(0), pa.array(ids, pa.binary())],
                names=["pid", "queue", "at", "n", "doc_id", "ids"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"pid int, queue string, at bigint, n bigint, doc_id {kind}, ids binary")


def _apportion(total: int, weights: list[int]) -> list[int]:
    """Whole shares of `total` by weight, by largest remainder; ties go to the earlier."""
    whole = sum(weights)
    shares = [total * w // whole for w in weights]
    rest = sorted(range(len(weights)), key=lambda s: (-(total * weights[s] % whole), s))
    for s in rest[: total - sum(shares)]:
        shares[s] += 1
    return shares


class Deal:
    """Deficit round-robin of some queues' whole grains over rounds of `slots` grains, in blocks with closed-form starts."""

    def __init__(self, shares: list[int], slots: int):
        self.shares, self.slots, self.n = shares, slots, sum(shares) // slots
        self.block = max(256, -(-len(shares) ** 2 // slots))
        self.last = max(1, self.n // self.block) - 1  # a short last block joins the one before
        self.big = max(range(len(shares)), key=lambda s: shares[s])

    def served(self, block: int) -> list[int]:
        """Grains of each queue in the blocks before `block`; the largest queue evens out rounding."""
        rounds = self.n if block > self.last else block * self.block
        out = [rounds * g // self.n for g in self.shares]
        out[self.big] += rounds * self.slots - sum(out)
        return out

    def play(self, block: int) -> tuple[list[int], list[int], np.ndarray]:
        """(grains served before the block, where each queue's slots start, slots in the block by queue and grain)."""
        start = self.served(block)
        left = np.array(self.served(block + 1), np.int64) - np.array(start, np.int64)
        w = int(left.sum()) // self.slots
        quantum, deficit = left.copy(), np.zeros(len(left), np.int64)  # in units of 1/w grain
        heads = np.concatenate(([0], np.cumsum(left))).tolist()
        take = np.zeros((w, len(left)), np.int32)
        for i in range(w):
            deficit += quantum
            now = np.clip(deficit // w, 0, left)
            while (room := self.slots - int(now.sum())) > 0:
                owed = np.argsort(now * w - deficit, kind="stable")
                now[owed[(left > now)[owed]][:room]] += 1
            while (over := int(now.sum()) - self.slots) > 0:
                least = np.argsort(deficit - now * w, kind="stable")
                now[least[(now > 0)[least]][:over]] -= 1
            deficit -= now * w
            left -= now
            take[i] = now
        whose = np.repeat(np.tile(np.arange(take.shape[1], dtype=np.int32), w), take.ravel())
        return start, heads, np.argsort(whose, kind="stable").astype(np.int32)


class Schedule:
    """Which window and place each token of each queue has. Small: a few numbers for each queue and phase."""

    def __init__(self, totals: dict[str, int], window: int = 1024, grain: int = 128, targets: dict[str | None, float] | None = None):
        if window % grain:
            raise ValueError("grain must divide window")
        self.window, self.grain, self.slots = window, grain, window // grain
        wanted = {NO_SOURCE if q is None else q: round(1e12 * max(0.0, t)) for q, t in (targets or {}).items()}
        mixed = sorted(totals if targets is None else (q for q in totals if wanted.get(q)))
        if totals and not mixed:
            raise ValueError("targets give none of the sources a share")
        self.queues = mixed + sorted(q for q in totals if targets is not None and not wanted.get(q))
        self.index = {q: s for s, q in enumerate(self.queues)}
        self.totals = [totals[q] for q in self.queues]
        #: By phase: first window, windows, grains of each mixed queue, grains of each before.
        self.phases: list[tuple[int, int, tuple[int, ...], tuple[int, ...]]] = []
        left, done, first = [t // grain for t in self.totals[: len(mixed)]], [0] * len(mixed), 0
        weights = list(left) if targets is None else [wanted[q] for q in mixed]
        while True:
            weights = [w if n else 0 for w, n in zip(weights, left)]
            if not sum(weights):
                break
            if targets is None:
                n = sum(left) // self.slots
            else:
                n = min(x * sum(weights) // (self.slots * w) for x, w in zip(left, weights) if w)
            shares = _apportion(n * self.slots, weights)
            while n and any(a > b for a, b in zip(shares, left)):
                n -= 1
                shares = _apportion(n * self.slots, weights)
            if n:
                self.phases.append((first, n, tuple(shares), tuple(done)))
                first += n
                left = [a - b for a, b in zip(left, shares)]
                done = [a + b for a, b in zip(done, shares)]
            if targets is None:
                break
            short = min((s for s, w in enumerate(weights) if w), key=lambda s: left[s] / weights[s])
            weights[short] = 0
        self.full, self.done = first, done + [0] * (len(totals) - len(mixed))
        tails = [t - g * grain for t, g in zip(self.totals, self.done)]
        self.tail = np.concatenate(([0], np.cumsum(tails))).tolist()
        #: By phase and level: grains of the queues, then of groups of FAN of them, and so on.
        self.levels: list[list[np.ndarray]] = []
        for _, _, shares, _ in self.phases:
            levels = [np.array(shares, np.int64)]
            while len(levels[-1]) > FLAT:
                levels.append(np.add.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN)))
            self.levels.append(levels)
        self._caches()

    def _caches(self) -> None:
        self._deal = lru_cache(maxsize=4096)(self._make_deal)
        self._played = lru_cache(maxsize=1024)(lambda *key: self._deal(*key[:3]).play(key[3]))
        self._served = lru_cache(maxsize=4096)(lambda *key: self._deal(*key[:3]).served(key[3]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_deal", "_played", "_served")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._caches()

    def _make_deal(self, phase: int, level: int, group: int) -> Deal:
        levels = self.levels[phase]
        if level == len(levels) - 1:
            return Deal(levels[level].tolist(), self.slots)
        return Deal(levels[level][group * FAN : (group + 1) * FAN].tolist(), 1)

    def _slots(self, phase: int, level: int, s: int, g: int, count: int) -> list[int]:
        """Slots of the phase that grains g, g + 1, ... of a level's queue s have: at least one, at most `count`."""
        top = level == len(self.levels[phase]) - 1
        group, own = (0, s) if top else divmod(s, FAN)
        key = (phase, level, group)
        deal = self._deal(*key)
        b = min(g * deal.n // (deal.shares[own] * deal.block), deal.last)
        while self._served(*key, b)[own] > g:
            b -= 1
        while self._served(*key, b + 1)[own] <= g:
            b += 1
        start, heads, slots = self._played(*key, b)
        at = heads[own] + g - start[own]
        base = b * deal.block * deal.slots
        found = [base + x for x in slots[at : min(at + count, heads[own + 1])].tolist()]
        return found if top else [self._slots(phase, level + 1, group, x, 1)[0] for x in found]

    def pieces(self, queue: str, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
        """(stream position, length, sequence, offset) that together cover the queue's tokens lo..hi-1."""
        s = self.index[queue]
        for p, (first, _, shares, done) in enumerate(self.phases):
            if s >= len(shares):
                break
            end = min(hi, (done[s] + shares[s]) * self.grain)
            while lo < end:
                g = lo // self.grain
                slots = self._slots(p, 0, s, g - done[s], -(-end // self.grain) - g)
                i = 0
                while i < len(slots):  # neighbouring slots of a window are one piece
                    j = i + 1
                    while j < len(slots) and slots[j] == slots[j - 1] + 1 and slots[j] % self.slots:
                        j += 1
                    size = min(end, (g + j) * self.grain) - lo
                    yield lo, size, first + slots[i] // self.slots, slots[i] % self.slots * self.grain + lo - (g + i) * self.grain
                    lo += size
                    i = j
        while lo < hi:
            at = self.tail[s] + lo - self.done[s] * self.grain
            size = min(hi - lo, self.window - at % self.window)
            yield lo, size, self.full + at // self.window, at % self.window
            lo += size


def pack(
    docs: DataFrame, window: int = 1024, grain: int = 128, targets: dict[str | None, float] | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece; ids are little-endian uint32.

    targets: token shares by source, None for null; by default those of the corpus; an error if no source has one. Every
    source is a queue of its own, at any number of them. Null and empty texts hold the end id only; a null
    source is a queue of its own; repeated rows and ids are packed as they come; an empty table gives no piece. A
    document of any length is cut by its windows. A hot source only has longer runs in each window. Other columns are
    ignored. One total for each distinct source goes to the driver and to the tasks.
    """
    tokens = materialise(tokenise(docs, id_col, text_col, source_col, vocabulary), "tokens")
    sums = tokens.groupBy("pid", "queue").agg(F.sum("n").alias("own"))
    ahead = F.coalesce(F.sum("own").over(W.partitionBy("queue").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = materialise(sums.select("pid", "queue", "own", ahead.alias("base")), "token-sums")
    schedule = Schedule({r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("own").alias("n")).collect()}, window, grain, targets)
    base = sums.select("pid", "queue", "base")
    placed = tokens.join(F.broadcast(base) if base.count() <= BROADCAST_ROWS else base, ["pid", "queue"])
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("at")).alias("lo"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, length, seq, off, part = [], [], [], [], [], []
            queues, los, ns, blobs = (b.column(c).to_pylist() for c in (1, 2, 3, 4))
            for r, (queue, lo, n, blob) in enumerate(zip(queues, los, ns, blobs)):
                ids = np.frombuffer(blob, "<u2").astype("<u4").tobytes()
                for at, size, sequence, offset in schedule.pieces(queue, lo, lo + n):
                    at -= lo
                    row.append(r)
                    start.append(at)
                    length.append(size)
                    seq.append(sequence)
                    off.append(offset)
                    part.append(ids[4 * at : 4 * (at + size)])
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(part, pa.binary()), b.column(3).take(row), pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    kind = placed.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
