import random
import zlib

import numpy as np
import pytest

from loomtrace.llm.common import tokenizer_path
from loomtrace.llm.packing import LONG_SPACE, Schedule, encode, pack

TEXTS = ["Hello world", "", "  a\n\n b\t", "naïve café ñandú 你好 🙂", "it's we'll I'd", "x" * 3000, "<|endoftext|> 12345  67", "éß" * 700, "  tail "]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizers_library():
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("abc éñ\n\t.,'0189ßÄ　🙂") for _ in range(r.randint(0, 300))) for _ in range(300)]
    mark = "<|endoftext|>"
    texts += [mark, "see <|endoftext|> here", mark * 3, f"a\n{mark} \nb", f" {mark}  {mark}x", "<|endoftext|", "<<|endoftext|>>", f"it{mark}'s", "<|startoftext|>"]
    texts += ["".join(r.choice([" ", "a", "\n", mark, "é", "'s", "<", "|>", "12"]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    assert [encode(t) for t in texts] == reference_ids(texts)


def check(rows, got, window=1024):
    """Pieces hold each token once, in gapless sequences that are full but for the last."""
    ids = reference_ids([t or "" for _, t, _ in rows])
    docs = sorted((i if i is not None else -1, *x, 0) for (i, _, _), x in zip(rows, ids))
    by_sequence, by_doc = {}, {}
    for p in got:
        part = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(part) == p["length"] > 0
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], part))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or s == len(by_sequence) - 1 and at <= window
    rebuilt = []
    for (doc, n), pieces in by_doc.items():
        held = [t for _, part in sorted(pieces) for t in part]
        if len(held) == n:
            rebuilt.append((doc if doc is not None else -1, *held))
        else:  # repeated rows
            assert len(held) % n == 0
            starts = {}
            for s, part in pieces:
                starts.setdefault(s, []).append(part)
            assert sum(map(len, (p for ps in starts.values() for p in ps))) == len(held)
            return
    assert sorted(rebuilt) == docs


def rows(n, seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8)))
    sources = ["hot"] * 5 + ["b", "c", "d", None]
    return [(i, " ".join(word() for _ in range(r.choice([3, 50, 400, 3000]))), r.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("targets", [None, {"hot": 0.2, "b": 0.5, "c": 0.3}])
def test_packs_every_token_once(spark, targets):
    data = rows(120) + [(500 + i, t, "b") for i, t in enumerate(TEXTS)] + [(600, None, "hot"), (None, "no id", "c")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(5)
    got = pack(df, targets=targets).collect()
    check(data, got)


def test_small_tables(spark):
    schema = "doc_id bigint, text string, source string"
    assert pack(spark.createDataFrame([], schema)).count() == 0
    got = pack(spark.createDataFrame([(1, None, None)], schema)).collect()
    assert [(p["doc_id"], p["start"], p["length"], p["doc_tokens"], p["sequence_id"], p["offset"], zlib.crc32(p["ids"])) for p in got] == [(1, 0, 1, 1, 0, 0, zlib.crc32(b"\0\0\0\0"))]
    check([(1, "same", "a")] * 3, pack(spark.createDataFrame([(1, "same", "a")] * 3, schema)).collect())


@pytest.mark.parametrize("totals", [{"a": 300_000}, {"a": 900_001, "b": 70_003, "c": 129, "d": 127}, {str(i): 3000 + 977 * i for i in range(60)}, {"a": 1}, {}])
@pytest.mark.parametrize("targets", [None, {"a": 0.5, "b": 0.25, "7": 0.25}])
def test_schedule_covers_and_mixes(totals, targets):
    s = Schedule(totals, targets=targets)
    seen = {}
    for q, n in totals.items():
        at = 0
        step = 731
        while at < n:
            for start, size, sequence, offset in s.pieces(q, at, min(n, at + step)):
                assert start == at
                at += size
                for k in ((sequence, offset // 128, q),):
                    seen.setdefault(sequence, []).append((offset, size, q))
    total = sum(totals.values())
    assert sum(x[1] for v in seen.values() for x in v) == total
    for sequence, v in seen.items():
        at = 0
        for offset, size, _ in sorted(v):
            assert offset == at
            at += size
        assert at == 1024 or sequence == max(seen)
    if targets is None and s.phases:  # each prefix of windows holds a queue's share within two grains
        first, n, shares, _ = s.phases[0]
        for q in totals:
            held, k = 0, s.index[q]
            for w in range(n):
                held += sum(size for offset, size, x in seen[w] if x == q)
                assert abs(held - (w + 1) * shares[k] * 128 / n) <= 256 + 128 * (shares[k] == max(shares)) * len(totals)


@pytest.mark.parametrize("n", [300, 5000])
def test_many_sources_keep_their_shares(n):
    totals = {f"s{i:04}": 128 * (6 + i % 37) + i % 128 for i in range(n)}
    s = Schedule(totals)
    first, windows, shares, _ = s.phases[0]
    held = np.zeros((windows, len(s.queues)), np.int64)
    used = np.zeros(windows, np.int64)
    for q, t in totals.items():
        at = 0
        for start, size, sequence, _ in s.pieces(q, 0, t):
            assert start == at
            at += size
            if sequence < windows:
                held[sequence, s.index[q]] += size
                used[sequence] += size
        assert at == t
    assert (used == 1024).all()
    due = np.arange(1, windows + 1)[:, None] * np.array(shares)[None] * 128 / windows
    assert np.abs(np.cumsum(held, 0) - due).max() <= 256


def test_targets_hold_for_many_sources():
    totals = {f"s{i}": 60_000 for i in range(200)} | {"\0": 60_000}
    s = Schedule(totals, targets={"s7": 0.5, "s150": 0.25, None: 0.25})
    got = {q: sum(size for _, size, sequence, _ in s.pieces(q, 0, t) if sequence < 100) for q, t in totals.items()}
    assert {q: x for q, x in got.items() if x} == {"s7": 51_200, "s150": 25_600, "\0": 25_600}
    even = Schedule(totals, targets={f"s{i}": 1 / 150 for i in range(150)})
    got = [sum(size for _, size, sequence, _ in even.pieces(f"s{i}", 0, 60_000) if sequence < 1000) for i in range(200)]
    assert all(abs(x - 1_024_000 / 150) <= 256 for x in got[:150]) and not any(got[150:])
    with pytest.raises(ValueError):
        Schedule(totals, targets={"unknown": 1.0})


def test_packs_over_128_sources_once(spark):
    data = [(i, t, f"s{i % 150}") for i, (_, t, _) in enumerate(rows(450, 3))]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(5)
    check(data, pack(df).collect())
    got = pack(df, targets={"s3": 0.75, "s9": 0.25}).collect()
    check(data, got)
    assert {p["doc_id"] % 150 for p in got if p["sequence_id"] == 0} == {3, 9}


def test_white_space_of_over_a_million_characters(spark):
    n = 1_000_100
    texts = ["a" + " " * n + "b", " " * n + "<|endoftext|>" + " " * n + "a", "\n" * n + "x", "it's" + " \n\u3000\xa0" * (n // 4) + ".\x1c" + " " * LONG_SPACE + "\x1d" + "\t" * LONG_SPACE]
    for m in (LONG_SPACE - 1, LONG_SPACE, LONG_SPACE + 1):
        texts += ["é" + " " * m + "1" + "\t" * m + "'s", " " * m + "\x85", "b\n" + " " * m + "\nb"]
    assert [encode(t) for t in texts] == reference_ids(texts)
    got = pack(spark.createDataFrame([(1, texts[0], "a"), (2, "b", "a")], "doc_id bigint, text string, source string")).collect()
    check([(1, texts[0], "a"), (2, "b", "a")], got)


def plain_round_robin(totals, grain=128, slots=8):
    """Windows by deficit round-robin, one after the other: how many grains each queue has had after each window."""
    left = {q: t // grain for q, t in totals.items()}
    n = sum(left.values()) // slots
    whole = sum(left.values())
    deficit, had, out = dict.fromkeys(left, 0.0), dict.fromkeys(left, 0), []
    for _ in range(n):
        room = slots
        for q in left:
            deficit[q] += slots * (totals[q] // grain) / whole
        for q in sorted(left, key=lambda q: -deficit[q]):
            take = min(room, left[q], max(0, int(deficit[q] + 1e-9)))
            left[q], room, deficit[q], had[q] = left[q] - take, room - take, deficit[q] - take, had[q] + take
        while room:
            q = max((q for q in left if left[q]), key=lambda q: deficit[q])
            left[q], room, deficit[q], had[q] = left[q] - 1, room - 1, deficit[q] - 1, had[q] + 1
        out.append(dict(had))
    return out


@pytest.mark.parametrize("totals", [{"a": 900_000, "b": 70_000, "c": 40_000}, {str(i): 9000 + 5970 * i for i in range(20)}, {"a": 128 * 8 * 50, "b": 128 * 8 * 50}])
def test_mixture_is_that_of_a_plain_round_robin(totals):
    s, want = Schedule(totals), plain_round_robin(totals)
    first, windows, shares, _ = s.phases[0]
    assert windows == len(want) and not first
    held = np.zeros((windows, len(s.queues)), np.int64)
    for q, t in totals.items():
        for _, size, sequence, _ in s.pieces(q, 0, t):
            if sequence < windows:
                held[sequence, s.index[q]] += size
    held = np.cumsum(held, 0) // 128
    for w, had in enumerate(want):
        assert all(abs(held[w, s.index[q]] - x) <= 2 for q, x in had.items() if s.index[q] != int(np.argmax(shares)))


def test_clashing_columns(spark):
    data = [(i, t, "a") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*d, 1, "x", b"y") for d in data], "doc_id bigint, text string, source string, pid int, queue string, ids binary")
    check(data, pack(df).collect())
