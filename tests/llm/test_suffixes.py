import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import suffixes


def brute(rows, length=100):
    """(kept bytes, removed runs) of each row: rows in order of id (null first), then the library's hash of the text."""
    seen, out = set(), []
    for _, text in rows:
        own = (text or "").encode()
        gone = np.zeros(len(own), bool)
        for i in range(len(own) - length + 1):
            w = own[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) > 0).sum())
        out.append((len(own), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(own, gone) if not g)).hexdigest()))
    return out


def result(df, **options):
    got = suffixes.deduplicate(df, **options)
    got = got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("k"))
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéß ") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(80)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(3)]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 40)
            parts.insert(r.randint(0, 3), p[a : a + r.randint(50, 400)])
        rows.append((i * 3, "".join(parts)))
    rows += [(1, rows[5][1]), (400, rows[5][1]), (401, rows[6][1][:-7] + "zz"), (402, "ab" * 300), (403, "x" * 500), (404, ""), (405, None), (None, rows[8][1])]
    return rows


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_same_as_brute_force(spark, hot):
    rows = corpus(hot)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc", F.lit("clash")).repartition(3)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = [(i, *b) for (i, _), b in zip(ordered, brute(ordered))]
    assert result(df, hot=hot) == want


def test_equal_rows_and_empty_table(spark):
    text = " ".join(str(i) for i in range(200))
    df = spark.createDataFrame([(5, text), (5, text), (5, "short"), (5, "short")], "doc_id bigint, text string")
    got = result(df)
    assert [(r[1], r[2]) for r in got if r[1] > 5] == [(len(text), 0), (len(text), len(text))]
    assert [r[2] for r in got if r[1] == 5] == [0, 0]
    assert result(df.limit(0)) == []


@pytest.mark.parametrize("hashed", [True, False])
def test_suffix_array_sorts_all_suffixes(monkeypatch, hashed):
    r = random.Random(3)
    if not hashed:  # every hash is equal: all suffixes look alike until their bytes are compared
        monkeypatch.setattr(suffixes, "_prefix_hashes", lambda keys, chosen, depth: np.zeros(len(chosen), np.uint64))
    for n, letters in ((1, b"a"), (50, b"ab"), (400, b"abc"), (300, b"a"), (2000, bytes(range(97, 123)))):
        raw = bytes(r.choice(letters) for _ in range(n))
        if n == 2000:
            raw = raw[:900] + raw[100:800] + raw[900:]
        text = np.frombuffer(raw, np.uint8)
        sa, lcp = suffixes.suffix_array(text, len(raw) + 8)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        for k in range(1, len(raw)):
            a, b = raw[sa[k - 1] :], raw[sa[k] :]
            want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == want
        for depth in (8, 12, 100):  # to a depth only
            sa, lcp = suffixes.suffix_array(text, depth)
            assert sorted(sa.tolist()) == list(range(len(raw)))
            wanted = np.array([r.random() < 0.3 for _ in raw])
            some, _ = suffixes.suffix_array(text, depth, wanted)
            assert set(np.nonzero(wanted)[0].tolist()) <= set(some.tolist()) and len(set(some.tolist())) == len(some)
            assert all(raw[a:][:depth] <= raw[b:][:depth] for a, b in zip(some, some[1:]))
            assert all(raw[a:][:depth] <= raw[b:][:depth] for a, b in zip(sa, sa[1:]))
            assert lcp[1:].tolist() == [next((i for i in range(depth) if raw[a + i : a + i + 1] != raw[b + i : b + i + 1] or a + i >= len(raw)), depth) for a, b in zip(sa, sa[1:])]


def test_ids(spark):
    text = " ".join(str(i) for i in range(200))
    low = -(1 << 63)
    df = spark.createDataFrame([(low, text), (None, text), (3, text + "x")], "doc_id bigint, text string")
    n = len(text)
    assert [(r[0], r[2]) for r in result(df)] == [(None, 0), (low, n), (3, n)]
    assert [r[0] for r in result(df.select(F.expr("try_cast(doc_id as int)").alias("doc_id"), "text"))] == [None, None, 3]
    with pytest.raises(TypeError, match="integer"):
        suffixes.deduplicate(df.select(F.col("doc_id").cast("string"), "text"))


def test_only_equal_bytes_are_removed(spark, monkeypatch):
    """With hashes that say nothing, groups mix all texts, and the suffix arrays still tell what repeats."""
    monkeypatch.setattr(suffixes, "BLOCK", 400)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    rows = corpus(5, 25)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = [(i, *b) for (i, _), b in zip(ordered, brute(ordered))]
    whole = suffixes._cut_runs

    def one_key(length):  # every run has the same anchor
        made = whole(length)

        def run(batches):
            for b in made(batches):
                key = np.zeros(b.num_rows, np.int64)
                n = np.zeros(b.num_rows, np.int64)
                n[0] = b.num_rows
                yield b.set_column(0, "part", suffixes.pa.array(key)).set_column(1, "key", suffixes.pa.array(key)).set_column(2, "n", suffixes.pa.array(n))

        return run

    monkeypatch.setattr(suffixes, "_cut_runs", one_key)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert result(df) == want
    assert result(df, hot=1) == want
