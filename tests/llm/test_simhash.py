import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomtrace.llm import simhash
from loomtrace.llm.components import connected_components


def plain_fingerprint(text, width=4):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams):
            out |= 1 << bit
    return out


def components(prints, distance=4):
    ids = sorted(prints, key=lambda i: (i is None, i or 0))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)), key=lambda i: (i is None, i or 0))
                root[y] = x
    return {i: find(i) for i in ids}


def rows(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeÄß") for _ in range(r.randint(1, 7)))
    out = []
    for i in range(60):
        words = [word() for _ in range(r.randint(0, 120))]
        out.append((i, " ".join(words)))
        for j in range(r.randint(0, 2)):
            near = list(words)
            if near:
                near[r.randrange(len(near))] = word()
            out.append((1000 + 3 * i + j, "\t ".join(near).upper() if r.random() < 0.3 else " ".join(near)))
    return out + [(5000, None), (5001, ""), (5002, " \n"), (5003, out[3][1]), (None, out[4][1]), (5004, "one two")]


def test_same_as_brute_force(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    prints = {i: plain_fingerprint(t) for i, t in data}
    want = components(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_representatives_keep_one_row_of_each_component(spark):
    data = rows(2)
    data += [data[0], data[0], data[7]]
    df = spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id bigint, text string, source string")
    kept = [tuple(r) for r in simhash.representatives(df).collect()]
    want = components({i: plain_fingerprint(t) for i, t in data})
    assert sorted(k[0] for k in kept) == sorted(set(want.values()))
    assert all((i, t) in data for i, t, _ in kept)
    assert simhash.representatives(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [simhash.SMALL, 1])
@pytest.mark.parametrize("spread", [3, 12])
def test_bucket_links_find_all_pairs(spread, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "PAIR_BLOCK", 50)
    r = np.random.default_rng(spread)
    base = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, spread * 5, 40).astype(np.uint64)) for b in base]))
    linked = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    for first in range(5):
        key = simhash._segment(fp, first)
        for k in np.unique(key):
            own = np.nonzero(key == k)[0]
            label = simhash._bucket_links(fp[own], first, 4)
            # labels never join what links don't, and every pair that passes the chains from here is joined
            for a in range(len(own)):
                ok = simhash._chained(fp[own[a]] ^ fp[own], first, 4)
                assert (label[ok] == label[a]).all()
                assert linked[own[a]][own[ok]].all()


def test_every_close_pair_passes_the_chains_of_some_segment():
    r = np.random.default_rng(0)
    x = np.zeros(4000, np.uint64)
    for _ in range(4):
        x |= np.uint64(1) << r.integers(0, 64, 4000).astype(np.uint64)
    passed = np.zeros(len(x), bool)
    for first in range(5):
        passed[simhash._chained(x, first, 4)] = True
    assert passed.all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (5, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: i // 10 * 10 for i in range(40)} | {i: 100 for i in range(100, 160)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_dense_bucket_needs_few_candidates(monkeypatch):
    """Twenty thousand fingerprints within a few bits of each other: their pairs are not listed."""
    r = np.random.default_rng(4)
    fp = np.zeros(40_000, np.uint64)
    for _ in range(3):
        fp ^= np.uint64(1) << r.integers(13, 64, len(fp)).astype(np.uint64)
    fp = np.unique(fp)
    listed = []
    chained = simhash._chained
    monkeypatch.setattr(simhash, "_chained", lambda x, *a: (listed.append(len(x)), chained(x, *a))[1])
    assert (simhash._bucket_links(fp, 0, 4) == 0).all()
    assert len(fp) > 15_000 and sum(listed) < len(fp) ** 2 / 10


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_smaller_distances(spark, distance):
    r = np.random.default_rng(distance)
    prints = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    for _ in range(3):  # neighbours of neighbours, up to 5 bits away each
        near = r.choice(prints, 60)
        for i in range(len(near)):
            for bit in r.choice(64, r.integers(0, 6), replace=False):
                near[i] ^= np.uint64(1) << np.uint64(bit)
        prints = np.unique(np.concatenate((prints, near)))
    own = {int(x) - (1 << 64) if x >> np.uint64(63) else int(x): int(x) for x in prints}
    reps = spark.createDataFrame([(i, i) for i in own], "rid bigint, fp bigint")
    got = {c["node"]: c["component"] for c in connected_components(simhash.links(reps, distance)).collect()}
    assert {i: got.get(i, i) for i in own} == components(own, distance)


@pytest.mark.parametrize("distance", [-1, 5, 8])
def test_distances_that_chains_do_not_cover_are_refused(spark, distance):
    with pytest.raises(ValueError, match="0 to 4"):
        simhash.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), distance=distance)


@pytest.mark.parametrize("hub,hubs", [(1, 1_000_000), (3, 1_000_000), (1_000, 2)])
def test_hubs_change_no_result(spark, monkeypatch, hub, hubs):
    from loomtrace.llm import common

    monkeypatch.setattr(common, "HUB", hub)
    monkeypatch.setattr(common, "HUBS", hubs)
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(25)] + [(100, i) for i in range(101, 130)]
    label = {i: i for e in edges for i in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {c["node"]: c["component"] for c in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: x for i, x in label.items() if any(i in e and e[0] != e[1] for e in edges)}
    data = [(i, "same words in all of these") for i in range(30)] + [(40 + i, f"some other words {i}") for i in range(9)]
    found = simhash.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert len(found) == len(data) and {x["component_id"] for x in found if x["doc_id"] < 30} == {0}
