import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import index
from loomtrace.llm.common import words_of


def brute(docs, items, width=10):
    phrases = {}
    for i, t in items:
        for w in index.windows_of(words_of((t or "").encode()), width):
            phrases.setdefault(w, set()).add(i)
    out = []
    for d, t in docs:
        words = words_of((t or "").encode())
        hit, found = set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(words) - n + 1):
                own = phrases.get(tuple(words[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((d, len(words), len(hit), tuple(sorted(x for x in found if x is not None))))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("aa bb cc dd É ß9 zz1 the of".split())
    text = lambda n: " ".join(r.choice([word().upper(), word()]) + r.choice(["", ",", "!\n", "-"]) for _ in range(n))
    items = [(i, text(r.choice([0, 3, 9, 10, 11, 40]))) for i in range(25)] + [(3, text(12)), (90, None), (None, text(14))]
    docs = [(i, text(r.choice([0, 5, 30, 300])) + (r.choice(items)[1] or "") + text(4)) for i in range(80)]
    return docs + [(7, docs[7][1]), (200, None), (201, ""), (None, items[5][1]), (202, "x" * 100_000)], items


def test_same_as_brute_force(spark, monkeypatch):
    docs, items = corpus(1)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("segment", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string")
    for size, block in ((index.SEGMENT_BYTES, index.QUERY_BYTES), (2000, 500)):
        monkeypatch.setattr(index, "SEGMENT_BYTES", size)
        monkeypatch.setattr(index, "QUERY_BYTES", block)
        got = index.decontaminate(d, i).collect()
        shown = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), tuple(sorted(r["items"]))) for r in got), key=str)
        assert shown == brute(docs, items)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert index.decontaminate(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in index.decontaminate(docs, items.limit(0)).collect()] == [(1, 3, [], [])]
    assert [(r["n_words"], r["items"]) for r in index.decontaminate(docs, items).collect()] == [(3, [1])]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c a"), (2, "c b"), (3, "a"), (4, "")], "doc_id bigint, text string")
    rows = index.build(docs.coalesce(1)).collect()
    names = ["segment", "doc_ids", "sizes", "terms", "counts", "deltas"]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows])
    (_, s), = list(index._segments([batch]))
    near = lambda words, width: [tuple(int(x) for x in p) for p in zip(*s.near([s.terms[w] for w in words], width))]
    assert near([b"a", b"b"], 3) == [(0, 2)]
    assert near([b"a", b"b"], 4) == [(0, 2), (2, 5)]
    assert near([b"b", b"c"], 2) == [(7, 8)]
    assert near([b"a", b"c"], 5) == [(0, 4), (4, 5)]
    ((which, start),) = s.phrases(np.array([[s.terms[b"c"], s.terms[b"a"]]]))
    assert which.tolist() == [0] and start.tolist() == [4]


def brute_near(docs, items, width=10, reach=2):
    queries = {}
    for i, t in items:
        words = words_of((t or "").encode())
        for w in [*index.windows_of(words, width), *([tuple(words)] if words else [])]:
            queries.setdefault((frozenset(w), int(reach * len(w))), set()).add(i)
    out = []
    for d, t in docs:
        words = words_of((t or "").encode())
        hit, found = set(), set()
        for (terms, most), own in queries.items():
            for i in range(len(words)):
                held = set()
                for j in range(i, min(i + most, len(words)) if words[i] in terms else i):
                    held |= {words[j]} & terms
                    if len(held) == len(terms):
                        hit.update(range(i, j + 1))
                        found |= own
                        break
        ranges = [(a, next(b for b in range(a, len(words) + 1) if b not in hit)) for a in sorted(hit) if a - 1 not in hit]
        out.append((d, tuple(ranges), tuple(sorted(x for x in found if x is not None))))
    return sorted(out, key=str)


def test_proximity_same_as_brute_force(spark, monkeypatch):
    r = random.Random(4)
    word = lambda n=40: f"w{r.randint(0, n)}"
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 5, 10, 11, 30])))) for i in range(20)] + [(None, "w1 w2 w3 w4"), (90, None), (91, "")]
    docs = []
    for i in range(60):
        own = ((items[i % 20][1]) or "").split()
        own = [x for w in own for x in ([w, "xx"] if r.random() < 0.5 else [w])]
        if r.random() < 0.5:
            r.shuffle(own)
        docs.append((i, " ".join([word(400) for _ in range(r.choice([0, 5, 60]))] + own + [word(400) for _ in range(9)])))
    docs += [(7, docs[7][1]), (200, None), (201, "")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_near(docs, items)
    exact = index.decontaminate(d, i).collect()
    assert sum(bool(x[1]) for x in want) > sum(bool(x["spans"]) for x in exact)
    for size, block in ((index.SEGMENT_BYTES, index.QUERY_BYTES), (2000, 500)):
        monkeypatch.setattr(index, "SEGMENT_BYTES", size)
        monkeypatch.setattr(index, "QUERY_BYTES", block)
        got = index.search(index.materialise(index.build(d), "index"), i).collect()
        assert sorted(((x["doc_id"], tuple(map(tuple, x["near"])), tuple(sorted(x["near_items"]))) for x in got), key=str) == want
        assert sorted((x["doc_id"] or 0, x["n_words"], x["spans"], sorted(x["items"])) for x in got) == sorted((x["doc_id"] or 0, x["n_words"], x["spans"], sorted(x["items"])) for x in exact)


@pytest.mark.parametrize("doc,item", [("int", "int"), ("string", "string"), ("bigint", "smallint"), ("date", "bigint")])
def test_ids_of_any_type(spark, doc, item):
    docs, items = corpus(2)
    docs, items = docs[:30] + docs[-5:], items[:8] + items[-2:]
    text = lambda rows, kind, name: spark.createDataFrame(rows, "i bigint, text string").selectExpr(f"cast({'date_from_unix_date(cast(i as int))' if kind == 'date' else 'i'} as {kind}) as {name}", "text")
    got = index.decontaminate(text(docs, doc, "doc_id"), text(items, item, "item_id"))
    assert got.schema["doc_id"].dataType.simpleString() == doc and got.schema["items"].dataType.elementType.simpleString() == item
    shown = sorted((len(r["items"]), r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["doc_id"] is None) for r in got.collect())
    assert shown == sorted((len(b[3]), b[1], b[2], b[0] is None) for b in brute(docs, items))


def test_few_places_at_a_time(spark, monkeypatch):
    docs, items = corpus(3)
    whole = index.Phrases([(i, (t or "").encode()) for i, t in items], 10)
    batch = index.build(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)).toArrow().to_batches()
    found = lambda: [(hit.tolist(), items) for _, s in index._segments(batch) for hit, items in whole.search(s)]
    want = found()
    for places, phrases in ((1, 3), (50, 7)):
        monkeypatch.setattr(index, "PLACES", places)
        monkeypatch.setattr(index, "PHRASES", phrases)
        assert found() == want


def test_what_is_sent_is_bounded():
    r = random.Random(1)
    items = [(i, " ".join(f"w{r.randint(0, 100_000)}" for _ in range(1000)).encode()) for i in range(130)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(index.Phrases(items, 10))) < 6 * size
    short = [(i, b"a b c d e f g h i j k l") for i in range(30_000)]
    assert len(pickle.dumps(index.Phrases(short, 10))) < 10 * sum(len(t) for _, t in short)
