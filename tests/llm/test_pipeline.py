"""Each stage of the pipeline against what it should leave, on a small corpus."""

import random

import pytest

import corpus_pipeline as pipeline
from loomtrace.llm import index, suffixes
from loomtrace.llm.common import materialise


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        t = text(r.randint(20, 120))
        toxic = i % 6 == 0
        if toxic:
            t = " ".join(w + (" nitwit dunce" if j % 9 == 4 else "") for j, w in enumerate(t.split()))
        docs.append((i, t, "en", f"src{i % 3}", len(t)))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    passage, items = text(60), [(k, text(25)) for k in range(5)]
    add = lambda i, t: docs.append((i, t, "en", "src0", len(t)))
    add(1001, docs[1][1])
    add(1002, docs[2][1] + " tail")
    add(1003, text(30) + " " + passage)
    add(1004, text(40) + " " + passage + " " + text(5))
    add(1005, text(10) + " " + items[2][1] + " " + text(10))
    docs.append((1006, None, None, None, None))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {d[0]: d for d in docs}


def test_stages(spark, folder):
    path, given = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = {}
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, path), name)
        left[name] = docs
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
    ids = {n: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for n, df in left.items() if n != "packing"}
    clean = set(given) - {i for i in given if i < 400 and i % 6 == 0}
    assert set(ids["toxicity"]) == clean
    near = set(ids["simhash_near_dedup"])
    assert 1001 not in near and 1002 not in near and {1, 2, 1003, 1004, 1005, 1006} <= near
    assert len(near) >= len(clean) - 4
    cut = ids["suffix_dedup"]
    assert set(cut) == near
    seen = set()
    for i in sorted(near):
        raw = (ids["simhash_near_dedup"][i] or "").encode()
        keep = bytearray(b"\1" * len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                keep[s : s + 100] = bytes(100)
            seen.add(w)
        assert cut[i] == bytes(b for b, k in zip(raw, keep) if k).decode("utf-8", "ignore")
    assert set(ids["decontamination"]) == near - {1005}
    pieces = left["packing"].collect()
    assert {p["doc_id"] for p in pieces} == set(ids["decontamination"])
    assert sum(p["length"] for p in pieces) == sum(n for n in {p["doc_id"]: p["doc_tokens"] for p in pieces}.values())


def test_run_and_the_stage_order(spark, folder):
    assert pipeline.run(spark, folder[0]).count() > 0
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_dedup", "decontamination", "packing"]
    assert index and suffixes


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder[0]), name)
        assert docs.count() == 0
