import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import quality, toxicity
from loomtrace.llm.trees import boost


def made(n, seed=0):
    """(docs, toxic labels, quality labels): insults mark toxic texts; shouting and symbols mark bad ones."""
    r = random.Random(seed)
    docs, toxic, good = [], [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 150))]
        t, q = r.random() < 0.2, r.random() < 0.8
        if t:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["nitwit", "dunce", "vermin"]))
        if not q:
            words = [w.upper() + "!!" for w in words] if r.random() < 0.5 else [w + r.choice(["***", "$$$", "&&&"]) for w in words]
        docs.append((i, " ".join(words)))
        toxic.append((i, int(t)))
        good.append((i, int(q)))
    return docs, dict(toxic), dict(good)


@pytest.fixture(scope="module")
def tables(spark):
    docs, toxic, good = made(1200)
    labels = [(i, good[i], toxic[i]) for i in range(1000)] + [(None, 1, 1), (3, None, None), (999999, 1, 0)]
    docs += [(5000, None), (5001, ""), (None, "nitwit dunce nitwit dunce vermin dunce"), (5002, "word " * 50_000), docs[3]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    return d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), toxic, good


def accuracy(rows, truth):
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(a == b for a, b in held) / len(held)


def test_toxicity(tables):
    docs, labels, truth, _ = tables
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert accuracy(rows, truth) > 0.97
    assert len({r["score"] for r in rows if r["doc_id"] in (5000, 5001)}) == 1
    assert [r["predicted"] for r in rows if r["doc_id"] is None] == [1]
    kept = toxicity.accept(docs, toxicity.fitted(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in rows)


def test_quality(tables):
    docs, labels, _, truth = tables
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert accuracy(rows, truth) > 0.97


@pytest.mark.parametrize("run", [lambda d, x: toxicity.toxicity(d, x), lambda d, x: quality.quality(d, x)])
def test_little_to_learn_from(tables, run):
    docs, labels, _, _ = tables
    some = docs.where("doc_id < 20 or doc_id is null")
    for few in (labels.limit(0), labels.where("doc_id < 20 and quality = 1 and toxic = 0")):
        rows = run(some, few).collect()
        assert len(rows) == some.count() and len({r["score"] for r in rows}) == 1
    assert run(docs.limit(0), labels).count() == 0


def test_rules_and_their_columns_agree(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(600, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.3) & (x[:, 5] < 0.8)).astype(float)
    model = quality.fit(x, y)
    assert 0 < len(model.rules) < 200
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id bigint, " + ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = np.array([v[0] for v in df.orderBy("doc_id").select(model.column()).collect()])
    want = model.intercept + sum(w * rule.matches(x) for rule, w in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-want)))
    assert ((got > 0.5) == y).mean() > 0.97


def test_lasso_zeroes_noise():
    r = np.random.default_rng(1)
    x = r.integers(0, 2, (800, 30)).astype(float)
    y = (r.random(800) < 1 / (1 + np.exp(-(3 * x[:, 0] - 1.5)))).astype(float)
    w, _ = quality.lasso(x, y, 0.02)
    assert w[0] > 1 and (w[1:] == 0).mean() > 0.8


def test_ftrl_is_sparse():
    docs, truth, _ = made(600, seed=4)
    model = toxicity.fit([t.encode() for _, t in docs], np.array([truth[i] for i, _ in docs], float))
    assert 0 < len(model.index) < 200


def test_boosting_fits_a_simple_rule():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 4))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    assert ((boost(x, y).predict(x) > 0.5) == y).mean() > 0.97
    assert (boost(x, np.ones(500)).predict(x) > 0.99).all()


def test_the_training_bound_holds_for_repeated_ids(spark):
    docs = [(1, f"text {i}") for i in range(300)] + [(1, None), (2, None), (3, "x"), (3, "x")] + [(i, f"w{i}") for i in range(10, 60)]
    labels = [(1, 1), (2, 0), (3, 1)] + [(i, 0) for i in range(10, 60)]
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    for size in (10, 100):
        got = toxicity.labelled_sample(d, y, "toxic", F.lit(True), size).collect()
        assert len(got) == len({r["doc_id"] for r in got}) == min(size, 53)
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[1].startswith("text ") and text[2] is None and text[3] == "x"
    again = {r["doc_id"]: r["text"] for r in toxicity.labelled_sample(d.repartition(7), y, "toxic", F.lit(True), 100).collect()}
    assert again == text


def test_ftrl_same_as_plain_one():
    """One coordinate after the other, in dictionaries."""
    docs, truth, _ = made(120, seed=6)
    texts, y = [t.encode() for _, t in docs], [float(truth[i]) for i, _ in docs]
    rows = toxicity.feature_rows(texts)
    words = texts[0].lower().split()
    grams = {(w,) for w in words} | {(a, g, b) for g in toxicity.GAPS for a, b in zip(words, words[g:])}
    assert len(rows[0]) == len(set(rows[0].tolist())) and len(grams) - 2 <= len(rows[0]) <= len(grams)
    alpha, beta, l1, l2 = 1.0, 1.0, 6.0, 0.1
    z, n, share = {}, {}, sum(y) / len(y)
    bias, bias_n = np.log(share / (1 - share)), 0.0

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else (np.sign(zi) * l1 - zi) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(toxicity.EPOCHS):
        for x, t in zip(rows, y):
            w = {i: weight(i) for i in x.tolist()}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - t
            for i, wi in w.items():
                ni = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((ni + g * g) ** 0.5 - ni**0.5) / alpha * wi
                n[i] = ni + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + bias_n**0.5)
    want = {i: weight(i) for i in z if weight(i)}
    model = toxicity.fit(texts, np.array(y))
    assert model.index.tolist() == sorted(want) and want
    assert np.allclose(model.weight, [want[i] for i in sorted(want)]) and np.isclose(model.bias, bias)
    scores = toxicity.score_texts(texts, model.dense(), model.bias)
    assert np.allclose(scores, [1 / (1 + np.exp(-(bias + sum(want.get(i, 0.0) for i in x.tolist())))) for x in rows], atol=1e-6)


def test_statistics_same_as_plain_ones():
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice("abC9 \n\t#!.,é\x01") for _ in range(r.randint(1, 300)))
        raw = text.encode()
        got = dict(zip(quality.STATISTICS, quality.statistics(raw)))
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
        n, k = len(raw), len(words) or 1
        runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        want = {
            "log_bytes": np.log1p(n), "upper": sum(65 <= b <= 90 for b in raw) / n, "digits": sum(48 <= b <= 57 for b in raw) / n, "spaces": sum(b in b" \t" for b in raw) / n,
            "newlines": raw.count(b"\n") / n, "symbols": raw.count(b"#") / n, "shouts": raw.count(b"!") / n, "stops": sum(b in b".," for b in raw) / n,
            "non_ascii": sum(b > 127 for b in raw) / n, "controls": raw.count(b"\x01") / n, "log_words": np.log1p(len(words)), "word_bytes": sum(map(len, words)) / k,
            "distinct_words": len(set(words)) / k, "top_word": max((words.count(w) for w in words), default=0) / k, "short_words": sum(len(w) <= 3 for w in words) / k,
            "long_words": sum(len(w) >= 15 for w in words) / k, "marked_words": sum(w[-1] in b"#!" for w in words) / k,
            "repeated_lines": 1 - len(set(lines)) / (len(lines) or 1), "line_bytes": n / (len(lines) or 1), "repeated_runs": 1 - len(set(runs)) / len(runs) if runs else 0.0,
        }
        assert all(np.isclose(got[s], want[s]) for s in quality.STATISTICS), got
