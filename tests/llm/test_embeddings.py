import numpy as np

from loomtrace.llm import embeddings


def brute(vectors, threshold=0.9):
    good = {i: v for i, v in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    root = list(range(len(vectors)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(vectors)
    for a in good:
        for b in good:
            x, y = (np.array(good[i], float) / np.abs(good[i]).max() for i in (a, b))
            if a < b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [(i, links[i], find(i), find(i) == i) for i in range(len(vectors))]


def test_same_as_brute_force(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    v = [(centres[r.integers(12)] + r.normal(size=16) * s).tolist() for s in r.choice([0.05, 0.3, 0.5, 2], 150)]
    v += [v[3]] * 6 + [[x * 7 for x in v[4]], [0.0] * 16, None, [], [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0], [1e-200] * 16, [1e200] * 16]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>, label int")
    for block in (embeddings.BLOCK, 40):
        got = sorted(tuple(x) for x in embeddings.near_duplicates(df, block=block).collect())
        assert got == brute(v)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 48)) * r.exponential(size=(300, 48)) ** 3
    codes, scale, norm, lost = embeddings.quantise(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    approx = (codes.astype(float) @ codes.T.astype(float)) * np.outer(scale, scale)
    slack = np.outer(norm, lost) + np.outer(lost, norm + lost)
    assert (np.abs(unit @ unit.T - approx) <= slack).all()


def test_components_near_the_largest_double_are_finite(spark):
    v = [[1.79e308, 1.0], [1.79e308, 1.0], [1.0, 0.0], [float("inf"), 1.0], [-1.79e308, 0.0], [float("-inf"), 0.0]]
    got = embeddings.near_duplicates(spark.createDataFrame(list(enumerate(v)), "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3), (4, 0, 4), (5, 0, 5)]
