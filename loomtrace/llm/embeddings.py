"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Each unit vector u is stored as a scale times int8 codes, u = s q + e, with |e| known exactly. Then
u.v = s t (q.r) + s q.f + e.(t r) + e.f, so |u.v - s t (q.r)| <= |sq||f| + |e||tr| + |e||f|, a bound kept per vector. A tile product is
an integer matrix product; pairs whose upper bound misses the threshold are done. Only the rest is recomputed from the
full-precision components in double. Tiles meet in a triangular grid of cells: each cell compares two blocks of
vectors once, and returns counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import join_spread, labels_by_link, materialise, session
from loomtrace.llm.components import connected_components

#: Vectors in a block of the grid, about, and in a tile product.
BLOCK = 8192
#: A block is made smaller than BLOCK, to this at least, where there would be fewer cells than tasks.
LEAST = 512
TILE = 1024
PAIRS = 1 << 18


def _stack(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows as doubles, scaled by powers of two to a largest component of about 1, which keeps cosines as they are."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows of x as int8 codes, scales, norms of the coded rows and norms of what coding lost (rounded up)."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.maximum(np.abs(unit).max(1), 1e-300) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    lost = np.linalg.norm(unit - coded, axis=1) * (1 + 1e-9) + 1e-12
    return codes, scale, np.linalg.norm(coded, axis=1) * (1 + 1e-9), lost


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _cell(x: np.ndarray, y: np.ndarray | None, weight_x: np.ndarray, weight_y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weighted numbers of partners, forest labels) of the rows of x, then of y; y None: pairs within x."""
    same = y is None
    codes_x, scale_x, norm_x, lost_x = quantise(x)
    codes_y, scale_y, norm_y, lost_y = (codes_x, scale_x, norm_x, lost_x) if same else quantise(y)
    both = x if same else np.concatenate((x, y))
    weight = weight_x if same else np.concatenate((weight_x, weight_y))
    shift = 0 if same else len(x)
    near, label = np.zeros(len(both), np.int64), np.arange(len(both))
    for i in range(0, len(x), TILE):
        # products of int8 codes are whole numbers below 2**24 for up to 1024 components: float32 holds them exactly
        kind = np.float32 if x.shape[1] <= 1024 else np.float64
        rows = codes_x[i : i + TILE].astype(kind)
        for j in range(i if same else 0, len(codes_y), TILE):
            product = rows @ codes_y[j : j + TILE].astype(kind).T
            si, sj = scale_x[i : i + TILE, None], scale_y[None, j : j + TILE]
            slack = norm_x[i : i + TILE, None] * lost_y[None, j : j + TILE] + lost_x[i : i + TILE, None] * (norm_y[None, j : j + TILE] + lost_y[None, j : j + TILE])
            a, b = np.nonzero(product * (si * sj) + slack >= threshold - 1e-9)
            a, b = a + i, b + j + shift
            if same:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), PAIRS):
                p, q = a[at : at + PAIRS], b[at : at + PAIRS]
                ok = cosine(both[p], both[q]) >= threshold
                p, q = p[ok], q[ok]
                near += np.bincount(p, weight[q], len(both)).astype(np.int64) + np.bincount(q, weight[p], len(both)).astype(np.int64)
                tied = np.nonzero(label != np.arange(len(label)))[0]
                label = labels_by_link(len(both), np.concatenate((p, tied)), np.concatenate((q, label[tied])))
    return near, label


def near_duplicates(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do vectors of
    other lengths than each other. Equal vectors meet in one representative first, with its number of rows, so large
    groups of copies cost one comparison. Repeated rows are vectors of their own. A null id links and counts but names
    no component unless alone. An empty table gives an empty result; other columns are ignored.
    """
    spark = session(rows.sparkSession)
    kind = rows.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(kind).alias("x"))
    good = F.expr("x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('inf')) and exists(x, c -> c <> 0)")
    v = v.withColumn("ok", good).withColumn("key", F.when(F.col("ok"), F.sha2(F.array_join(F.expr("transform(x, c -> c + 0D)"), ","), 256)))
    slim = v.select("vec_id", "key")
    reps = v.where("ok").groupBy("key").agg(F.first("x").alias("x"), F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = materialise(reps.withColumn("dim", F.size("x")), "vector-groups")
    n = reps.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = max(1, -(-n // block), min(-(-n // LEAST), isqrt(4 * tasks)))  # enough cells for every task
    place = reps.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(grid)).cast("int"))
    cells = place.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).select(
        F.least("g", "other").alias("i"), F.greatest("g", "other").alias("j"), "g", "key", "x", "copies", "dim"
    )

    def compare(t: pa.Table) -> pa.Table:
        keys, near_all, link_a, link_b = [], [], [], []
        dims = t.column("dim").to_numpy()
        for dim in np.unique(dims):
            own = t.filter(pa.array(dims == dim))
            g = own.column("g").to_numpy()
            x = _stack(own.column("x").combine_chunks(), int(dim))
            copies, key = own.column("copies").to_numpy(), np.array(own.column("key").to_pylist())
            first = g == own.column("i").to_numpy()
            if own.column("i")[0] == own.column("j")[0]:
                near, label = _cell(x, None, copies, None, threshold)
            elif first.all() or not first.any():
                continue
            else:
                near, label = _cell(x[first], x[~first], copies[first], copies[~first], threshold)
                key = np.concatenate((key[first], key[~first]))
            some, tied = np.nonzero(near)[0], np.nonzero(label != np.arange(len(label)))[0]
            keys += key[some].tolist()
            near_all += near[some].tolist()
            link_a += key[label[tied]].tolist()
            link_b += key[tied].tolist()
        n_links, n_edges = len(keys), len(link_a)
        return pa.table({
            "a": pa.array(keys + link_a, pa.string()), "b": pa.array([None] * n_links + link_b, pa.string()),
            "near": pa.array(near_all + [0] * n_edges, pa.int64()),
        })

    found = materialise(cells.groupBy("i", "j").applyInArrow(compare, "a string, b string, near bigint"), "vector-links")
    near = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("near").alias("near"))
    joined = connected_components(found.where("b is not null").select("a", "b"))
    named = reps.select("key", "low", "copies").join(joined, F.col("key") == F.col("node"), "left").withColumn("c", F.coalesce("component", "key"))
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    named = join_spread(named, lowest, "c", "members", n).join(near, "key", "left")
    named = named.select("key", "component_id", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    total = reps.agg(F.sum("copies")).first()[0] or 0
    out = join_spread(slim.where("key is not null"), named, "key", "copies", total).select("vec_id", "n_links", "component_id")
    out = out.unionByName(slim.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull() & F.col("component_id").isNull()))
