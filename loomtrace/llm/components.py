"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import delete, join_spread, materialised


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) % 1000003"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of comparable ids -> (node, component): the smallest id reachable, for each node with a link.

    Loops and repeated links change nothing; links with a null end are ignored; no link gives no row. A hub's
    neighbours are reduced with map-side combination, and its minimum goes to where they are.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    spark = edges.sparkSession
    e, path = materialised(e, "links")
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        large = join_spread(both, low, "u", "d", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = path
        e, path = materialised(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "links")
        delete(spark, last)  # nothing reads the round before any more
        after = _mark(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
