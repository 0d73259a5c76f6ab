"""Global and per-scope limits and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.plans.syntax import EVENT, LOG, TRACE
from loomtrace.sources.layouts import IDS


def cut(df: DataFrame, limit: dict, offset: dict) -> DataFrame:
    """The clause without a scope."""
    if offset.get(None):
        df = df.offset(offset[None])
    return df.limit(limit[None]) if None in limit else df


def _within(rank: str, scope: str, limit: dict, offset: dict) -> Column:
    skip = offset.get(scope, 0)
    test = F.col(rank) > skip
    return test & (F.col(rank) <= skip + limit[scope]) if scope in limit else test


def scoped(df: DataFrame, collection: str, limit: dict, offset: dict, order: list[Column]) -> DataFrame:
    """Keep the first logs, the first traces of each log and the first events of each trace, in the rows' order.

    Logs and traces rank by their first row. A rank over all rows would need one task: instead each level ranks only
    the heads of the level below, which are one row per trace and then one per log.
    """
    asked = {s for s in (LOG, TRACE, EVENT) if s in limit or s in offset}
    if not asked:
        return df
    chain = [s for s in (EVENT, TRACE, LOG) if s in IDS and len(IDS[s]) <= len(IDS[collection])]
    rows = df
    heads: dict[str, DataFrame] = {}
    lowest = chain[0]
    if lowest == EVENT and asked == {EVENT}:
        rows = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*IDS[TRACE]).orderBy(*order)))
        return rows.where(_within("_rn", EVENT, limit, offset)).drop("_rn")
    level = rows
    for scope in chain:
        parent = {EVENT: TRACE, TRACE: LOG}.get(scope)
        window = W.partitionBy(*(IDS[parent] if parent else [])).orderBy(*order) if parent else W.orderBy(*order)
        level = level.withColumn(f"_r{scope}", F.row_number().over(window))
        heads[scope] = level
        level = level.where(F.col(f"_r{scope}") == 1)
    rows = heads[lowest]
    if lowest in asked:
        rows = rows.where(_within(f"_r{lowest}", lowest, limit, offset))
    for scope in chain[1:]:
        if scope in asked:
            kept = heads[scope].where(_within(f"_r{scope}", scope, limit, offset)).select(*IDS[scope])
            rows = rows.join(kept, IDS[scope], "left_semi")
    return rows.drop(*[f"_r{s}" for s in chain])
