"""Queries over a layout: text in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.operators.expressions import attribute, bracketed_expression, sort_keys, value
from loomtrace.operators.filters import filtered, needs
from loomtrace.operators.grouping import groups, variants
from loomtrace.operators.limits import cut, scoped
from loomtrace.plans.analysis import analyse, route
from loomtrace.plans.syntax import EVENT, LEVEL, LOG, TRACE, Attribute, Delete, Query, QueryError, Star, parse, walk
from loomtrace.sources.layouts import IDS, ORDER, Frame

_ID_NAMES = {"_log": "logId", "_trace": "traceId", "_event": "_id"}


class Engine:
    """Compiles queries to lazy DataFrames over a layout.

    Columns have the text of their expression, without white space, as names; groups add `count`, variants `variant`.
    """

    def __init__(self, layout):
        self.layout = layout

    def query(self, text: str, ids: bool = False, check: bool = True, payload: bool = False) -> DataFrame:
        """ids: also give logId, traceId and _id. payload: groups also give `events`, their representatives. check: look up names of ORDER BY and GROUP BY, which takes a small job
        where attributes are in maps."""
        query = analyse(parse(text))
        if isinstance(query, Delete):
            raise QueryError("a delete is not a query: use delete() of a store, or victims()")
        kind = route(query)
        needed = {query.collection}
        for x in (*query.columns, *query.group, *query.order):
            needed |= {x.scope} if isinstance(x, Star) else needs(x)
        if query.star or (payload and kind != "rows"):
            needed |= {EVENT, TRACE, LOG}
        if kind == "variants":
            needed |= {TRACE} & {g.scope for g in query.group}
        used = [n for x in (*query.columns, *query.group, *query.order) for n in walk(x) if isinstance(n, Attribute)]
        frame = filtered(self.layout, query.collection, query.where, needed, used, query.star or payload)
        if check:
            self._check(frame, query)
        rows_order = [k for o in query.order for k in sort_keys(value(o.expr, frame), o.descending)] if kind == "rows" else []
        document = [F.col(c) for c in ORDER[query.collection]]
        frame.df = scoped(frame.df, query.collection, query.limit, query.offset, [*rows_order, *document])
        if kind == "variants":
            return variants(frame, query, payload)
        if kind == "global":
            return groups(frame, query, payload=payload)
        if kind == "groups":
            by_trace = not query.group and not query.columns
            out = groups(frame, query, by_trace, payload)
            return out if query.group or by_trace else out.where("`count` > 0")
        df = frame.df.orderBy(*rows_order, *document) if rows_order else frame.df
        df = cut(df, query.limit, query.offset)
        return df.select(*self._projection(frame, query, ids))

    def _projection(self, frame: Frame, query: Query, ids: bool) -> list:
        out: dict = {}
        if ids or query.star:
            out |= {_ID_NAMES[c] if c != IDS[query.collection][-1] or c == "_event" else "_id": F.col(c) for c in IDS[query.collection]}
        for scope in (EVENT, TRACE, LOG) if query.star else ():
            out |= dict(frame.everything(scope))
        for c in query.columns:
            if isinstance(c, Star):
                out |= dict(frame.everything(c.scope))
            else:
                out.setdefault(c.raw, value(c, frame).output)
        return [c.alias(n) for n, c in out.items()]

    def _check(self, frame: Frame, query: Query) -> None:
        """Names that ORDER BY or GROUP BY use must be there in some row, if there are rows."""
        named = [n for x in (*query.group, *query.order) for n in walk(x) if isinstance(n, Attribute)]
        named = [n for n in named if LEVEL[n.scope] <= LEVEL[frame.scope]]
        lost = [n for n in named if frame.resolve(n) is None and bracketed_expression(n) is None]
        if not lost and frame.dynamic and named:
            unknown = [n for n in named if attribute(n, frame).kind == "any" or n.classifier is not None]
            rows = None
            for n in unknown:  # one row that has it is enough, so most often few are looked at
                if frame.df.where(attribute(n, frame).output.isNotNull()).select(F.lit(1)).first() is None:
                    rows = frame.df.select(F.lit(1)).first() is not None if rows is None else rows
                    lost += [n] if rows else []
        if lost:
            raise QueryError(f"Classifier or attribute '{lost[0].name}' not found")

    def victims(self, text: str) -> tuple[str, DataFrame]:
        """(scope, ids) of what a delete removes itself, without what it removes along."""
        query = analyse(parse(text))
        if not isinstance(query, Delete):
            raise QueryError("not a delete")
        if any(s is not None for s in (*query.limit, *query.offset)):
            raise QueryError("delete takes a limit and offset without a scope")
        needed = {query.scope}.union(*map(needs, query.order)) if query.order else {query.scope}
        frame = filtered(self.layout, query.scope, query.where, needed)
        if query.order or query.limit or query.offset:
            order = [k for o in query.order for k in sort_keys(value(o.expr, frame), o.descending)]
            frame.df = cut(frame.df.orderBy(*order, *[F.col(c) for c in ORDER[query.scope]]), query.limit, query.offset)
        return query.scope, frame.df.select(*IDS[query.scope])

    def remaining(self, text: str) -> DataFrame:
        """The events that a delete leaves, as a frame with identity columns: children go with their parents."""
        scope, gone = self.victims(text)
        left = self.layout.frame(EVENT, {EVENT}).df
        return left.join(gone.distinct(), IDS[scope], "left_anti")


def to_json(result: DataFrame) -> DataFrame:
    """One JSON text a row; attribute maps are spread into keys `scope:name`, nulls are kept."""
    maps = [f.name for f in result.schema.fields if f.dataType.typeName() == "map" and f.name[1:] == ":*"]
    plain = [F.col(f"`{c}`") for c in result.columns if c not in maps]
    if not maps:
        return result.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("json"))

    def prefixed(m: str) -> Column:
        known = F.coalesce(F.col(f"`{m}`"), F.create_map().cast("map<string,string>"))
        return F.transform_keys(known, lambda k, _: F.concat(F.lit(m[:2]), k))

    spread = [prefixed(m) for m in maps]
    keep = {"ignoreNullFields": "false"}
    parts = [F.to_json(F.struct(*plain), keep)] if plain else []
    parts += [F.to_json(m, keep) for m in spread]
    inner = F.filter(F.array(*[F.substring(p, F.lit(2), F.length(p) - 2) for p in parts]), lambda p: p != "")
    return result.select(F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")).alias("json"))
