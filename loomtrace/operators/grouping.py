"""Global aggregates, flat groups and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import values
from loomtrace.functions.values import Value
from loomtrace.operators.expressions import attribute, value
from loomtrace.operators.limits import cut
from loomtrace.plans.analysis import has_aggregate
from loomtrace.plans.syntax import EVENT, LOG, TRACE, Aggregate, Attribute, Query, Star, walk
from loomtrace.sources.layouts import IDS, Frame


def _same(a: Attribute, b: Attribute) -> bool:
    return (a.scope, a.name, a.literal) == (b.scope, b.name, b.literal)


def _names(pairs: list[tuple[str, Column]]) -> list[Column]:
    """Columns under their names; a name that comes twice is kept once."""
    seen: dict[str, Column] = {}
    for name, column in pairs:
        seen.setdefault(name, column)
    return [c.alias(n) for n, c in seen.items()]


def row_map(frame: Frame) -> Column:
    """All attributes of a row as text, under scope:name."""
    parts = []
    for scope in (EVENT, TRACE, LOG):
        for name, column in frame.everything(scope):
            if name == f"{scope}:*":
                parts.append(F.coalesce(F.transform_keys(column, _prefix(scope)), F.create_map().cast("map<string,string>")))
            else:
                parts.append(F.create_map(F.lit(name), column.cast("string")))
    return F.map_filter(F.map_concat(*parts), lambda _, v: v.isNotNull())


def _prefix(scope: str):
    return lambda k, _: F.concat(F.lit(f"{scope}:"), k)


def groups(frame: Frame, query: Query, by_trace: bool = False, payload: bool = False) -> DataFrame:
    """A row per group (one for all rows without keys), with the number of its rows as `count`.

    payload: also `events`, an array with the first row's attributes.

    Keys are GROUP BY names and, beside them, attributes in SELECT. Other projections without an aggregate are taken
    from a group's first row. Groups that ORDER BY leaves tied are ordered by their keys.
    """
    keys: list[Attribute] = []
    if query.group:
        for a in [*query.group, *(c for c in query.columns if isinstance(c, Attribute))]:
            if not any(_same(a, k) for k in keys):
                keys.append(a)
    df, columns = frame.df, []
    for i, k in enumerate(keys):
        df = df.withColumn(f"_g{i}", attribute(k, frame).output)
        columns.append(f"_g{i}")
    if by_trace:
        columns = IDS[TRACE]

    def first(column: Column) -> Column:
        return F.min_by(column, frame.order)

    def leaf(a: Attribute) -> Value:
        """An attribute outside aggregates: the key, or the first row's value."""
        v = attribute(a, frame)
        at = next((i for i, k in enumerate(keys) if _same(a, k)), None)
        if at is not None:
            own = F.col(f"_g{at}")
            return Value("any", own, own.try_cast("double")) if v.kind == "any" else Value(v.kind, own, ntz=v.ntz)
        if v.kind == "any":
            return Value("any", first(v.text), first(v.number))
        return Value(v.kind, first(v.column), ntz=v.ntz)

    out: list[tuple[str, Column]] = []
    for c in query.columns:
        if isinstance(c, Star):
            out += [(n, first(x)) for n, x in frame.everything(c.scope)]
        elif has_aggregate(c) or isinstance(c, Attribute):
            out.append((c.raw, value(c, frame, leaf).output))
        else:
            out.append((c.raw, first(value(c, frame).output)))
    if not query.explicit and not by_trace:
        out = [(k.raw, F.col(f"_g{i}")) for i, k in enumerate(keys)]
    if payload:
        out.append(("events", F.array(first(row_map(frame)))))
    shown = list(dict.fromkeys(n for n, _ in out))
    sorts: list[tuple[str, bool]] = []
    extra: list[Column] = []
    for o in query.order:
        v = value(o.expr, frame, leaf) if has_aggregate(o.expr) or isinstance(o.expr, Attribute) else None
        parts = [v.column] if v is not None and v.kind in ("number", "time", "boolean") else [v.number, v.text] if v is not None else [first(value(o.expr, frame).output)]
        for p in parts:
            sorts.append((f"_o{len(extra)}", o.descending))
            extra.append(p.alias(sorts[-1][0]))
    made = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_count"), *extra, *[c for c in _names([(f"_c{shown.index(n)}", x) for n, x in out])])
    if sorts:
        made = made.orderBy(*[F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for n, d in sorts], *columns)
    made = cut(made, query.limit, query.offset)
    ids = [F.col(c).alias(n) for c, n in (("_log", "logId"), ("_trace", "traceId"))] if by_trace else []
    taken = {n.lower() for n in shown}
    count = [] if "count" in taken else [F.col("_count").alias("count")]
    return made.select(*ids, *[F.col(f"_c{i}").alias(n) for i, n in enumerate(shown)], *count)


class _Partial:
    """An aggregate in two steps: by trace, then over the traces of a variant."""

    def __init__(self, node: Aggregate, frame: Frame, name: str):
        self.node, self.name = node, name
        self.v = attribute(node.attribute, frame)
        self.distinct = node.attribute.scope != EVENT

    def by_trace(self) -> list[Column]:
        n, v = self.name, self.v
        if self.node.name == "count":
            return [(F.first(v.output, ignorenulls=True) if self.distinct else F.count(v.output)).alias(n)]
        if self.node.name in ("sum", "avg"):
            x = values.addend(v)
            return [F.sum(x).alias(n), F.count(x).alias(n + "n")]
        pick = F.min if self.node.name == "min" else F.max
        if v.kind in ("number", "time", "boolean"):
            return [pick(v.column).alias(n)]
        return [pick(v.number).alias(n), pick(v.text).alias(n + "t"), F.coalesce(F.bool_and(v.number.isNotNull() | v.text.isNull()), F.lit(True)).alias(n + "a")]

    def merged(self) -> Value:
        c = F.col(self.name)
        if self.node.name == "count":
            total = F.count_distinct(c) if self.distinct else F.sum(c)
            return Value("number", F.nullif(total, F.lit(0).cast("bigint")))
        if self.node.name == "sum":
            return Value("number", F.sum(c))
        if self.node.name == "avg":
            return Value("number", F.try_divide(F.sum(c), F.sum(self.name + "n")))
        pick = F.min if self.node.name == "min" else F.max
        if self.v.kind in ("number", "time", "boolean"):
            return Value(self.v.kind, pick(c), ntz=self.v.ntz)
        numeric = F.bool_and(self.name + "a")
        return Value("any", F.when(numeric, pick(c).cast("string")).otherwise(pick(self.name + "t")), F.when(numeric, pick(c)))


def variants(frame: Frame, query: Query, payload: bool = False) -> DataFrame:
    """Traces grouped by the ordered sequence of an event attribute, and by keys of the trace or log.

    One shuffle brings a trace's events together, where the sequence and partial aggregates are made; another groups
    the traces. `count` is the number of traces. A sequence has to fit in memory, as one value. payload: also `events`,
    the attributes of all events of a variant's first trace.
    """
    hoisted = next(g for g in query.group if g.hoist == 1)
    outer = [g for g in query.group if g.hoist == 0 and g.scope != EVENT]
    order = next((o for o in query.order if not has_aggregate(o.expr) and any(isinstance(n, Attribute) and n.scope == EVENT for n in walk(o.expr))), None)
    step = attribute(hoisted, frame)
    key: list[Column] = []
    if order is not None:
        v = value(order.expr, frame)
        key = [v.column] if v.kind in ("number", "time", "boolean") else [v.number, v.text]
    time = attribute(Attribute(EVENT, "timestamp", 0, False, ""), frame)
    parts = [*[F.isnull(k).alias(f"n{i}") for i, k in enumerate(key)], *[k.alias(f"k{i}") for i, k in enumerate(key)]]
    item = F.struct(*parts, F.col("_ei").alias("ei"), time.text.alias("ts"), step.text.alias("x"), *([F.map_entries(row_map(frame)).alias("m")] if payload else []))
    df = frame.df
    for i, g in enumerate(outer):
        df = df.withColumn(f"_g{i}", attribute(g, frame).output)
    found = [n for c in (*query.columns, *(o.expr for o in query.order)) for n in walk(c) if isinstance(n, Aggregate)]
    partial: list[tuple[Aggregate, _Partial]] = []
    for n in found:
        if not any(n == other for other, _ in partial):
            partial.append((n, _Partial(n, frame, f"_p{len(partial)}")))
    firsts: dict[Attribute, str] = {}
    worked = [c for c in query.columns if not isinstance(c, (Star, Attribute))]
    for c in (*worked, *(o.expr for o in query.order if has_aggregate(o.expr))):
        inside = {id(n.attribute) for n in walk(c) if isinstance(n, Aggregate)}
        for n in walk(c):
            if isinstance(n, Attribute) and id(n) not in inside:
                firsts.setdefault(n, f"_f{len(firsts)}")
    first = [F.min_by(attribute(a, frame).output, frame.order).alias(name) for a, name in firsts.items()]
    keys = [f"_g{i}" for i in range(len(outer))]
    items = F.array_sort(F.collect_list(item))
    if order is not None and order.descending:  # missing keys stay last, equal keys stay in document order
        def after(a: Column, b: Column) -> Column:
            out = F.when(a["ei"] < b["ei"], -1).when(a["ei"] > b["ei"], 1).otherwise(0)
            for i in reversed(range(len(key))):
                x, y, nx, ny = a[f"k{i}"], b[f"k{i}"], a[f"n{i}"], b[f"n{i}"]
                out = F.when(nx & ~ny, 1).when(~nx & ny, -1).when(~nx & ~ny & (x > y), -1).when(~nx & ~ny & (x < y), 1).otherwise(out)
            return out

        items = F.array_sort(F.collect_list(item), after)
    traces = df.groupBy(*IDS[TRACE], *keys).agg(items.alias("_items"), F.min("_ls").alias("_ls"), F.min("_ts").alias("_ts"), *[c for _, p in partial for c in p.by_trace()], *first)
    traces = traces.withColumn("_variant", F.expr("transform(_items, i -> i.x)"))
    traces = traces.withColumn("_events", F.expr("transform(_items, i -> map_from_entries(i.m))")).drop("_items") if payload else traces.drop("_items")
    merged = {n: p.merged() for n, p in partial}
    at = F.struct("_ls", "_ts")

    def settle(node) -> Value:
        if isinstance(node, Aggregate):
            return merged[node]
        if isinstance(node, Attribute):
            v = attribute(node, frame)
            c = F.min_by(firsts[node], at)
            return Value("string" if v.kind == "any" else v.kind, c, ntz=v.ntz)
        if hasattr(node, "op"):
            return values.arithmetic(node.op, settle(node.left), settle(node.right))
        if hasattr(node, "args"):
            return values.call(node.name, [settle(a) for a in node.args])
        return values.literal(node)

    ranks = [o for o in query.order if has_aggregate(o.expr)]
    sort = []
    for i, o in enumerate(ranks[:1]):
        v = settle(o.expr)
        sort = [(c.alias(f"_o{j}"), o.descending) for j, c in enumerate([v.column] if v.kind in ("number", "time", "boolean") else [v.number, v.text])]
    columns = _names([(c.raw, settle(c).output) for c in worked])
    made = traces.groupBy("_variant", *keys).agg(F.count(F.lit(1)).alias("_count"), *[c for c, _ in sort], *columns, *([F.min_by("_events", at).alias("events")] if payload else []))
    by = [F.col(f"_o{j}").desc_nulls_last() if d else F.col(f"_o{j}").asc_nulls_last() for j, (_, d) in enumerate(sort)] or [F.col("_count").desc()]
    made = cut(made.orderBy(*by, "_variant", *keys), query.limit, query.offset)
    names = [c.raw for c in worked]
    return made.select(F.col("_variant").alias("variant"), *[F.col(k).alias(g.raw) for k, g in zip(keys, outer)], *[F.col(f"`{n}`") for n in dict.fromkeys(names)], F.col("_count").alias("count"), *(["events"] if payload else []))
