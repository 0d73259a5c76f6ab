"""WHERE: filters, and semi-joins where conditions are on other scopes than the rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.names import standard_name
from loomtrace.operators.expressions import condition
from loomtrace.plans.analysis import scopes_of
from loomtrace.plans.syntax import EVENT, LEVEL, LOG, TRACE, Attribute, Both, Compare, Literal, walk
from loomtrace.sources.layouts import IDS, BoundLayout, Frame


def conjuncts(node) -> list:
    if isinstance(node, Both) and node.op == "and":
        return conjuncts(node.left) + conjuncts(node.right)
    return [] if node is None else [node]


def needs(node) -> set[str]:
    """Scopes an expression reads; classifiers may read all."""
    return scopes_of(node) | ({"classifier"} if any(isinstance(n, Attribute) and n.classifier is not None for n in walk(node)) else set())


def _attributes(nodes) -> list[Attribute]:
    return [n for node in nodes for n in walk(node) if isinstance(n, Attribute)]


def filtered(layout, collection: str, where, needed: set[str], looked: Iterable[Attribute] = (), shown: bool = False) -> Frame:
    """The collection's frame, with the rows that satisfy `where`.

    A condition on parents alone that nothing else needs becomes a semi-join with the filtered parents; conditions on
    the rows' own scope, or mixed ones, are filters over joined rows; conditions on deeper rows ask that one deeper row
    satisfies them all. looked: attributes that are looked up beside those of `where`; shown: all are.
    """
    own, parents, deeper = [], {LOG: [], TRACE: []}, []
    for c in conjuncts(where):
        used = scopes_of(c) or {collection}
        deepest = max(used, key=LEVEL.get)
        if LEVEL[deepest] > LEVEL[collection]:
            deeper.append(c)
        elif len(used) == 1 and deepest != collection and deepest not in needed and "classifier" not in needs(c) and not (layout.flat and (collection == EVENT or isinstance(layout, BoundLayout))):
            parents[deepest].append(c)
        else:
            own.append(c)
    needed = needed.union(*map(needs, own)) if own else needed
    if isinstance(layout, BoundLayout):  # conditions come before events are grouped to traces or logs
        frame = layout.frame(collection, needed, [lambda f, c=c: _narrowed(f.df, c, f, layout).where(condition(c, f)) for c in own])
        df = frame.df
    else:
        frame = layout.frame(collection, needed, [*looked, *_attributes(own)], shown)
        df = frame.df
        for c in own:
            df = df.where(condition(c, frame))
    for scope, found in parents.items():
        if found:
            df = _semi(df, layout, scope, found, IDS[scope])
    if deeper:
        scope = max(set().union(*map(scopes_of, deeper)), key=LEVEL.get)
        df = _semi(df, layout, scope, deeper, IDS[collection])
    frame.df = df
    return frame


def _semi(df: DataFrame, layout, scope: str, found: list, keys: list[str]) -> DataFrame:
    own = set().union(*map(needs, found))
    other = layout.frame(scope, own) if isinstance(layout, BoundLayout) else layout.frame(scope, own, _attributes(found))
    test = reduce(lambda a, b: a & b, [condition(c, other) for c in found])
    return df.join(other.df.where(test).select(*keys), keys, "left_semi")


def _narrowed(df: DataFrame, node, frame: Frame, layout: BoundLayout) -> DataFrame:
    """What `attribute = 'text'` implies for other attributes, as the binding says; those predicates reach the scan."""
    if isinstance(node, Compare) and node.op == "=":
        for a, b in ((node.left, node.right), (node.right, node.left)):
            if isinstance(a, Attribute) and a.classifier is None and isinstance(b, Literal) and b.kind == "string":
                for name, expression in layout.binding.implied.get((a.scope, standard_name(a.name, a.literal)), {}).items():
                    df = df.where(frame.find(a.scope, name).column == F.expr(expression.replace(":v", "'" + b.value.replace("\\", "\\\\").replace("'", "\\'") + "'")))
    return df


