"""Expressions and conditions as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.functions import values
from loomtrace.functions.values import Value
from loomtrace.plans.syntax import EVENT, LEVEL, Aggregate, Among, Attribute, Binary, Both, Call, Compare, Literal, Matches, Missing, Not, QueryError, parse_expression, rebuild, walk
from loomtrace.sources.layouts import Frame



def nothing() -> Value:
    return Value("null", F.lit(None).cast("string"))


def bracketed_expression(a: Attribute):
    """A bracketed text that is arithmetic over names of its scope, as a tree; None if it isn't."""
    if not (a.literal and re.search(r"[+\-*/()]", a.name)):
        return None
    try:
        tree = parse_expression(a.name)
    except QueryError:
        return None
    if isinstance(tree, (Attribute, Literal)):
        return None
    return rebuild(tree, lambda x: Attribute(x.scope or a.scope, x.name, 0, True, x.raw))


def _exact_or_standard(a: Attribute, frame: Frame) -> Value:
    """A name inside brackets: as it stands, or else as a short form."""
    exact, standard = frame.resolve(a), frame.resolve(replace(a, literal=False))
    if exact is None or standard is None or not frame.dynamic:
        return exact or standard or nothing()
    return Value("any", F.coalesce(exact.text, standard.text), F.when(exact.text.isNotNull(), exact.number).otherwise(standard.number))


def attribute(a: Attribute, frame: Frame) -> Value:
    found = frame.resolve(a)
    tree = bracketed_expression(a) if found is None or frame.dynamic else None
    if tree is None:
        return found or nothing()
    worked = value(tree, frame, lambda x: _exact_or_standard(x, frame))
    if found is None:
        return worked
    return Value("any", F.coalesce(found.text, worked.text), F.when(found.text.isNotNull(), found.number).otherwise(worked.number))


def value(node, frame: Frame, leaf: Callable[[Attribute], Value] | None = None) -> Value:
    """leaf: what an attribute outside aggregates means in a group."""
    if isinstance(node, Attribute):
        return leaf(node) if leaf else attribute(node, frame)
    if isinstance(node, Literal):
        return values.literal(node)
    if isinstance(node, Binary):
        return values.arithmetic(node.op, value(node.left, frame, leaf), value(node.right, frame, leaf))
    if isinstance(node, Call):
        return values.call(node.name, [value(a, frame, leaf) for a in node.args])
    if isinstance(node, Aggregate):
        # values of a shallower scope are counted once, however many deeper rows repeat them
        return values.aggregate(node.name, attribute(node.attribute, frame), node.attribute.scope != EVENT)
    raise QueryError(f"not an expression: {node}")


def condition(node, frame: Frame) -> Column:
    if isinstance(node, Both):
        left, right = condition(node.left, frame), condition(node.right, frame)
        return left & right if node.op == "and" else left | right
    if isinstance(node, Not):
        return ~condition(node.part, frame)
    if isinstance(node, Compare):
        if any(isinstance(n, Aggregate) for n in walk(node)):
            raise QueryError("aggregates are not allowed in where")
        return values.compare(node.op, value(node.left, frame), value(node.right, frame))
    if isinstance(node, Among):
        # names in a list stand for themselves
        items = [Value("string", F.lit(i.raw), constant=i.raw) if isinstance(i, Attribute) else values.literal(i) for i in node.items]
        found = values.among(value(node.left, frame), [i for i in items if i.kind != "null"])
        return ~found if node.negated else found
    if isinstance(node, Matches):
        return values.matches(value(node.left, frame), node.pattern, node.like)
    if isinstance(node, Missing):
        cross = isinstance(node.left, Attribute) and (node.left.classifier is not None or LEVEL[node.left.scope] < LEVEL[frame.scope])
        return values.missing(value(node.left, frame), node.negated, cross)
    raise QueryError(f"not a condition: {node}")


def sort_keys(v: Value, descending: bool) -> list[Column]:
    """Missing values come last either way; texts that are numbers compare as numbers."""
    keys = [v.column] if v.kind in ("number", "time", "boolean") else [v.number, v.text]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]
