"""Values with string, number, boolean and time views, and the language's functions over them.

A value of a bound column has one static kind, so its expressions stay plain typed columns that reach the scan. A value
of a log's attribute map is dynamic: its kind may differ from row to row, and every operation decides by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.plans.syntax import Literal, QueryError

DAY_MS = 86400000.0


@dataclass(frozen=True)
class Value:
    """kind: string, number, boolean, time, any or null.

    time is a timestamp column, or one without time zone (ntz), which is read as UTC; any has text and, where numeric,
    num. constant marks a literal; whole a column of integers.
    """

    kind: str
    column: Column
    num: Column | None = None
    constant: object = None
    ntz: bool = False
    whole: bool = False

    @property
    def text(self) -> Column:
        if self.kind == "time":
            return iso_text(local_time(self), F.lit("Z"))
        return self.column if self.kind in ("string", "any") else self.column.cast("string")

    @property
    def number(self) -> Column:
        """As a number, or null: texts are parsed."""
        if self.kind == "number":
            return self.column.cast("double")
        if self.kind == "any":
            return self.num
        if self.kind == "string":
            return F.lit(_as_number(self.constant)).cast("double") if self.constant is not None else self.column.try_cast("double")
        return F.lit(None).cast("double")

    @property
    def output(self) -> Column:
        return self.column


def _as_number(text: object) -> float | None:
    try:
        return float(str(text))
    except ValueError:
        return None


def literal(node: Literal) -> Value:
    if node.kind == "number":
        return Value("number", F.lit(node.value), constant=node.value)
    if node.kind == "boolean":
        return Value("boolean", F.lit(node.value), constant=node.value)
    if node.kind == "null":
        return Value("null", F.lit(None).cast("string"))
    return Value("string", F.lit(node.value), constant=node.value)


def of_column(column: Column, spark_type: str) -> Value:
    """A bound column by its Spark type."""
    if spark_type == "string":
        return Value("string", column)
    if spark_type == "boolean":
        return Value("boolean", column)
    if spark_type in ("timestamp", "timestamp_ntz"):
        return Value("time", column, ntz=spark_type == "timestamp_ntz")
    if spark_type == "date":
        return Value("time", column.cast("timestamp_ntz"), ntz=True)
    if spark_type in ("tinyint", "smallint", "int", "bigint"):
        return Value("number", column, whole=True)
    if spark_type in ("float", "double") or spark_type.startswith("decimal"):
        return Value("number", column)
    return Value("string", column.cast("string"))


def of_attribute(entry: Column) -> Value:
    """An entry of an attribute map: struct(tag, s, n, b, chain)."""
    text = F.coalesce(entry["s"], entry["n"].cast("string"), entry["b"].cast("string"))
    num = F.coalesce(entry["n"], F.when(entry["tag"].isin("string", "id"), entry["s"].try_cast("double")))
    return Value("any", text, num)


# --- times ---------------------------------------------------------------------------------------------------------


def _offset(text: Column) -> Column:
    return F.regexp_extract(text, r"(Z|[+-]\d{2}(?::?\d{2})?)$", 1)


def local_time(v: Value) -> Column:
    """The clock time as written, without its offset; null unless it is an ISO time with an offset."""
    if v.kind == "time":
        return v.column if v.ntz else F.to_utc_timestamp(v.column, F.current_timezone()).cast("timestamp_ntz")
    ok = v.text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}(:?\d{2})?)$")
    bare = F.regexp_replace(v.text, r"(Z|[+-]\d{2}(:?\d{2})?)$", "")
    return F.when(ok, bare.try_cast("timestamp_ntz"))


def parsed_time(text: Column) -> Column:
    """A timestamp from ISO text, whose seconds may be left out; null if it is none."""
    return F.regexp_replace(text, r"(T\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2").try_cast("timestamp")


def constant_time(text: str) -> datetime | None:
    """The UTC clock time of an ISO text; without an offset it is UTC."""
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        return None
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def instant_ms(v: Value) -> Column:
    """Milliseconds since 1970 of a time, or null."""
    if v.kind == "time":
        return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), v.column).cast("timestamp") if v.ntz else v.column).cast("double")
    if v.kind in ("string", "any"):
        ok = v.text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}")
        return F.when(ok, F.unix_millis(parsed_time(v.text))).cast("double")
    return F.lit(None).cast("double")


def iso_text(local: Column, offset: Column) -> Column:
    """ISO text of a local time and an offset; zero seconds and fractions are left out."""
    fraction = F.date_format(local, "SSSSSS")
    shown = F.when(fraction == "000000", "").when(fraction.endswith("000"), F.concat(F.lit("."), F.substring(fraction, 1, 3))).otherwise(F.concat(F.lit("."), fraction))
    seconds = F.date_format(local, "ss")
    tail = F.when((seconds == "00") & (shown == ""), "").otherwise(F.concat(F.lit(":"), seconds, shown))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm"), tail, offset)


def _shown_offset(v: Value) -> Column:
    return F.lit("Z") if v.kind == "time" else F.regexp_replace(_offset(v.text), r"^[+-]00:?(00)?$", "Z")


_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "dayofweek": F.dayofweek}


def call(name: str, args: list[Value]) -> Value:
    if name == "now":
        return Value("string", iso_text(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"), F.lit("Z")))
    (v,) = args
    if name == "same":
        return v
    if name in ("upper", "lower"):
        return Value("string", (F.upper if name == "upper" else F.lower)(v.text))
    if name == "round":
        return Value("number", F.floor(v.number + 0.5))
    local = local_time(v)
    if name in _PARTS:
        return Value("number", _PARTS[name](local).cast("bigint"))
    if name == "millisecond":
        return Value("number", F.date_format(local, "SSS").cast("bigint"))
    if name == "date":
        return Value("string", iso_text(F.date_trunc("day", local), _shown_offset(v)))
    if name == "time":
        day = F.concat(F.lit("1970-01-01T"), F.date_format(local, "HH:mm:ss.SSSSSS")).try_cast("timestamp_ntz")
        return Value("string", iso_text(day, _shown_offset(v)))
    raise QueryError(f"unknown function {name}")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Numbers are doubles; + joins texts; - of two times is in days."""
    static = all(v.kind in ("number", "null") or (v.kind == "string" and v.constant is not None and _as_number(v.constant) is not None) for v in (a, b))
    x, y = a.number, b.number
    if op == "*":
        return Value("number", x * y)
    if op == "/":
        return Value("number", F.try_divide(x, y))
    if static:
        return Value("number", x + y if op == "+" else x - y)
    both = x.isNotNull() & y.isNotNull()
    if op == "+":
        joined = F.concat(a.text, b.text)
        if any(v.kind == "string" and v.constant is not None and _as_number(v.constant) is None or v.kind in ("time", "boolean") for v in (a, b)):
            return Value("string", joined)
        return Value("any", F.when(both, (x + y).cast("string")).otherwise(joined), x + y)
    texts = x.isNull() & y.isNull() & a.text.isNotNull() & b.text.isNotNull()
    days = (F.coalesce(instant_ms(a), F.lit(0.0)) - F.coalesce(instant_ms(b), F.lit(0.0))) / DAY_MS
    return Value("number", F.when(both, x - y).when(texts, days))


# --- predicates ----------------------------------------------------------------------------------------------------


def _numeric(v: Value) -> bool:
    return v.kind == "number"


def _constant_like(v: Value, number: float) -> Column:
    """A number in the type of the column that it is compared to, so the comparison reaches the scan.

    Doubles and integers compare alike where the constant is whole and exact as a double.
    """
    return F.lit(int(number)) if v.whole and abs(number) < 2**53 and number == int(number) else F.lit(number)


def compare(op: str, a: Value, b: Value) -> Column:
    """Numbers if a side is one, times if both are, else text. Null on a missing side."""
    if "null" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    use = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if _numeric(a) and _numeric(b):
        if b.constant is not None:
            return use(a.column, _constant_like(a, float(b.constant)))
        return use(_constant_like(b, float(a.constant)), b.column) if a.constant is not None else use(a.column, b.column)
    if a.kind == "boolean" and b.kind == "boolean":
        return use(a.column, b.column)
    if a.kind == "time" or b.kind == "time":
        t, other = (a, b) if a.kind == "time" else (b, a)
        if other.constant is not None:
            when = constant_time(str(other.constant))
            if when is None:
                return use(a.text, b.text)
            if t.ntz:  # a constant of the column's own type, so the comparison reaches the scan
                fixed = F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")
            else:
                fixed = F.timestamp_micros(F.lit(int((when - datetime(1970, 1, 1)) / timedelta(microseconds=1))))
            return use(t.column, fixed) if t is a else use(fixed, t.column)
        return use(instant_ms(a), instant_ms(b))
    if _numeric(a) or _numeric(b):
        n, t = (a, b) if _numeric(a) else (b, a)
        if t.kind == "string" and t.constant is not None:
            as_number = _as_number(t.constant)
            if as_number is None:
                return use(a.text, b.text)
            return use(a.column, _constant_like(a, as_number)) if n is a else use(_constant_like(b, as_number), b.column)
        x, y = a.number, b.number
        by_text = use(a.text, b.text) if op in ("=", "!=") else F.lit(None).cast("boolean")
        return F.when(x.isNotNull() & y.isNotNull(), use(x, y)).otherwise(by_text)
    by_text = use(a.text, b.text)
    if a.kind == b.kind == "string" and op in ("=", "!="):
        return by_text
    x, y = a.number, b.number
    dynamic = a.kind == "any" or b.kind == "any"
    if op in ("=", "!="):
        return F.when(x.isNotNull() & y.isNotNull(), use(x, y)).otherwise(by_text) if dynamic else by_text
    s, t = instant_ms(a), instant_ms(b)
    out = F.when(s.isNotNull() & t.isNotNull(), use(s, t)).otherwise(by_text)
    return F.when(x.isNotNull() & y.isNotNull(), use(x, y)).otherwise(out)


def among(a: Value, items: list[Value]) -> Column:
    """Membership: the same test as =, with one list per kind where kinds are static."""
    if a.kind == "string" and all(v.kind == "string" and v.constant is not None for v in items):
        return a.column.isin([v.constant for v in items])
    if a.kind == "number" and all(v.constant is not None and _as_number(v.constant) is not None and v.kind != "boolean" for v in items):
        numbers = [_as_number(v.constant) for v in items]
        whole = a.whole and all(abs(n) < 2**53 and n == int(n) for n in numbers)
        return a.column.isin([int(n) for n in numbers] if whole else numbers)
    out = F.lit(False)
    for v in items:
        out = out | compare("=", a, v)
    return out


def like_pattern(pattern: str) -> str:
    """% stands for any text, all else for itself; the match may lie anywhere."""
    return ".*".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", part) for part in pattern.split("%"))


def matches(a: Value, pattern: str, like: bool) -> Column:
    if not like:
        return a.text.rlike(pattern)
    core = pattern.strip("%")
    return a.text.contains(core) if "%" not in core else a.text.rlike(like_pattern(pattern))


def missing(a: Value, negated: bool, cross: bool) -> Column:
    """Absent; across scopes and for classifiers blank and 'null' texts count as absent, as they do for is not null."""
    if a.kind in ("number", "boolean", "time"):
        return a.column.isNotNull() if negated else a.column.isNull()
    blank = F.coalesce(a.text.isin("", "null"), F.lit(True))
    if negated:
        return ~blank
    return blank if cross else a.text.isNull()


# --- aggregates ----------------------------------------------------------------------------------------------------


def addend(v: Value) -> Column:
    """What sum and avg add: numbers; times in milliseconds; other texts 0; booleans nothing."""
    if v.kind == "number":
        return v.column.cast("double")
    if v.kind == "time":
        return instant_ms(v)
    if v.kind in ("boolean", "null"):
        return F.lit(None).cast("double")
    return F.when(v.text.isNotNull(), F.coalesce(v.number, instant_ms(v), F.lit(0.0)))


def aggregate(name: str, v: Value, distinct: bool) -> Value:
    """count gives null, not 0, if nothing is there; of a shallower scope it counts different values."""
    if name == "count":
        n = F.count_distinct(v.output) if distinct else F.count(v.output)
        return Value("number", F.nullif(n, F.lit(0).cast("bigint")))
    if name in ("sum", "avg"):
        return Value("number", (F.sum if name == "sum" else F.avg)(addend(v)))
    pick = F.min if name == "min" else F.max
    if v.kind in ("number", "time", "boolean"):
        return Value(v.kind, pick(v.column), ntz=v.ntz)
    numeric = F.coalesce(F.bool_and(v.number.isNotNull() | v.text.isNull()), F.lit(False))
    n = pick(v.number)
    return Value("any", F.when(numeric, n.cast("string")).otherwise(pick(v.text)), F.when(numeric, n))
