"""Queries to one boolean column, sort keys to sort columns.

A missing field is null, null is not true, and ``not`` of null isn't either: a
document without the field is in neither a query's result nor its negation's.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import Fields
from ..plans import tree as t
from ..plans.errors import SearchError


def like_pattern(text: str) -> str:
    """For LIKE, which takes a backslash for an escape."""
    return text.replace("\\", "\\\\")


def holds(c: Column, text: str, before: bool = True) -> Column:
    """Whether c holds the text, case ignored; ``%`` and ``_`` in it are wildcards."""
    if "%" in text or "_" in text:
        return c.ilike(("%" if before else "") + like_pattern(text) + "%")
    return F.lower(c).contains(text.lower()) if before else F.lower(c).startswith(text.lower())


def least_matches(spec: str, n: int) -> int:
    """minimum_should_match of n clauses: ``2``, ``-1``, ``60%`` or ``-40%``."""
    m = re.fullmatch(r"\s*(-?)(\d+)(%?)\s*", spec)
    if not m:
        raise SearchError(f"unknown minimum_should_match {spec!r}")
    k = int(m[2]) * n // 100 if m[3] else int(m[2])
    return max(n - k if m[1] else k, 0)


def is_number(v: Any) -> bool:
    try:
        float(v)
    except (TypeError, ValueError):
        return False
    return True


class Compiler:
    def __init__(self, fields: Fields, semantics: t.Semantics = t.Semantics()):
        self.f, self.semantics = fields, semantics

    def query(self, q) -> Column:
        return getattr(self, "on_" + type(q).__name__.strip("_").lower())(q)

    def on_matchall(self, q: t.MatchAll) -> Column:
        return F.lit(True)

    def on_term(self, q: t.Term) -> Column:
        kind = self.f.typed(q.field)
        if isinstance(kind, T.NumericType) and is_number(q.value):
            return self.f.column(q.field) == F.lit(q.value).cast(kind if isinstance(kind, (T.DoubleType, T.FloatType)) or re.fullmatch(r"-?\d+", q.value) else T.DoubleType())
        if isinstance(kind, T.BooleanType) and q.value in ("true", "false"):
            return self.f.column(q.field) == F.lit(q.value == "true")
        return self.f.text(q.field) == q.value

    def on_match(self, q: t.Match) -> Column:
        c = self.f.text(q.field)
        if q.kind == "terms":
            words = q.text.rstrip(" ").split(" ")  # blanks at the end make no word
            return reduce(and_ if q.operator == "and" else or_, [holds(c, w) for w in words])
        return holds(c, q.text, before=q.kind == "phrase")

    def on_contains(self, q: t.Contains) -> Column:
        return holds(self.f.text(q.field), q.text.replace("*", "%").replace("?", "_"))

    def on_prefix(self, q: t.Prefix) -> Column:
        c = self.f.text(q.field)
        return c.like(like_pattern(q.value) + "%") if "%" in q.value or "_" in q.value else c.startswith(q.value)

    def on_wildcard(self, q: t.Wildcard) -> Column:
        return self.f.text(q.field).like(like_pattern(q.pattern).replace("*", "%").replace("?", "_"))

    def on_regexp(self, q: t.Regexp) -> Column:
        return self.f.text(q.field).rlike(rf"\A(?:{q.pattern})\z")

    def on_range(self, q: t.Range) -> Column:
        bounds = [(op, v) for op, v in (("gte", q.gte), ("gt", q.gt), ("lte", q.lte), ("lt", q.lt)) if v is not None]
        kind = self.f.typed(q.field)
        c = self.f.number(q.field)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            # Literals of the column's own type: the filter reaches the scan.
            c = self.f.column(q.field)
            value = lambda v: (F.timestamp_millis(F.lit(int(float(v)))) if is_number(v) else F.lit(v).cast("timestamp")).cast(kind)
        elif any(not is_number(v) for _, v in bounds):
            c = self.f.millis(q.field)
            value = lambda v: F.lit(int(float(v))) if is_number(v) else F.unix_millis(F.lit(v).cast("timestamp"))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            value = lambda v: F.lit(float(v))
        else:
            value = lambda v: F.lit(int(v)) if isinstance(v, int) or re.fullmatch(r"-?\d+", str(v)) else F.lit(str(v)).cast("decimal(38,10)")
        ops = {"gte": lambda v: c >= value(v), "gt": lambda v: c > value(v), "lte": lambda v: c <= value(v), "lt": lambda v: c < value(v)}
        return reduce(and_, [ops[op](v) for op, v in bounds]) if bounds else F.lit(True)

    def on_exists(self, q: t.Exists) -> Column:
        return self.f.exists(q.field)

    def on_ids(self, q: t.Ids) -> Column:
        c = F.col("_id").isin(list(q.values)) if q.values else F.lit(False)
        return c & F.col("_type").isin(list(q.types)) if q.types else c

    def on_oftype(self, q: t.OfType) -> Column:
        return F.col("_type") == q.value

    def on_all(self, q: t.All) -> Column:
        return reduce(and_, map(self.query, q.items)) if q.items else F.lit(True)

    def on_any(self, q: t.Any_) -> Column:
        return reduce(or_, map(self.query, q.items)) if q.items else F.lit(True)

    def on_bool(self, q: t.Bool) -> Column:
        parts = [self.query(x) for x in (*q.must, *q.filter)]
        if q.must_not:
            no = [self.query(x) for x in q.must_not]
            parts += [~reduce(and_, no)] if self.semantics.must_not == "all" else [~x for x in no]
        if q.should:
            some = [self.query(x) for x in q.should]
            k = least_matches(q.minimum, len(some))
            if k == 1:
                parts.append(reduce(or_, some))
            elif k > 1:
                parts.append(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(False)).cast("int") for x in some]) >= k)
        return reduce(and_, parts) if parts else F.lit(True)


def sort_columns(fields: Fields, keys: tuple[t.SortKey, ...]) -> list[tuple[Column, bool]]:
    """(column, falling) of each."""
    return [(c, k.descending) for k in keys for c in fields.sort_keys(k.field)]


def sort_by(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    """Rising keys have nulls last, falling ones first."""
    start = "__key"
    while any(c.lower().startswith(start) for c in df.columns):
        start += "_"
    names = [f"{start}{i}" for i in range(len(keys))]
    made = df.withColumns({n: c for n, (c, _) in zip(names, keys, strict=True)})
    return made.orderBy(*[F.desc_nulls_first(n) if down else F.asc_nulls_last(n) for n, (_, down) in zip(names, keys, strict=True)]).drop(*names)
