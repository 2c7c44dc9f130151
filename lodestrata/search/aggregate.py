"""Aggregation trees to as few group-bys as there are distinct bucket paths.

All metrics of one path are columns of the same group-by.  Buckets that can
overlap (ranges, filters) give each row the list of those it falls in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import BUCKETS, Fields
from ..plans import tree as t
from ..plans.errors import InvalidFieldType, NoSuchMapping, SearchError
from .compile import Compiler, is_number

UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
NAMED = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 86_400_000, "month": 86_400_000, "quarter": 86_400_000, "year": 365 * 86_400_000}
CALENDAR = {"week", "month", "quarter", "year", "1w", "1M", "1q", "1y"}
STATS = ("avg", "min", "max", "sum", "count")
EXTENDED = (*STATS, "sum_of_squares", "variance", "std_deviation")


def interval_millis(interval: Any) -> int:
    """Length of a fixed interval; a unit that isn't known is a second."""
    text = str(interval)
    if text in NAMED:
        return NAMED[text]
    m = re.fullmatch(r"(\d+)([smhd])", text)
    return int(m[1]) * UNITS[m[2]] if m and int(m[1]) else 1000


@dataclass
class Frame:
    """One bucket path: a row for each bucket, keys first, then doc_count and metrics."""

    path: tuple[t.Bucket, ...]
    metrics: tuple[t.Metric, ...]
    df: DataFrame

    @property
    def keys(self) -> list[str]:
        return [key_name(b) for b in self.path]


def key_name(b: t.Bucket) -> str:
    return f"{b.name}_key"


class Planner:
    def __init__(self, df: DataFrame, fields: Fields, semantics: t.Semantics = t.Semantics()):
        self.df, self.f, self.semantics = df, fields, semantics
        self.compiler = Compiler(fields, semantics)

    # -- metrics

    def metric(self, m: t.Metric, at: int) -> list[Column]:
        """Columns of a metric: name, or name.part where it has several."""
        text = m.kind in ("value_count", "cardinality")
        x = self.f.text(m.field) if text and not self.f.typed(m.field) else self.f.column(m.field) if text else F.col(f"__m{at}")
        if m.kind in ("avg", "sum", "min", "max"):
            return [getattr(F, m.kind)(x).alias(m.name)]
        if m.kind == "value_count":
            return [F.count(x).alias(m.name)]
        if m.kind == "cardinality":
            return [F.countDistinct(x).alias(m.name)]
        if m.kind == "percentiles":
            # One aggregate for all percents; frame() takes the array apart.
            wanted = ", ".join(f"{p / 100!r}D" for p in m.percents)
            return [F.expr(f"percentile_disc(array({wanted})) within group (order by `__m{at}`)").alias(f"__p{at}")]
        made = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "sum_of_squares": lambda c: F.sum(c * c), "variance": F.var_pop, "std_deviation": F.stddev_pop}
        return [made[k](x).alias(f"{m.name}.{k}") for k in (EXTENDED if m.kind == "extended_stats" else STATS)]

    # -- buckets

    def date_key(self, b: t.Bucket) -> Column:
        kind = self.f.typed(b.field)
        if self.f.mapping is not None and kind is None and b.field != self.f.timestamp_path:
            if b.field not in self.f.mapping:
                raise NoSuchMapping(f"no mapping for {b.field!r}")
            if self.f.mapping[b.field].get("type") not in ("date", "long"):
                raise InvalidFieldType(f"{b.field!r} is neither a date nor a long")
        elif kind is not None and not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.IntegralType)):
            raise InvalidFieldType(f"{b.field!r} is neither a date nor a long")
        x = self.f.millis(b.field)
        if self.semantics.calendar and str(b.interval) in CALENDAR:
            unit = {"w": "week", "M": "month", "q": "quarter", "y": "year"}.get(str(b.interval)[-1], str(b.interval))
            return F.unix_millis(F.date_trunc(unit, F.timestamp_millis(x)))
        size = interval_millis(b.interval)
        if b.field == self.f.timestamp_path:  # the coarsest bucket written with the document that divides the interval
            fits = [n for n in (86_400_000, 3_600_000, 60_000, 1000) if size % n == 0]
            if fits and BUCKETS[fits[0]] in self.f.types:
                x = F.col(BUCKETS[fits[0]])
                if fits[0] == size:
                    return x
        return x - x % size

    def bounds(self, b: t.Bucket) -> list[Column]:
        if b.kind == "range":
            out = []
            for lo, hi in b.ranges:
                if not self.semantics.range_as_text and any(isinstance(v, str) and not is_number(v) for v in (lo, hi)):  # dates
                    out.append(self.compiler.on_range(t.Range(b.field, gte=lo, lt=hi)))
                    continue
                as_text = self.semantics.range_as_text
                x = self.f.text(b.field) if as_text else self.f.number(b.field)
                lit = (lambda v: F.lit(str(v))) if as_text else (lambda v: F.lit(float(v) if isinstance(v, float) or "." in str(v) else int(v)))
                parts = ([x >= lit(lo)] if lo is not None else []) + ([x < lit(hi)] if hi is not None else [])
                out.append(reduce(and_, parts) if parts else x.isNotNull())
            return out
        if b.kind == "missing":
            return [~F.coalesce(self.f.exists(b.field), F.lit(False))]
        return [self.compiler.query(q) for _, q in b.filters]

    def key(self, b: t.Bucket) -> Column:
        """The bucket's key; an array of bucket numbers where buckets can overlap."""
        if b.kind == "date_histogram":
            return self.date_key(b)
        if b.kind == "histogram":
            step = float(b.interval)
            if step <= 0:
                raise SearchError("an interval must be above 0")
            return F.floor(self.f.number(b.field).cast("double") / step) * step
        if b.kind == "terms":
            return self.f.column(b.field)
        return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i)) for i, c in enumerate(self.bounds(b))]), lambda x: x.isNotNull())

    @staticmethod
    def overlaps(b: t.Bucket) -> bool:
        return b.kind in ("range", "filter", "filters", "missing")

    def frame(self, path: tuple[t.Bucket, ...], metrics: tuple[t.Metric, ...]) -> Frame:
        df = self.df
        needed = [self.f.number(m.field).alias(f"__m{i}") for i, m in enumerate(metrics) if m.kind not in ("value_count", "cardinality")]
        df = df.select("*", *needed, *[self.key(b).alias(f"__k{i}") for i, b in enumerate(path)])
        for i, b in enumerate(path):
            df = df.withColumn(f"__k{i}", F.explode(f"__k{i}")) if self.overlaps(b) else df.where(F.col(f"__k{i}").isNotNull())
        columns = [c for i, m in enumerate(metrics) for c in self.metric(m, i)]
        keys = [F.col(f"__k{i}").alias(key_name(b)) for i, b in enumerate(path)]
        out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count"), *columns)
        for i, m in enumerate(metrics):
            if m.kind == "percentiles":
                out = out.withColumns({f"{m.name}.{p!r}": F.get(f"__p{i}", F.lit(n)) for n, p in enumerate(m.percents)}).drop(f"__p{i}")
        if not path:
            return Frame(path, metrics, out)
        if len(path) == 1 and self.overlaps(path[0]):  # buckets without documents stay
            all_keys = self.df.sparkSession.range(len(self.bounds(path[0]))).select(F.col("id").cast("int").alias(key_name(path[0])))
            out = all_keys.join(out, key_name(path[0]), "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
            out = out.withColumns({m.name: F.coalesce(F.col(f"`{m.name}`"), F.lit(0)) for m in metrics if m.kind in ("value_count", "cardinality")})
        return Frame(path, metrics, out)

    def frames(self, aggs: tuple, path: tuple[t.Bucket, ...] = (), kept: dict | None = None) -> list[Frame]:
        metrics = tuple(a for a in aggs if isinstance(a, t.Metric))
        found = []
        if path or metrics:
            f = self.frame(path, metrics)
            for n, b in enumerate(path, 1):  # only the most frequent terms, and what is below them
                if b.kind != "terms":
                    continue
                names = [key_name(x) for x in path[:n]]
                counts = f.df if n == len(path) else self.frame(path[:n], ()).df
                top = Window.partitionBy(*names[:-1]).orderBy(F.desc("doc_count"), F.col(names[-1]))
                counts = counts.withColumn("__n", F.row_number().over(top)).where(F.col("__n") <= b.size).drop("__n")
                f.df = counts if n == len(path) else f.df.join(counts.select(*names), names, "left_semi")
            found.append(f)
        for b in aggs:
            if isinstance(b, t.Bucket):
                found += self.frames(b.aggs, (*path, b))
        return found


# -- results -----------------------------------------------------------------


def plain(v: Any) -> Any:
    import decimal

    return float(v) if isinstance(v, decimal.Decimal) else v


def metric_json(m: t.Metric, row: dict) -> dict:
    if m.kind == "percentiles":
        return {"values": {repr(p): plain(row.get(f"{m.name}.{p!r}")) for p in m.percents}}
    if m.kind in ("stats", "extended_stats"):
        return {k: plain(row.get(f"{m.name}.{k}")) for k in (EXTENDED if m.kind == "extended_stats" else STATS)}
    return {"value": plain(row.get(m.name))}


def nested(aggs: tuple, frames: list[Frame], total: int) -> dict:
    """The response's aggregations, from the frames' rows (one bucket each)."""
    rows: dict = {}  # of each path, the buckets by those they lie in
    for f in frames:
        rows[f.path] = {}
        for r in f.df.toLocalIterator():
            rows[f.path].setdefault(tuple(r[k] for k in f.keys[:-1]), []).append(r.asDict())

    def below(aggs: tuple, path: tuple, values: tuple, row: dict) -> dict:
        out: dict = {a.name: metric_json(a, row) for a in aggs if isinstance(a, t.Metric)}
        for b in aggs:
            if not isinstance(b, t.Bucket):
                continue
            here = (*path, b)
            names = [key_name(x) for x in here]
            mine = sorted(rows[here].get(values, []), key=lambda r: (-r["doc_count"] if b.kind == "terms" else 0, r[names[-1]]))
            made = {r[names[-1]]: {"doc_count": r["doc_count"], **below(b.aggs, here, (*values, r[names[-1]]), r)} for r in mine}
            blank = {"doc_count": 0, **below(b.aggs, here, (*values, object()), {})} if Planner.overlaps(b) else {}
            if b.kind == "range":
                buckets = [{**({"from": lo} if lo is not None else {}), **({"to": hi} if hi is not None else {}), **made.get(i, blank)} for i, (lo, hi) in enumerate(b.ranges)]
                out[b.name] = {"buckets": buckets if total else []}
            elif b.kind == "filters":
                out[b.name] = {"buckets": {k: made.get(i, blank) for i, (k, _) in enumerate(b.filters)}}
            elif b.kind in ("filter", "missing"):
                out[b.name] = made.get(0, blank)
            else:
                out[b.name] = {"buckets": [{"key": k, **v} for k, v in made.items()]}
        return out

    return below(aggs, (), (), rows[()][()][0] if () in rows else {})
