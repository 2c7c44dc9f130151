"""The syntax tree of a search request."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class MatchAll:
    pass


@dataclass(frozen=True)
class Term:
    field: str
    value: str


@dataclass(frozen=True)
class Match:
    """kind: terms, phrase or prefix; operator joins the terms."""

    field: str
    text: str
    kind: str = "terms"
    operator: str = "or"


@dataclass(frozen=True)
class Prefix:
    field: str
    value: str


@dataclass(frozen=True)
class Wildcard:
    """``*`` is any run, ``?`` any character, over the whole value."""

    field: str
    pattern: str


@dataclass(frozen=True)
class Regexp:
    """Anchored at both ends."""

    field: str
    pattern: str


@dataclass(frozen=True)
class Range:
    field: str
    gte: Any = None
    gt: Any = None
    lte: Any = None
    lt: Any = None


@dataclass(frozen=True)
class Exists:
    field: str


@dataclass(frozen=True)
class Ids:
    values: tuple[str, ...]
    types: tuple[str, ...] = ()


@dataclass(frozen=True)
class OfType:
    value: str


@dataclass(frozen=True)
class Contains:
    """A term of the mini-language: a substring, with ``*`` and ``?`` inside; case ignored."""

    field: str
    text: str


@dataclass(frozen=True)
class All:
    items: tuple


@dataclass(frozen=True)
class Any_:
    items: tuple


@dataclass(frozen=True)
class Bool:
    must: tuple = ()
    filter: tuple = ()
    must_not: tuple = ()
    should: tuple = ()
    minimum: str = "1"


@dataclass(frozen=True)
class SortKey:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Metric:
    """kind: avg sum min max value_count cardinality stats percentiles extended_stats."""

    name: str
    kind: str
    field: str
    percents: tuple[float, ...] = ()


@dataclass(frozen=True)
class Bucket:
    """kind: range, date_histogram, histogram, terms, filter, filters or missing."""

    name: str
    kind: str
    field: str | None = None
    ranges: tuple[tuple[Any, Any], ...] = ()
    interval: Any = None
    filters: tuple = ()
    size: int = 10
    aggs: tuple = ()


@dataclass(frozen=True)
class Request:
    query: Any = MatchAll()
    sort: tuple[SortKey, ...] = ()
    aggs: tuple = ()
    size: int = 10
    offset: int = 0
    extra: dict = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class Semantics:
    """Where the behaviour first observed and the evident intent part, the choices.

    must_not       "all": NOT (a AND b) for a list, "any": NOT a AND NOT b
    range_as_text  range buckets compare text rather than numbers
    calendar       weeks, months, quarters and years by the calendar rather than fixed lengths
    lenient        values that are no numbers count as missing rather than fail
    first_word_whole  field statistics keep a field's first string whole in its bounds
    """

    must_not: str = "all"
    range_as_text: bool = False
    calendar: bool = False
    lenient: bool = False
    first_word_whole: bool = False
