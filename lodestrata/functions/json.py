"""Scalar functions over JSON documents, times and words."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import BUCKETS, json_path

SLOTS = {"MINUTE": (60_000, 1000), "HOUR": (3_600_000, 60_000), "DAY": (86_400_000, 3_600_000)}
WORD_BREAK = r"[\s   -​    　﻿]+"


class Raw(str):
    """A number as it was written."""


def encode(v) -> str:
    return v if isinstance(v, Raw) else json.dumps(v, ensure_ascii=False)


def flat_items(v, name: str) -> Iterator[tuple[str, str]]:
    """Leaves of a decoded value (objects are lists of pairs), names joined by ``_``; an empty array is null."""
    if isinstance(v, list) and v and all(isinstance(x, tuple) for x in v):
        for k, x in v:
            yield from flat_items(x, f"{name}_{k}" if name else k)
    elif isinstance(v, Array):
        if not v.items:
            yield name, "null"
        for i, x in enumerate(v.items):
            yield from flat_items(x, f"{name}_{i}" if name else str(i))
    elif not isinstance(v, list):
        yield name, encode(v)


class Array:
    def __init__(self, items: list):
        self.items = items


def mark_arrays(v):
    """Tells arrays from objects: json gives lists for both here."""
    if isinstance(v, dict):
        return [(k, mark_arrays(x)) for k, x in v.items()]
    return Array([mark_arrays(x) for x in v]) if isinstance(v, list) else v


def flatten_text(text: str | None) -> str | None:
    """``{"a":{"b":1},"c":[2]}`` as ``{"a_b":1,"c_0":2}``; null where it is no JSON object."""
    try:
        v = json.loads(text, parse_float=Raw, parse_int=Raw)
    except (TypeError, ValueError):
        return None
    if not isinstance(v, dict):
        return None
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{x}" for k, x in flat_items(mark_arrays(v), "")) + "}"


def merge_text(a: str | None, b: str | None) -> str | None:
    """A shallow merge of two objects, the right one's keys winning."""
    if a is None or b is None:
        return b if a is None else a
    made = {**json.loads(a, parse_float=Raw, parse_int=Raw), **json.loads(b, parse_float=Raw, parse_int=Raw)}
    return render(made)


def render(v) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{render(x)}" for k, x in v.items()) + "}"
    return "[" + ",".join(map(render, v)) + "]" if isinstance(v, list) else encode(v)


def find_key(v, key: str):
    """The first value under this key, at any depth."""
    if isinstance(v, dict):
        for k, x in v.items():
            if k == key:
                return x
            if (found := find_key(x, key)) is not None:
                return found
    if isinstance(v, list):
        for x in v:
            if (found := find_key(x, key)) is not None:
                return found
    return None


@F.pandas_udf(T.StringType())
def flatten_json(text: pd.Series) -> pd.Series:
    return text.map(flatten_text)


@F.pandas_udf(T.StringType())
def merge_json(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([merge_text(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def merge_all(parts: pd.Series) -> pd.Series:
    """Arrays of objects, each merged from the first to the last."""
    return pd.Series([reduce(merge_text, x) for x in parts], dtype=object)


def deep_millis(path: str):
    @F.pandas_udf(T.LongType())
    def find(text: pd.Series) -> pd.Series:
        def one(x):
            try:
                v = find_key(json.loads(x), path)
                return None if v is None or isinstance(v, bool) else int(v)
            except (TypeError, ValueError):
                return None

        return pd.Series([one(x) for x in text], dtype="Int64")

    return find


def timestamp_of(source: Column, path: str | None, now: Column | None = None, deep: bool = False) -> Column:
    """Epoch milliseconds under the template's key; now, where there is none.  ``deep`` looks in inner objects too."""
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    if not path:
        return now
    top = F.get_json_object(source, json_path(path)).try_cast("bigint")
    return F.coalesce(top, deep_millis(path)(source), now) if deep else F.coalesce(top, now)


def with_buckets(df, timestamp: str = "_timestamp"):
    """The four bucket columns: the timestamp cut to seconds, minutes, hours and days."""
    t = F.col(timestamp)
    return df.withColumns({name: t - t % size for size, name in BUCKETS.items()})


def shard_offset(t: Column, bucket: str) -> Column:
    """Which slot of its minute, hour or day a time falls in: 60, 60 or 24 of them."""
    size, slot = SLOTS[bucket]
    return F.abs(F.floor((t % size) / slot)).cast("int")


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def clean(text: str) -> str:
    """What can't be stored goes: the NUL character."""
    return re.sub("\x00", "", text)
