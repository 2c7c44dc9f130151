"""Mapping inference: the type of each field of documents in JSON."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .place import shared_dir

OBJECT, ARRAY, NESTED = "map<string,variant>", "array<variant>", "^(OBJECT|ARRAY)"

DATE = r"^\d{4}-\d{2}(?:-\d{2}(?:[Tt ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:[Zz]|[+\-]\d{2}:?\d{2})?)?)?$"


def sample(df: DataFrame, percent: float | None = None, rows: int | None = None, seed: int = 0) -> DataFrame:
    """A Bernoulli sample of rows, or so many of them."""
    return df.sample(percent / 100, seed) if percent is not None else df.limit(rows) if rows is not None else df


def top_level(docs: DataFrame, *carried: str) -> DataFrame:
    """(carried..., key, value): the top-level keys of each document, as VARIANT."""
    return docs.select(*carried, F.try_parse_json("_source").alias("__v")).where("__v is not null and schema_of_variant(__v) like 'OBJECT%'").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("__v").outer())).select(*carried, "key", "value")


def infer(docs: DataFrame, version: int = 2) -> DataFrame:
    """(_index, _type, field, type, format): the first document by _timestamp and _id that has a field decides.

    Of a string that reads as a date, the type is date (an empty result where it
    lies before 1970); with a space in it, text; else string.  Integers beyond
    64 bits are objects.
    """
    t = top_level(docs, "_index", "_type", "_timestamp", "_id")
    kind = F.schema_of_variant("value")
    s = F.try_variant_get("value", "$", "string")
    iso = F.try_to_timestamp(F.regexp_replace(F.when(kind == "STRING", F.when(s.rlike(DATE), s)), ",", "."))
    millis = F.when((kind == "STRING") & s.rlike(r"^-?\d{1,18}$"), s.cast("long"))
    made = (
        F.when((kind == "STRING") & iso.isNotNull(), F.when(F.unix_millis(iso) > 0, F.struct(F.lit("date").alias("type"), F.lit("strict_date_optional_time").alias("format"))))
        .when((kind == "STRING") & millis.isNotNull(), F.when(millis > 0, F.struct(F.lit("date").alias("type"), F.lit("epoch_millis").alias("format"))))
        .when((kind == "STRING") & s.contains(" "), F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("format")))
        .when(kind == "STRING", F.struct(F.lit("string").alias("type"), F.lit(None).cast("string").alias("format")))
        .otherwise(F.struct(F.when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "long").when(kind.isin("DOUBLE", "FLOAT") | (kind.startswith("DECIMAL") & s.contains(".")), "double").when(kind.startswith("ARRAY"), "nested").otherwise("object").alias("type"), F.lit(None).cast("string").alias("format")))
    )
    t = t.select("_index", "_type", F.col("key").alias("field"), made.alias("m"), F.struct("_timestamp", "_id").alias("at")).where("m is not null")
    out = t.groupBy("_index", "_type", "field").agg(F.min_by("m", "at").alias("m"))
    return out.select("_index", "_type", "field", "m.type", F.col("m.format").alias("format") if version == 2 else F.lit(None).cast("string").alias("format"))


def pair(field: Column, value: Column) -> Column:
    return F.struct(field.alias("field"), value.alias("value"))


def leaves(source: Column, levels: int, indexed: bool = False) -> Column:
    """An array of (field, value): every leaf under its path; array places are left out, or ``[i]``.

    Objects and arrays that lie deeper than so many levels are still among the values;
    see ``whole``.  Null where the text is no JSON object.
    """

    def opened(x: Column) -> Column:
        name = lambda i: F.concat(x["field"], F.lit("["), i.cast("string"), F.lit("]")) if indexed else x["field"]
        inner = F.transform(F.map_entries(F.try_variant_get(x["value"], "$", OBJECT)), lambda e: pair(F.concat_ws(".", x["field"], e["key"]), e["value"]))
        items = F.transform(F.try_variant_get(x["value"], "$", ARRAY), lambda e, i: pair(name(i), e))
        return F.coalesce(inner, items, F.array(pair(x["field"], x["value"])))

    level = F.transform(F.map_entries(F.try_variant_get(F.try_parse_json(source), "$", OBJECT)), lambda e: pair(e["key"], e["value"]))
    for _ in range(levels):
        level = F.flatten(F.transform(level, opened))
    return level


def whole(spark: SparkSession, made: Callable[[int], DataFrame], levels: int = 2) -> DataFrame:
    """made(levels), for levels enough that its column ``deeper`` is true nowhere.

    The table is written, so that nothing is read twice to know; it is made again, twice
    as deep, only where it was not whole.
    """
    while True:
        df = made(levels)
        path = f"{shared_dir(spark)}/leaves-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        if out.where("deeper").isEmpty():
            return out.drop("deeper")
        levels *= 2


def field_names(docs: DataFrame, indexed: bool = False) -> DataFrame:
    """(_index, _type, field): the paths of all leaves."""

    def names(levels: int) -> DataFrame:
        rows = docs.select("_index", "_type", F.explode(leaves(F.col("_source"), levels, indexed)).alias("x"))
        return rows.select("_index", "_type", "x.field", F.schema_of_variant("x.value").rlike(NESTED).alias("deeper")).distinct()

    return whole(docs.sparkSession, names)
