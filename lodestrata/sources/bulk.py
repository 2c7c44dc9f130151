"""Bulk requests: pairs of lines, an action and a document."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json import clean, flatten_json, timestamp_of, with_buckets
from .catalog import COLUMNS, Catalog

#: A written NUL: its backslash isn't escaped itself.
NUL = re.compile(r"(?<!\\)((?:\\\\)*)\\u0000")
SPLIT = re.compile(r"(?<=\})\s*\n")


@dataclass
class Bulk:
    """What a bulk request holds: (index, type, id, document) of what can be indexed; whether anything was refused."""

    rows: list[tuple[str, str, str, str]] = field(default_factory=list)
    errors: bool = False


def parse_bulk(body: str, index: str | None = None, kind: str | None = None) -> Bulk:
    """Only ``index`` actions count.  A pair that can't be read is left out and sets ``errors``."""
    found = Bulk()
    lines = [x for x in SPLIT.split(body) if x.strip()]
    for i in range(0, len(lines) - 1, 2):
        try:
            action, doc = json.loads(lines[i]), lines[i + 1].strip()
            if not isinstance(json.loads(doc), dict):
                raise ValueError("a document is an object")
        except ValueError:
            found.errors = True
            continue
        if not isinstance(action, dict) or set(action) != {"index"}:
            found.errors = True
            continue
        head = action["index"]
        name, t = head.get("_index", index), head.get("_type", kind)
        if name is None or t is None:
            found.errors = True
            continue
        found.rows.append((name, t, str(head.get("_id") or uuid.uuid4()), clean(NUL.sub(r"\1", doc))))
    found.errors |= len(lines) % 2 == 1
    return found


def read_pairs(lines: DataFrame) -> DataFrame:
    """(_index, _type, _id, _source) from a text source of files with action and document lines in turn.

    A line's place is its block's start in the file, then its order in the block.
    """
    order = Window.partitionBy("file").orderBy("block", "at")
    at = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where("trim(value) <> ''")
    at = at.withColumn("n", F.row_number().over(order)).withColumn("head", F.lag("value").over(order)).where("n % 2 = 0")
    head = lambda k: F.get_json_object("head", f"$.index.{k}")
    return at.select(head("_index").alias("_index"), head("_type").alias("_type"), F.coalesce(head("_id"), F.uuid()).alias("_id"), F.col("value").alias("_source")).where("_index is not null and is_variant_null(try_parse_json(_source)) = false")


def documents(df: DataFrame, timestamp_path: str | None = None, flatten: bool = False, deep: bool = False) -> DataFrame:
    """Document rows from (_index, _type, _id, _source): flattened if wanted, with times and buckets."""
    source = flatten_json("_source") if flatten else F.col("_source")
    made = df.select("_index", "_type", F.coalesce("_id", F.uuid()).alias("_id"), source.alias("_source"), timestamp_of(F.col("_source"), timestamp_path, deep=deep).alias("_timestamp"))
    return with_buckets(made).select(*COLUMNS)


def bulk_documents(spark: SparkSession, catalog: Catalog, bulk: Bulk, flatten: bool = False) -> DataFrame:
    """Document rows of a parsed bulk request, each index with its template's timestamp."""
    df = spark.createDataFrame(bulk.rows, "_index string, _type string, _id string, _source string")
    parts = []
    for path in {(t.storage.timestamp_path if (t := catalog.template_for(n)) else None) for n in {r[0] for r in bulk.rows}}:
        names = [n for n in {r[0] for r in bulk.rows} if (t.storage.timestamp_path if (t := catalog.template_for(n)) else None) == path]
        parts.append(documents(df.where(F.col("_index").isin(names)), path, flatten))
    out = parts[0] if parts else documents(df)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
