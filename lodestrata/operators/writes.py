"""Writes as plans: what a table of documents becomes by a batch of others.

Every function takes and returns DataFrames keyed by (_index, _type, _id).
Within a batch, the row of the greatest ``order`` column counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import merge_json
from ..plans.errors import DocumentExists, UpdateNotAllowed

KEYS = ["_index", "_type", "_id"]


def latest(df: DataFrame, *order: Column, keys: list[str] = KEYS) -> DataFrame:
    """One row of each key: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def overwrite(existing: DataFrame, batch: DataFrame, order: Column | None = None, keys: list[str] = KEYS) -> DataFrame:
    """The batch's documents in the place of those of the same key."""
    new = batch if order is None else latest(batch, order.desc(), keys=keys)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*existing.columns))


def create(existing: DataFrame, batch: DataFrame, strict: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """The batch's documents whose key isn't there yet, added.  ``strict`` refuses a batch with one that is."""
    if strict and not batch.join(existing.select(*keys), keys, "left_semi").isEmpty():
        raise DocumentExists("a document of this id exists")
    return existing.unionByName(batch.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def update(existing: DataFrame, batch: DataFrame, unwrap: bool = True, id_enabled: bool = True, keys: list[str] = KEYS) -> DataFrame:
    """Shallow merge of the batch's ``_source`` into the documents; those not there are added.

    unwrap: take what is under ``doc``, where there is such a key.
    """
    if not id_enabled:
        raise UpdateNotAllowed("documents of this index have no lasting id")
    part = F.coalesce(F.get_json_object("_source", "$.doc"), F.col("_source")) if unwrap else F.col("_source")
    names = existing.columns
    new = batch.select(*names).withColumn("_source", part).select(*keys, *[F.col(c).alias(f"__{c}") for c in names if c not in keys])
    both = existing.withColumn("__old", F.lit(True)).join(new, keys, "full_outer")
    merged = F.when(F.col("___source").isNull(), F.col("_source")).when(F.col("__old").isNull(), F.col("___source")).otherwise(merge_json("_source", "___source"))
    rest = [F.coalesce(f"__{c}", c).alias(c) for c in names if c not in keys and c != "_source"]
    return both.select(*keys, *rest, merged.alias("_source")).select(*names)


def delete(existing: DataFrame, keys_df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return existing.join(keys_df.select(*keys), keys, "left_anti")


def delete_where(existing: DataFrame, condition: Column) -> DataFrame:
    """Without the documents that meet a query; where it is null, they stay."""
    return existing.where(~F.coalesce(condition, F.lit(False)))


def split_duplicates(existing: DataFrame, batch: DataFrame, order: Column, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the first of each key, if it isn't there yet; everything else."""
    w = Window.partitionBy(*keys).orderBy(order)
    there = existing.select(*keys).distinct().withColumn("__there", F.lit(True))
    b = batch.withColumn("__n", F.row_number().over(w)).join(there, keys, "left")
    good = F.col("__there").isNull() & (F.col("__n") == 1)
    return b.where(good).select(*batch.columns), b.where(~good).select(*batch.columns)


def regenerate_duplicates(existing: DataFrame, batch: DataFrame, order: Column, keys: list[str] = KEYS) -> DataFrame:
    """The batch with ``dup_<n>_<id>`` for every id that is taken, n counting from 1 (or from 0 for one in the table)."""
    w = Window.partitionBy(*keys).orderBy(order)
    there = existing.select(*keys).distinct().withColumn("__there", F.lit(1))
    b = batch.withColumn("__n", F.row_number().over(w)).join(there, keys, "left")
    n = F.col("__n") - 1 + F.coalesce("__there", F.lit(0))
    return b.withColumn("_id", F.when(n > 0, F.concat(F.lit("dup_"), n.cast("string"), F.lit("_"), F.col("_id"))).otherwise(F.col("_id"))).select(*batch.columns)
