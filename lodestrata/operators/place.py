"""The place of every row in a sorted table, without bringing them to one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset and the master is this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestrata-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def placed(df: DataFrame, name: str = "place") -> DataFrame:
    """A sorted table with each row's place, from 1.

    The table is written once, a row with its partition and its number there; what
    goes before a partition is the sum of the sizes of those before it, and there is one
    number a partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/place-{uuid.uuid4().hex}"
    df.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    before = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(sizes, "__part").withColumn(name, number).drop("__at", "__part", "__before")
