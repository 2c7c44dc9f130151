"""Tables that cut lineage, kept in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is
unset and the master is this machine alone (tests) does a temporary folder stand in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.place import shared_dir


class Scratch:
    """Writes intermediate tables; ``drop`` removes the ones no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame) -> DataFrame:
        """df, written as Parquet and read again."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Partitions for a shuffle whose number must be given."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free(df: DataFrame, name: str) -> str:
    """A column name that df hasn't."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
