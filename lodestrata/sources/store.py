"""Stored indices: an append-only log of document versions, partitioned by index.

Readers see the newest version of each (_type, _id) that isn't a deletion.
Compaction rewrites an index to its visible rows, the base (_seq = 0); what is
written later is the tail.  Filters of a reader reach the scan of the base, which
needs no window: it lacks only the keys of the tail.  Files hold a few days each
(a busy day is split among tasks) and are sorted by time, so footers prune ranges of it.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import merge_all, merge_json
from ..operators.writes import latest
from ..plans.errors import UpdateNotAllowed
from .catalog import COLUMNS, DOCUMENT

KEYS = ["_index", "_type", "_id"]


def visible(log: DataFrame) -> DataFrame:
    """The rows of a log that readers see."""
    base, tail = log.where("_seq = 0").select(*COLUMNS), log.where("_seq > 0")
    seen = latest(tail, F.desc("_seq"), F.desc("_timestamp"))
    return base.join(tail.select(*KEYS), KEYS, "left_anti").select(*COLUMNS).unionByName(seen.where(~F.col("_deleted")).select(*COLUMNS))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self) -> list[str]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return sorted(unescape(s.getPath().getName()[7:]) for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("_index="))

    def _log(self, names: list[str] | None = None) -> DataFrame:
        df = self.spark.read.schema(DOCUMENT + ", _seq bigint, _deleted boolean").parquet(self.root)
        return df if names is None else df.where(F.col("_index").isin(names))

    def read(self, names: list[str]) -> DataFrame:
        return visible(self._log(names))

    def append(self, df: DataFrame, deleted: bool = False, seq: int | None = None) -> None:
        """Document rows, newer than all there are; of equal keys among them, that of the latest time."""
        seq = time.time_ns() if seq is None else seq
        made = df.select(*COLUMNS).withColumns({"_seq": F.lit(seq), "_deleted": F.lit(deleted)})
        made.hint("rebalance", "_index", "_bucket1d").sortWithinPartitions("_index", "_timestamp").write.mode("append").partitionBy("_index").parquet(self.root)

    def create(self, df: DataFrame) -> None:
        names = [r[0] for r in df.select("_index").distinct().collect()]
        self.append(df.join(self.read(names).select(*KEYS), KEYS, "left_anti") if set(names) & set(self.names()) else df)

    def update(self, df: DataFrame, unwrap: bool = True, id_enabled: bool = True) -> None:
        """Shallow merges, those of one key in the order of their times; see ``writes.update``."""
        if not id_enabled:
            raise UpdateNotAllowed("documents of this index have no lasting id")
        if unwrap:
            df = df.withColumn("_source", F.coalesce(F.get_json_object("_source", "$.doc"), "_source"))
        rest = [c for c in COLUMNS if c not in KEYS and c != "_source"]
        df = df.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("_timestamp", "_source"))).alias("__new"), F.max_by(F.struct(*rest), "_timestamp").alias("__rest"))
        df = df.select(*KEYS, F.col("__new._source").alias("__new"), "__rest.*")
        df = df.withColumn("_source", F.when(F.size("__new") == 1, F.col("__new")[0]).otherwise(merge_all("__new"))).drop("__new")
        names = [r[0] for r in df.select("_index").distinct().collect()]
        if set(names) & set(self.names()):
            old = self.read(names).select(*KEYS, F.col("_source").alias("__old"))
            df = df.join(old, KEYS, "left").withColumn("_source", F.when(F.col("__old").isNull(), F.col("_source")).otherwise(merge_json("__old", "_source")))
        self.append(df)

    def delete(self, keys: DataFrame) -> int:
        """Deletes documents by key; how many there were."""
        names = [r[0] for r in keys.select("_index").distinct().collect() if r[0] in self.names()]
        if not names:
            return 0
        gone = self.read(names).join(keys.select(*KEYS), KEYS, "left_semi")
        n = gone.count()
        if n:
            self.append(gone, deleted=True)
        return n

    def drop(self, index: str) -> None:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        fs, p = self._fs(f"{self.root}/_index={escape(index)}")
        fs.delete(p, True)

    def compact(self, index: str) -> None:
        """Rewrites an index to its visible rows, aside, then in its place.

        The former folder stays until the new one is there, and goes back where that
        fails; files that others have written meanwhile are taken over.
        """
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        now = time.time_ns()
        fs, p = self._fs(f"{self.root}/_index={escape(index)}")
        aside, old = (self._fs(f"{self.root}/.{kind}-{now}")[1] for kind in ("compact", "before"))
        files = lambda at: {f.getPath().getName(): f.getPath() for f in fs.listStatus(at) if f.isFile() and f.getPath().getName()[0] not in "._"}
        read = files(p)
        rows = self.spark.read.schema(DOCUMENT + ", _seq bigint, _deleted boolean").option("basePath", self.root).parquet(*[x.toString() for x in read.values()])
        rows = visible(rows.where(F.col("_index") == index)).drop("_index").withColumns({"_seq": F.lit(0).cast("long"), "_deleted": F.lit(False)})
        rows.hint("rebalance", "_bucket1d").sortWithinPartitions("_timestamp").write.parquet(aside.toString())
        if not fs.rename(p, old):
            raise OSError(f"{p.toString()} can't be moved aside")
        if not fs.rename(aside, p):
            fs.rename(old, p)
            raise OSError(f"{aside.toString()} can't be moved into place")
        for name, path in files(old).items():
            if name not in read:
                fs.rename(path, self._fs(f"{p.toString()}/{name}")[1])
        fs.delete(old, True)
