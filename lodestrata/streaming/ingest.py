"""Structured Streaming: files of documents to stored indices, and running bucket counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.bulk import documents
from ..sources.store import Store

INPUT = "_index string, _type string, _id string, _source string"


def read_documents(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of (_index, _type, _id, _source) from JSON lines; max_files a trigger is the back-pressure."""
    return spark.readStream.schema(INPUT).option("maxFilesPerTrigger", max_files).json(path)


def ingest(stream: DataFrame, store: Store, checkpoint: str, timestamp_path: str | None = None, flatten: bool = False, each: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Appends every micro-batch to the store; ``each`` sees its document rows too.

    A batch that is run again after a failure appends its documents again, under
    the same ids: readers see one of each.  Documents that come without an id get
    a new one then, so give ids where each must count once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = documents(batch, timestamp_path, flatten)
        rows.persist()
        try:
            store.append(rows)
            if each:
                each(rows, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def bucket_counts(stream: DataFrame, timestamp: str, size: str = "1 minute", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts by tumbling window and keys, final once the watermark has passed."""
    t = stream.withWatermark(timestamp, late).groupBy(F.window(timestamp, size), *keys).count()
    return t.select(F.col("window.start").alias("bucket"), *keys, "count")
