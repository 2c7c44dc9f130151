"""Small document tables."""

import json

from lodestrata.functions.json import with_buckets
from lodestrata.search.engine import Engine
from pyspark.sql import functions as F

PHRASES = [
    {"message": m}
    for m in (
        "The quick brown fox jumps over the lazy dog",
        "The quick brown fox",
        "The fox jumps over the lazy dog",
        "The lazy fox jumps over the dog",
        "The dog jumps",
        "The fox jumps",
        "The quiet dog",
        "The underdog",
        "The two tailed fox",
        "The fast hedgehog",
    )
] + [{"status": s} for s in ("ok", "failing", "fueling")]


def rows(spark, sources, kind="t", times=None):
    made = [(kind, str(i), (times[i] if times else i), x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(sources)]
    return with_buckets(spark.createDataFrame(made, "_type string, _id string, _timestamp long, _source string"))


def engine_of(spark, index="docs", sources=PHRASES, variant=False, **options):
    e = Engine(spark, **options)
    df = rows(spark, sources)
    e.catalog.register(index, df)
    if variant:
        e.catalog.frames[index] = e.catalog.frames[index].withColumn("_source", F.parse_json("_source"))
    return e
