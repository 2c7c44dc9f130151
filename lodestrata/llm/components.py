"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the pairs in the first two columns, except the roots.

    A root is its component's least node.  Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the largest component.
    """
    a, b = edges.columns[:2]
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = scratch.table(e)
    state = _state(e)
    while state[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        new = scratch.table(small)
        scratch.drop(e)
        e, before, state = new, state, _state(new)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
