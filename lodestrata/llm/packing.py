"""Best-fit packing of documents into training sequences, planned over a histogram of lengths.

A document has as many tokens as UTF-8 bytes, and one that ends it.  What fills
whole sequences is cut off first; the pieces left are packed by best fit, the
longest first.  The plan never sees a document: it works on the count of pieces
of each length (at most ``capacity`` numbers, whatever the corpus) and gives
ranges of ranks within a length their slots.  Pieces then look their slot up by
their rank within their length.

The rank is global and needs no single task per length: pieces are numbered
within (length, salt), and a prefix sum over the salts' counts does the rest.

Defined cases
* null or empty text: no tokens, no slot, not in the result.
* longer than a sequence: one row per piece, every token is placed.
* ties in length: by salt, doc_id, then the text's hash, which any run repeats.
* repeated rows: each is packed; equal rows take each other's slots.
* null doc_id: packed, with a null doc_id in the result.
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ._scratch import Scratch

CAPACITY = 8192
SALTS = 64


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best fit, longest first: rows (length, first rank, pieces, first bin, pieces a bin, offset).

    Bins of equal room lie in ranges of consecutive numbers.  A length takes the
    ranges of least sufficient room in turn, fills each bin with as many pieces
    as fit (the bin just used is always the tightest), and opens new bins last.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    levels = np.zeros(capacity + 1, bool)
    rows: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def put(r: int, first: int, n: int) -> None:
        if n and r:
            room.setdefault(r, []).append((first, n))
            levels[r] = True

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero(levels[length:])
            if len(fits):
                r = length + int(fits[0])
                first, n = room[r].pop()
                if not room[r]:
                    levels[r] = False
            else:
                r, each = capacity, capacity // length
                first, n = opened, -(-left // each)
                opened += n
            each = r // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole * each, first, each, capacity - r))
                put(r - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if left and whole < n:  # fewer pieces than the next bin would take
                rows.append((length, rank, left, first + whole, each, capacity - r))
                put(r - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(r, first + whole, n - whole)
    names = ("length", "rank", "pieces", "bin", "each", "offset")
    cols = np.array(sorted(rows), np.int64).reshape(-1, 6).T
    return dict(zip(names, cols, strict=True))


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, h, piece, start, length): the cuts of each document."""
    d = docs.where("length(text) > 0").select(F.col("doc_id"), F.xxhash64("text").alias("h"), (F.octet_length("text").cast("long") + 1).alias("n"))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}")))
    d = d.select("doc_id", "h", "n", cut.alias("piece"))
    return d.select("doc_id", "h", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("length"))


SLOT = T.StructType().add("sequence", T.LongType()).add("position", T.IntegerType())


def slots(planned: dict[str, np.ndarray]):
    key = planned["length"] << 44 | planned["rank"]

    @arrow_udf(SLOT)
    def slot(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, k = np.asarray(length), np.asarray(rank)
        at = np.searchsorted(key, n << 44 | k, "right") - 1
        k = k - planned["rank"][at]
        each = planned["each"][at]
        return pa.StructArray.from_arrays([pa.array(planned["bin"][at] + k // each), pa.array((planned["offset"][at] + k % each * n).astype(np.int32))], ["sequence", "position"])

    return slot


def pack(docs: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """doc_id, piece, start and length in the document, and sequence and position where it goes."""
    if capacity < 1 or capacity >= 1 << 18:
        raise ValueError("capacity must be from 1 to 262143")
    scratch = Scratch(docs.sparkSession)
    cut = pieces(docs, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(salts)).cast("int"))
    cut = scratch.table(cut)
    count = scratch.table(cut.groupBy("length", "salt").count())
    histogram = {r["length"]: r["n"] for r in count.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    planned = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = count.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "h", "piece")
    ranked = cut.withColumn("k", F.row_number().over(within)).join(base.hint("shuffle_merge"), ["length", "salt"])
    ranked = ranked.withColumn("slot", slots(planned)("length", F.col("base") + F.col("k") - 1))
    return ranked.select("doc_id", "piece", "start", "length", "slot.sequence", "slot.position")
