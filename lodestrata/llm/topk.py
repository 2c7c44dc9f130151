"""Exact top-k search by distributed histogram selection.

Queries are the rows whose vec_id is divisible by 100 (or meets another
condition given); all rows are searched.  Both lie in blocks, and each pair of a
block of queries and a block of rows is scored in one matrix product.
Scores are cosines on a grid of 1e-9.  A round counts, for every query, its
scores by bins of the range still open; the counts of all splits are added up
and the bin that holds the k-th greatest is opened next, until few scores or
one grid value are left.  A last pass returns what reaches the range found, and
ties go to the least vec_id.  A split sends only its bins down to its own k-th
score: the k-th of all can't lie below.

Defined cases
* null vector, null or NaN or infinite in it, empty vector, null vec_id: neither query nor result.
* zero vector: its cosine with anything is 0.
* vectors of different lengths are never compared.
* fewer than k others: as many as there are.  A query isn't its own result.
* rows that repeat a vec_id: the one of least vector counts.  Equal scores: by vec_id.
* vec_id must be a whole number or its text; any other raises Spark's error of the cast.
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch, width

K = 10
QUERIES = "vec_id % 100 = 0"
BLOCK = 2048
SIDES = 4
GRID = 10**9
SHIFTS = (20, 10, 0)
TOP = 1 << 31


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim): one row for each vec_id that has a vector to compare."""
    good = F.expr("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))


def block_table(v: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """(dim, blk, ids, vecs): the vectors, in blocks by hash, in order of vec_id."""
    n = v.groupBy("dim").count().withColumn("blocks", F.ceil(F.col("count") / block)).drop("count")
    v = v.join(n, "dim").withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    rows = v.groupBy("dim", "blk").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("r"))
    return scratch.table(rows.select("dim", "blk", F.col("r.vec_id").alias("ids"), F.flatten("r.embedding").alias("vecs")))


def matrix(values: pa.Array, n: int) -> np.ndarray:
    x = np.asarray(values.values if hasattr(values, "values") else values, np.float64).reshape(n, -1)
    big = np.abs(x).max(1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines on the grid, from 0 (opposite) to 2 * GRID (alike)."""
    s = q @ x.T
    s *= GRID
    np.rint(s, out=s)
    return np.clip(s + GRID, 0, 2 * GRID).astype(np.int64)


def pairs_of(batches, names):
    """Rows of a joined partition, the query block made once for all that follow each other."""
    last = None
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i] for c in names}
            key = (row["dim"].as_py(), row["blk"].as_py())
            if key != last:
                last, ids = key, np.asarray(row["ids"].values)
                q = matrix(row["vecs"].values, len(ids))
                extra = {c: np.asarray(row[c].values) for c in names if c in ("lo", "hi")}
            xid = np.asarray(row["xids"].values)
            x = matrix(row["xvecs"].values, len(xid))
            yield key, ids, q, extra, xid, x


def counter(k: int, shift: int):
    names = ["dim", "blk", "ids", "vecs", "lo", "hi", "xids", "xvecs"]

    def flush(ids, hist):
        """(query, bin, count) from the top down to the k-th score of this split."""
        above = hist[:, ::-1].cumsum(1)[:, ::-1] - hist
        r, c = np.nonzero((hist > 0) & (above < k))
        return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(c), pa.array(hist[r, c])], ["vec_id", "bin", "n"])

    def count(batches):
        key = hist = held = None
        for now, ids, q, extra, xid, x in pairs_of(batches, names):
            lo, hi = extra["lo"], extra["hi"]
            bins = int(((hi - lo) >> shift).max())
            if now != key:
                if hist is not None:
                    yield flush(held, hist)
                key, held, hist = now, ids, np.zeros((len(ids), bins), np.int64)
            if not bins:
                continue
            open_ = np.flatnonzero(hi > lo)
            for c in range(0, len(open_), 512):
                rows = open_[c : c + 512]
                u = scores(q[rows], x)
                ok = (u >= lo[rows, None]) & (u < hi[rows, None]) & (xid[None] != ids[rows, None])
                at = ((u - lo[rows, None]) >> shift) + np.arange(len(rows))[:, None] * bins
                hist[rows] += np.bincount(at[ok], minlength=len(rows) * bins).reshape(-1, bins)
        if hist is not None:
            yield flush(held, hist)

    return count


def chooser(k: int):
    names = ["dim", "blk", "ids", "vecs", "lo", "xids", "xvecs"]

    def choose(batches):
        for _, ids, q, extra, xid, x in pairs_of(batches, names):
            for c in range(0, len(ids), 512):
                lo = extra["lo"][c : c + 512] - 1  # products of other shapes may round to the next grid value
                u = scores(q[c : c + 512], x)
                ok = (u >= lo[:, None]) & (xid[None] != ids[c : c + 512, None])
                r, j = np.nonzero(ok)
                v = u[r, j]
                order = np.lexsort((xid[j], -v, r))  # a block holds k results of a query at most
                r, j, v = r[order], j[order], v[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                r, j, v = r[rank < k], j[rank < k], v[rank < k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[c + r]), pa.array(xid[j]), pa.array(v)], ["vec_id", "neighbor_id", "u"])

    return choose


def joined(blocks: DataFrame, queries: DataFrame, splits: int) -> DataFrame:
    """Every query block with every block of its dimension, a query's side by side within a split.

    Cells of SIDES groups of query blocks by ``splits`` groups of blocks are
    more than the partitions they hash to, which evens out the partitions.
    """
    sides, n = F.lit(SIDES), splits * SIDES // 2
    x = blocks.select("dim", F.col("ids").alias("xids"), F.col("vecs").alias("xvecs"), F.pmod("blk", F.lit(splits)).alias("split"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIDES - 1).cast("long"))).alias("side"))
    q = queries.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long")))).withColumn("side", F.pmod("blk", sides))
    cell = ["dim", "split", "side"]
    return q.repartition(n, *cell).join(x.repartition(n, *cell).hint("shuffle_hash"), cell).drop("split", "side")


def search(vectors: DataFrame, k: int = K, block: int = BLOCK, queries: str = QUERIES) -> DataFrame:
    """vec_id, neighbor_id, rank (from 1) and score (cosine): the k nearest of all rows to each row that is a query.

    ``queries`` is a condition over vec_id that tells the queries; all rows are searched.
    """
    if k < 1:
        raise ValueError("k must be 1 at least")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    good = scratch.table(usable(vectors))
    blocks, asked = block_table(good, scratch, block), block_table(good.where(queries), scratch, block)
    splits = max(1, min(width(spark), blocks.count()))
    state = asked.select("dim", "blk", F.explode("ids").alias("vec_id"), F.lit(0).cast("long").alias("lo"), F.lit(TOP).cast("long").alias("hi"), F.lit(0).cast("long").alias("above"))
    for shift in SHIFTS:
        sides = state.groupBy("dim", "blk").agg(F.array_sort(F.collect_list(F.struct("vec_id", "lo", "hi"))).alias("r"))
        sides = sides.select("dim", "blk", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
        q = asked.join(sides, ["dim", "blk"]).select("dim", "blk", "ids", "vecs", "lo", "hi").where("exists(sequence(1, size(lo)), i -> lo[i - 1] < hi[i - 1])")
        h = joined(blocks, q, splits).mapInArrow(counter(k, shift), "vec_id long, bin long, n long").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("vec_id").orderBy(F.desc("bin"))
        h = h.withColumn("upto", F.sum("n").over(down)).join(state.select("vec_id", "above"), "vec_id")
        h = h.where(F.col("above") + F.col("upto") - F.col("n") < k)
        # The bin of the k-th score, or the last one there is, and what lies above it.
        at = h.groupBy("vec_id").agg(F.min("bin").alias("bin"), F.max("upto").alias("upto"), F.min_by("n", "bin").alias("n"))
        s = state.join(at, "vec_id", "left")
        lo = F.when(F.col("bin").isNull(), F.col("lo")).otherwise(F.col("lo") + F.shiftleft("bin", shift))
        total = F.col("above") + F.col("upto")
        done = F.col("bin").isNull() | (total <= 4 * k) | F.lit(shift == 0)
        new = scratch.table(s.select("dim", "blk", "vec_id", lo.alias("lo"), F.when(done, lo).otherwise(lo + (1 << shift)).alias("hi"), F.when(F.col("bin").isNull(), F.col("above")).otherwise(total - F.col("n")).alias("above")))
        if shift != SHIFTS[0]:
            scratch.drop(state)
        state = new
        if state.where("hi > lo").isEmpty():
            break
    sides = state.groupBy("dim", "blk").agg(F.array_sort(F.collect_list(F.struct("vec_id", "lo"))).alias("r"))
    q = asked.join(sides.select("dim", "blk", F.col("r.lo").alias("lo")), ["dim", "blk"]).select("dim", "blk", "ids", "vecs", "lo")
    found = joined(blocks, q, splits).mapInArrow(chooser(k), "vec_id long, neighbor_id long, u long")
    best = Window.partitionBy("vec_id").orderBy(F.desc("u"), "neighbor_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("vec_id", "neighbor_id", "rank", F.round((F.col("u") - GRID) / F.lit(float(GRID)), 6).alias("score"))


#: The same for DuckDB.
SQL = f"""
with v as (select vec_id, min(embedding::double[]) e from embeddings
           where vec_id is not null and len(embedding) > 0 group by vec_id),
n as (select vec_id, e, list_dot_product(e, e) q from v),
s as (select a.vec_id, b.vec_id neighbor_id,
             case when a.q = 0 or b.q = 0 then 0 else round(list_dot_product(a.e, b.e) / sqrt(a.q) / sqrt(b.q), 9) end c
      from (select * from n where {QUERIES}) a join n b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)),
r as (select *, row_number() over (partition by vec_id order by c desc, neighbor_id) rank from s)
select vec_id, neighbor_id, rank::int rank, round(c, 6) score from r where rank <= {K}
"""
