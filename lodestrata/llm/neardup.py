"""MinHash near-duplicates by an LSH forest, decided on the shingles.

Every document has a place in each of ``TREES`` signature orders, the trees.
Documents with the longest common prefixes there lie side by side: a region is
what shares a prefix of ``ROWS`` hashes at least, and all pairs of a region are
candidates.  Depth adapts to the region.  One of more than ``tile`` documents goes on
under its next hashes, in one order for each of the ``DEEPER`` hashes left, so
that a pair stays together if any of them agrees, as long as this parts it; one
that can't be parted is compared as a whole, in tiles, so no region is one task.
Nothing caps a document's candidates.  A pair of Jaccard index 0.5 meets with
probability 0.99 at two hashes, 0.99 at three and 0.98 at four; one of 0.7, always.

Compared are sketches of one byte a minhash.  Pairs far above the threshold
are taken and those far below it dropped; the others, unless the taken ones
connect them already, are decided by the exact Jaccard index of their shingles.
A pair that meets in several regions counts in the first.

Defined cases
* null doc_id or null text: the row is never compared; the stage keeps it.
* texts without a word: duplicates only where the texts are equal.
* rows that repeat a doc_id are one document: one group, one row kept.
* equal texts are always duplicates.  Of a group the least doc_id stays.
* very long texts: read whole.
* doc_id must be a whole number or its text; with any other id rows raise Spark's error of the cast.
* an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ._scratch import Scratch, columns, free, width
from ._text import U, Words, binary, blocks
from .components import components

PERMS, TREES, ROWS, DEEPER = 128, 16, 2, 6
SHINGLE, THRESHOLD, TILE = 3, 0.5, 1024
#: Standard errors of the sketch below and above the threshold between which the shingles decide.
BELOW, ABOVE = 3.0, 4.5


def constants(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, dtype=np.int64).astype(U) * U(2) + U(1), r.integers(0, 1 << 63, n, dtype=np.int64).astype(U)


def minhash(arr: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """PERMS minhashes (32 bits) of each text's word shingles; which texts have no word.

    A text with fewer words than a shingle has one shingle of all its words.
    """
    a, b = constants(PERMS)
    out, none = np.zeros((len(arr), PERMS), np.uint32), np.ones(len(arr), bool)
    for i, j, d, o in blocks(arr):
        w = Words(d, o)
        g, whole = w.grams(shingle)
        has = w.count > 0
        whole[w.of[:-1][has]] = True
        first = np.zeros(len(whole) + 1, np.int64)
        np.cumsum(whole, out=first[1:])
        g, at = g[whole], first[w.of[:-1][has]]
        if not len(g):
            continue
        least = np.empty((len(at), PERMS), np.uint32)
        for p in range(PERMS):
            v = g * a[p]
            v += b[p]
            v >>= U(32)
            least[:, p] = np.minimum.reduceat(v.astype(np.uint32), at)
        out[i:j][has] = least
        none[i:j] = ~has
    return out, none


def signer(shingle: int):
    @arrow_udf("binary")
    def sign(text: pa.Array) -> pa.Array:
        m, none = minhash(text, shingle)
        keys = m[:, : TREES * ROWS].astype(">u4").view(np.uint8).reshape(len(m), -1)
        return binary(np.hstack([keys, (m & 255).astype(np.uint8)]), none)

    return sign


def bars(threshold: float) -> tuple[int, int, int]:
    """Equal minhashes (of one byte) from which a pair may pass, from which it rather does, and from which it does."""
    share = threshold * 255 / 256 + 1 / 256
    error = (share * (1 - share) / PERMS) ** 0.5
    return tuple(int(np.ceil((share + x * error) * PERMS)) for x in (-BELOW, 0, ABOVE))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node connected with each of n nodes by the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def first_meeting(p: np.ndarray, q: np.ndarray, region: np.ndarray, keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether the rows p[i] and q[i] have no lesser region in common than the one they are in.

    Row i's regions are keys[of[i]:of[i + 1]], in order.
    """
    ok = np.ones(len(p), bool)
    nx, ny = of[p + 1] - of[p], of[q + 1] - of[q]
    i = j = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):  # both lists merged, all pairs side by side
        live = live[(i[live] < nx[live]) & (j[live] < ny[live])]
        x, y = keys[of[p[live]] + i[live]], keys[of[q[live]] + j[live]]
        same = x == y
        ok[live[same]] = x[same] == region[p[live[same]]]
        i, j = i.copy(), j.copy()
        i[live] += x < y
        j[live] += y < x
        live = live[~same]
    return ok


SURE, MAYBE, LIKELY, LINKS = range(4)


def compared(region, tile, ids, part, sketch, keys, of, threshold: float) -> pa.RecordBatch:
    """What the rows of some regions have in common, all pairs of each region compared.

    Rows (a, b, kind): SURE pairs, of each connected set a star alone; pairs near the
    threshold between such sets, MAYBE or (at the threshold by the sketch) LIKELY;
    and LINKS, b being how many pairs of a the other rows leave out: those inside a set.
    ``part`` is a row's group where a tile holds two groups, of which pairs inside
    one are another tile's, and -1 elsewhere.
    """
    low, mid, high = bars(threshold)
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = (region[1:] != region[:-1]) | (tile[1:] != tile[:-1])
    of_region = np.cumsum(new) - 1
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    at = np.arange(n - 1)
    delta = 1
    while len(at):
        at = at[of_region[at] == of_region[at + delta]]
        pair = at[(part[at] != part[at + delta]) | (part[at] < 0)]
        for c in range(0, len(pair), 16384):
            p = pair[c : c + 16384]
            m = np.count_nonzero(sketch[p] == sketch[p + delta], axis=1)
            p, m = p[m >= low], m[m >= low]
            ok = first_meeting(p, p + delta, region, keys, of)
            got.append((p[ok], p[ok] + delta, m[ok]))
        delta += 1
        at = at[at + delta < n]
    p, q, m = (np.concatenate(x) for x in zip(*got, strict=True))
    sure = m >= high
    root = roots(p[sure], q[sure], n)
    within = root[p] == root[q]
    links = np.bincount(np.concatenate([p[within & (m >= mid)], q[within & (m >= mid)]]), minlength=n)
    linked, leaf = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
    a = np.concatenate([ids[root[leaf]], ids[p[~within]], ids[linked]])
    b = np.concatenate([ids[leaf], ids[q[~within]], links[linked]])
    kind = np.concatenate([np.full(len(leaf), SURE), np.where(m[~within] >= mid, LIKELY, MAYBE), np.full(len(linked), LINKS)])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind.astype(np.int32))], ["a", "b", "kind"])


def walker(threshold: float):
    """A pass over partitions sorted by region and tile, keeping back the one that the next batch may continue."""

    def arrays(b):
        w = PERMS
        sketch = b.column("sketch")
        of = np.asarray(b.column("keys").offsets).astype(np.int64)
        keys = np.asarray(b.column("keys").values)[of[0] : of[-1]]
        s = np.frombuffer(sketch.buffers()[2], np.uint8)[sketch.offset * w :][: b.num_rows * w].reshape(-1, w)
        return [*(np.asarray(b.column(c)) for c in ("region", "tile", "rep", "part")), s, keys, of - of[0]]

    def walk(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            region, tile = np.asarray(t.column("region")), np.asarray(t.column("tile"))
            differs = np.flatnonzero((region != region[-1]) | (tile != tile[-1]))
            keep = int(differs[-1]) + 1 if len(differs) else 0
            if keep:
                yield compared(*arrays(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in t.slice(0, keep).columns], t.schema.names)), threshold)
            held = t.slice(keep)
        if held is not None:
            yield compared(*arrays(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in held.columns], held.schema.names)), threshold)

    return walk


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, two hashes of the text, sign (null without words) for rows that can be compared."""
    d = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), signer(shingle)(F.lower("text")).alias("sign"))


def counted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (region, rep, ...) of regions that hold several, with their number n."""
    n = rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    return scratch.table(rows.join(n.hint("merge"), "region"))


def tree(region):
    return region.bitwiseAND(TREES - 1)


def regions(reps: DataFrame, scratch: Scratch, tile: int) -> DataFrame:
    """(region, rep, n): the regions of every tree whose members are to be compared, n each, two at least.

    A region is a common prefix of at least ROWS hashes in its tree's order.  One
    of more than ``tile`` members is cut deeper as long as that parts them: each of
    its next hashes gives an order of its own, in which members go on under that
    hash.  Where one value of a hash holds at least half of the region, or no hash is
    left, it is as small as it gets.
    """
    w = 4 * ROWS
    signed = reps.where("sign is not null")
    key = F.explode(F.array(*[F.shiftleft(F.xxhash64(F.lit(t), F.substring("sign", 1 + w * t, w)), 4).bitwiseOR(F.lit(t).cast("long")) for t in range(TREES)]))
    rows = counted(signed.select(key.alias("region"), "rep"), scratch)
    out, large = rows.where(F.col("n") <= tile), rows.where(F.col("n") > tile)
    large = large.join(signed, "rep").select("region", "rep", "n", F.expr(f"substring(sign, {1 + TREES * w + TREES * ROWS} + {DEEPER} * cast(region & {TREES - 1} as int), {DEEPER})").alias("rest"), F.lit(-1).alias("last"))
    while not large.isEmpty():
        large = scratch.table(large)
        deeper = large.where(F.col("last") < DEEPER - 1).select(F.col("region").alias("above"), F.col("n").alias("of"), "rep", "rest", F.explode(F.expr(f"sequence(last + 1, {DEEPER - 1})")).alias("last"))
        child = F.shiftleft(F.xxhash64("above", "last", F.expr("substring(rest, last + 1, 1)")), 4).bitwiseOR(tree(F.col("above")))
        deeper = scratch.table(deeper.withColumn("region", child))
        size = deeper.groupBy("above", "of", "region").agg(F.count("*").alias("n"))
        alike = size.groupBy("above").agg((F.max("n") * 2 >= F.first("of")).alias("alike"))
        whole = large.join(alike.withColumnRenamed("above", "region").hint("merge"), "region", "left").where("coalesce(alike, true)")
        out = out.union(whole.select("region", "rep", "n"))
        rows = counted(deeper.join(alike.where("not alike").hint("merge"), "above").select("region", "rep", "rest", "last"), scratch)
        out = out.union(rows.where(F.col("n") <= tile).select("region", "rep", "n"))
        large = rows.where(F.col("n") > tile).select("region", "rep", "n", "rest", "last")
    return out


def pairs(reps: DataFrame, scratch: Scratch, threshold: float, tile: int = TILE) -> DataFrame:
    """(a, b, kind) of ``compared`` over (rep, sign): all that share a region and may pass the threshold.

    Only rows with company take their sketch along.  A row of a region of more than
    ``tile`` goes to the tiles of its group with every other group of the region.
    """
    mine = regions(reps, scratch, tile).groupBy("rep").agg(F.sort_array(F.collect_list("region")).alias("keys"), F.collect_list(F.struct("region", F.ceil(F.col("n") / tile).cast("int").alias("g"))).alias("in"))
    rows = mine.join(reps.select("rep", F.substring("sign", 1 + 4 * TREES * ROWS, PERMS).alias("sketch")).hint("merge"), "rep")
    rows = rows.select("rep", "sketch", "keys", F.explode("in").alias("r")).select("rep", "sketch", "keys", "r.region", "r.g")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, g - 1)")))
    t = F.shiftleft(F.least("mine", "other").cast("long"), 32).bitwiseOR(F.greatest("mine", "other").cast("long"))
    part = F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine"))
    rows = rows.select("region", t.alias("tile"), "rep", part.cast("int").alias("part"), "sketch", "keys")
    ordered = rows.repartition(width(reps.sparkSession), "region", "tile").sortWithinPartitions("region", "tile")
    return ordered.mapInArrow(walker(threshold), "a long, b long, kind int")


def shingler(shingle: int):
    @arrow_udf("binary")
    def shingles(text: pa.Array) -> pa.Array:
        """The different shingle hashes of each text, sorted."""
        out = []
        for i, j, d, o in blocks(text):
            w = Words(d, o)
            g, whole = w.grams(shingle)
            whole[w.of[:-1][w.count > 0]] = True
            for k in range(j - i):
                mine = slice(w.of[k], w.of[k + 1])
                out.append(np.unique(g[mine][whole[mine]]).tobytes())
        return pa.array(out, pa.binary())

    return shingles


@arrow_udf(T.DoubleType())
def jaccard(x: pa.Array, y: pa.Array) -> pa.Array:
    """Exact Jaccard index of two sets of sorted hashes."""
    out = []
    for a, b in zip(x, y, strict=True):
        p, q = (np.frombuffer(v.as_buffer(), U) for v in (a, b))
        both = len(np.intersect1d(p, q, assume_unique=True))
        out.append(both / max(len(p) + len(q) - both, 1))
    return pa.array(out, pa.float64())


def verified(docs: DataFrame, maybe: DataFrame, scratch: Scratch, threshold: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose shingles have the threshold's Jaccard index at least."""
    ids = maybe.select(F.col("a").alias("id")).union(maybe.select("b")).distinct()
    d = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), "text")  # merged at any size, so that disk grows with the input alone
    sets = scratch.table(d.join(ids.hint("merge"), "id", "left_semi").select("id", shingler(shingle)(F.lower("text")).alias("s")).distinct())
    both = maybe.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return both.where(jaccard("x", "y") >= threshold).select("a", "b")


def classes(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2) of every row that can be compared; (h1, h2, rep, n, sign) of every different text."""
    signed = scratch.table(signatures(docs, shingle))
    texts = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("sign").alias("sign"))
    return signed.select("doc_id", "h1", "h2"), scratch.table(texts)


def linked(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, shingle: int = SHINGLE, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, links): ``classes``' rows; texts with copies or links, as (h1, h2, rep, n, root); (rep, links)."""
    rows, texts = classes(docs, scratch, shingle)
    reps = texts.groupBy("rep").agg(F.first("sign").alias("sign"))  # a doc_id may stand for several texts
    found = scratch.table(pairs(reps, scratch, threshold, tile))
    # Texts of one doc_id belong together.
    many = rows.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id")
    own = rows.join(many, "doc_id", "left_semi").join(texts.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", F.col("rep").alias("b"))
    own = own.join(own.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("a", "b")
    out = components(found.where(F.col("kind") == SURE).select("a", "b").union(own), scratch)
    ra, rb = (out.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    near = found.where(F.col("kind").isin(MAYBE, LIKELY)).join(ra, "a", "left").join(rb, "b", "left")
    near = scratch.table(near.select("a", "b", "kind", F.expr("coalesce(ra, a) = coalesce(rb, b)").alias("together")))
    passed = near.where("together").where(F.col("kind") == LIKELY).select("a", "b")
    apart = near.where("not together").select("a", "b")
    if not apart.isEmpty():
        more = scratch.table(verified(docs, apart, scratch, threshold, shingle))
        passed = passed.union(more)
        out = components(out.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more), scratch)
    ends = passed.select(F.col("a").alias("rep"), F.lit(1).cast("long").alias("n")).union(passed.select("b", F.lit(1).cast("long")))
    links = ends.union(found.where(F.col("kind") == LINKS).select("a", "b")).groupBy("rep").agg(F.sum("n").alias("links"))
    root = out.select(F.col("node").alias("rep"), "root").union(out.select(F.col("root").alias("rep"), "root").distinct())
    texts = texts.select("h1", "h2", "rep", "n").join(root.hint("merge"), "rep", "left").where("n > 1 or root is not null")
    return rows, scratch.table(texts.withColumn("root", F.coalesce("root", "rep"))), links


def groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keeper) for each document of a group but its keeper, the least doc_id."""
    scratch = Scratch(docs.sparkSession)
    rows, texts, _ = linked(docs, scratch, **options)
    out = rows.join(texts.hint("merge"), ["h1", "h2"]).where("doc_id <> root")
    return out.select("doc_id", F.col("root").alias("keeper")).distinct()


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """A row for each document that is not alone.

    doc_id; duplicate_of, the document of its group that stays; text_id, the least
    doc_id of exactly its text; links, with how many other texts it is linked;
    group_size, the documents of its group.
    """
    scratch = Scratch(docs.sparkSession)
    rows, texts, links = linked(docs, scratch, **options)
    each = rows.join(texts.select("h1", "h2", "rep", "root").hint("merge"), ["h1", "h2"])
    each = scratch.table(each.groupBy("doc_id", "root").agg(F.min("rep").alias("rep")))
    size = each.groupBy("root").agg(F.count("*").alias("group_size")).where("group_size > 1")
    out = each.join(size, "root").join(links.hint("merge"), "rep", "left")
    return out.select("doc_id", F.col("root").alias("duplicate_of"), F.col("rep").alias("text_id"), F.coalesce("links", F.lit(0)).alias("links"), "group_size")


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs without near duplicates: of each group one row stays, with all its columns.

    Texts are shuffled once, by doc_id, and never sorted.  Only rows that repeat
    a doc_id, if there are any, go another way, where the least text hash stays.
    """
    scratch = Scratch(docs.sparkSession)
    known = docs.where("doc_id is not null and text is not null")
    rest = docs.where("doc_id is null or text is null").select(*columns(docs))
    twice = scratch.table(known.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    g = scratch.table(groups(docs, **options).select("doc_id"))
    lone = known.join(g.union(twice).hint("shuffle_hash"), "doc_id", "left_anti").select(*columns(docs)).union(rest)
    if twice.isEmpty():
        return lone
    h, n = free(docs, "__lode_h"), free(docs, "__lode_n")
    w = Window.partitionBy("doc_id").orderBy(h)
    more = known.join(twice, "doc_id", "left_semi").join(g, "doc_id", "left_anti")
    more = more.withColumn(h, F.xxhash64("text")).withColumn(n, F.row_number().over(w)).where(F.col(n) == 1)
    return lone.union(more.select(*columns(docs)))
