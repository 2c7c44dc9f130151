"""Suffix-array dedup: passages of at least ``words`` words that occur before.

A text is its sequence of words (ASCII case and all between words ignored).

*Distribution.*  Two equal runs of ``words`` words have the same least hash of
their inner ``GRAM``-word runs.  So texts are cut to stretches of starts that
share this minimum, overlapping so that every run lies whole in one, and
stretches meet by their minimum.  Equal stretches are one, known by a hash and
their first occurrence; only different stretches of one minimum, and stretches that
hold it twice and so may repeat themselves, have anything left to compare, and
only those are read again.

*Comparison.*  The stretches of many minima together form one word sequence with
a suffix array and a Burrows-Wheeler transform.  Intervals of suffixes are
extended backwards breadth first: the round that prefixes a word to intervals
of common prefix l closes, at the right end of each new interval, a place whose
common prefix is exactly l.  Places still open after ``words`` rounds
have common prefixes of at least that length, and they join equal runs.

Defined cases
* null doc_id or null text: never compared; ``remove`` keeps the row as it is.
* fewer words than ``words``: nothing is removed.
* first: the least (doc_id, place); rows that repeat a doc_id are one document.
* very long texts: read whole.  Runs that overlap themselves: all but the first are covered.
* doc_id must be a whole number or its text; any other raises Spark's error of the cast.
* an empty table gives an empty result; columns besides doc_id and text are not
  read by ``repeats``; ``remove`` returns all, n_chars made anew where there is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ._scratch import Scratch, columns, free, width
from ._text import U, Words, blocks, mix, powers
from .sentences import lowered

MIN_WORDS, GRAM = 50, 20
BASE = 0xD6E8FEB86659FD93
BATCH = 1 << 19


# -- one word sequence ---------------------------------------------------------


def suffix_array(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``depth`` symbols, place of each suffix), by prefix doubling."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    n, k = len(x), 1
    while True:
        if k >= depth or int(rank.max(initial=0)) == n - 1:
            sa = np.argsort(rank, kind="stable")
            break
        nxt = np.zeros(n, np.int64)
        nxt[:-k or None] = rank[k:] + 1
        if k >= n:
            nxt[:] = 0
        key = rank * (n + 1) + nxt
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        k *= 2
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    return sa, place


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + size[i] - 1 of all i, one after the other."""
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    return np.arange(off[-1]) + np.repeat(first - off[:-1], size)


def open_places(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, for each place whether its suffix has ``least`` symbols in common with the one before).

    Breadth-first backward extension.  ``last[i]`` is where the suffix one
    longer than that at place i stands: an interval's places, sent there, fall
    apart into the intervals of its extensions, one for each symbol before it.
    """
    n = len(x)
    sa, place = suffix_array(x, least)
    last = place[sa - 1]  # of the whole text, the last symbol: a separator, closed in the first round
    symbol = x[sa]
    closed = np.zeros(n + 1, bool)
    closed[0] = closed[n] = True
    lo, size = np.array([0]), np.array([n])
    for _ in range(least):
        if not len(lo):
            break
        at = ranges(lo, size)
        to = last[at]
        owner = np.repeat(np.arange(len(lo)), size)
        if len(at) > n // 8:  # scatter and read back beats sorting
            where = np.full(n, -1, np.int64)
            where[to] = owner
            to = np.flatnonzero(where >= 0)
            owner = where[to]
        else:
            order = np.argsort(to)
            to, owner = to[order], owner[order]
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[to[1:]] != symbol[to[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(to)))
        lo = to[start]
        fresh = ~closed[lo + size]
        closed[(lo + size)[fresh]] = True
        lo, size = lo[fresh], size[fresh]
    return sa, ~closed[:n]


def equal_runs(stretches: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, class) of each run of ``least`` words that occurs more than once."""
    size = np.array([len(s) for s in stretches], np.int64)
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=first[1:])
    n = int(first[-1])
    x = np.empty(n, np.int64)
    words = np.ones(n, bool)
    words[first[1:] - 1] = False
    x[words] = np.unique(np.concatenate(stretches), return_inverse=True)[1]
    x[~words] = -np.arange(1, len(size) + 1)  # every separator differs
    sa, joined = open_places(x, least)
    owner = np.repeat(np.arange(len(size)), size + 1)[sa]
    start = sa - first[owner]
    cls = np.cumsum(~joined) - 1
    many = (np.bincount(cls)[cls] > 1) & (start + least <= size[owner])
    return owner[many], start[many], cls[many]


# -- stretches -------------------------------------------------------------------


def stretches(d: np.ndarray, o: np.ndarray, least: int, gram: int):
    """(document, minimum, first word, 2 * words, hash of the words) of each stretch of a block; its words.

    Where the minimum stands more than once in a stretch, 2 * words + 1.
    """
    w = Words(lowered(d), o)
    n = len(w.hash)
    p = powers(BASE, n + 1)
    back = powers(pow(BASE, -1, 1 << 64), n + 1)
    s = np.zeros(n + 1, U)
    np.cumsum(w.hash * p[:-1], out=s[1:])

    def span(a, b):
        return mix((s[b] - s[a]) * back[a] + (b - a).astype(U))

    if n < least:
        return (np.zeros(0, np.int64),) * 5 + (w,)
    a = np.arange(n - gram + 1)
    g = span(a, a + gram)
    wide = least - gram + 1
    k, m = 1, g
    while 2 * k <= wide:
        m = np.minimum(m[: len(m) - k], m[k:])
        k *= 2
    m = np.minimum(m[: n - least + 1], m[wide - k : wide - k + n - least + 1])
    stop = np.repeat(w.of[1:], w.count)
    a = np.arange(n - least + 1)
    ok = a + least <= stop[: len(a)]
    a, m = a[ok], m[ok]
    doc = np.searchsorted(w.of, a, "right") - 1
    new = np.ones(len(a), bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(a)) - 1
    if not len(i):
        return (np.zeros(0, np.int64),) * 5 + (w,)
    n = a[j] + least - a[i]
    inner = n - gram + 1
    at = ranges(a[i], inner)
    first = np.zeros(len(inner), np.int64)
    np.cumsum(inner[:-1], out=first[1:])
    twice = np.add.reduceat((g[at] == np.repeat(m[i], inner)).astype(np.int64), first) > 1
    return doc[i], m[i].view(np.int64), a[i] - w.of[doc[i]], 2 * n + twice, span(a[i], a[j] + least).view(np.int64), w


ROW = T.ArrayType(T.StructType().add("m", T.LongType()).add("c", T.LongType()).add("place", T.LongType()))


def listing(least: int, gram: int):
    @arrow_udf(ROW)
    def stretches_of(text: pa.Array) -> pa.Array:
        """Each text's stretches, the place being first word * 2^32 + 2 * words (+ 1)."""
        sizes, cols = [], [[], [], []]
        for i, j, d, o in blocks(text):
            doc, m, a, n, c, _ = stretches(d, o, least, gram)
            sizes.append(np.bincount(doc, minlength=j - i))
            for col, v in zip(cols, (m, c, a << 32 | n), strict=True):
                col.append(v)
        off = np.zeros(len(text) + 1, np.int32)
        if sizes:
            np.cumsum(np.concatenate(sizes), out=off[1:])
        return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in cols], ["m", "c", "place"]))

    return stretches_of


def hash_of(h: np.ndarray) -> int:
    """As in ``stretches``: the hash of a run of words."""
    return int(mix(np.array([(h * powers(BASE, len(h))).sum(dtype=U)], U) + U(len(h))).view(np.int64)[0])


@arrow_udf(T.ArrayType(T.BinaryType()))
def words_at(text: pa.Array, places: pa.Array, hashes: pa.Array) -> pa.Array:
    """Of each text, the hashes of the words of the stretches at the places.

    Null where they aren't the stretch meant: another row has this doc_id too.
    """
    out = []
    for i, j, d, o in blocks(text):
        w = Words(lowered(d), o)
        for k in range(i, j):
            h = w.hash[w.of[k - i] : w.of[k - i + 1]]
            cuts = [h[p >> 32 : (p >> 32) + ((p & (1 << 32) - 1) >> 1)] for p in places[k].as_py()]
            out.append([x.tobytes() if hash_of(x) == c else None for x, c in zip(cuts, hashes[k].as_py(), strict=True)])
    return pa.array(out, pa.list_(pa.binary()))


def comparer(least: int):
    """Over rows (m, c, doc_id, place, words) sorted by m: which starts repeat an earlier one."""

    def verdict(rows) -> pa.RecordBatch:
        seq = [np.frombuffer(r[4], np.int64) for r in rows]
        own, start, cls = equal_runs(seq, least)
        rank = np.empty(len(rows), np.int64)
        rank[sorted(range(len(rows)), key=lambda i: (rows[i][2], rows[i][3]))] = np.arange(len(rows))
        order = np.lexsort((start, rank[own], cls))
        own, start, cls = own[order], start[order], cls[order]
        later = np.zeros(len(own), bool)
        later[1:] = cls[1:] == cls[:-1]
        own, start = own[later], start[later]
        order = np.lexsort((start, own))
        own, start = own[order], start[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (start[1:] > start[:-1] + 1)
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(own)) - 1
        first = np.array([r[3] >> 32 for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([rows[k][2] for k in own[i]], pa.int64()), pa.array(first[own[i]] + start[i]), pa.array(first[own[i]] + start[j] + least)], ["doc_id", "a", "b"])

    def compare(batches):
        held, words = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if words > BATCH and row[0] != held[-1][0]:
                    yield verdict(held)
                    held, words = [], 0
                if held and row[:4] == held[-1][:4]:
                    continue  # a row that is there twice
                held.append(row)
                words += len(row[4]) // 8
        if held:
            yield verdict(held)

    return compare


def repeated(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, a, b): runs of words, from word a to before word b, that occur before; they may overlap."""
    if not 1 <= gram <= least:
        raise ValueError("gram must be from 1 to the least number of words")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    rows = d.select("doc_id", F.explode(listing(least, gram)("text")).alias("s")).select("s.m", "s.c", "doc_id", "s.place")
    kinds = rows.repartition(width(spark), "m").groupBy("m", "c").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max(F.struct("doc_id", "place")).alias("last"))
    kinds = kinds.withColumn("kinds", F.count("*").over(Window.partitionBy("m")))
    kinds = scratch.table(kinds.where("kinds > 1 or first <> last or first.place & 1 = 1").select("m", "c", F.col("first.doc_id").alias("fd"), F.col("first.place").alias("fp"), (F.col("first") != F.col("last")).alias("copied"), "kinds"))
    # Equal stretches: every one but the first repeats it.
    copied = kinds.where("copied").select("m", "c", "fd", "fp")
    whole = rows.join(copied.hint("merge"), ["m", "c"]).where("doc_id <> fd or place <> fp")
    size = F.shiftright(F.col("place").bitwiseAND((1 << 32) - 1), 1)
    whole = whole.select("doc_id", F.shiftright("place", 32).alias("a"), (F.shiftright("place", 32) + size).alias("b"))
    # Different stretches of one minimum, and those that hold it twice: compared word by word.
    wanted = kinds.where("kinds > 1 or fp & 1 = 1").groupBy(F.col("fd").alias("id")).agg(F.collect_list(F.struct("fp", "m", "c")).alias("w"))
    read = d.join(wanted.hint("merge"), d["doc_id"] == wanted["id"]).select("doc_id", "w", words_at("text", F.col("w.fp"), F.col("w.c")).alias("h"))
    read = read.select("doc_id", F.explode(F.arrays_zip("w", "h")).alias("x")).select("x.w.m", "x.w.c", "doc_id", F.col("x.w.fp").alias("place"), F.col("x.h").alias("words")).where("words is not null")
    parts = read.repartition(width(spark), "m").sortWithinPartitions("m", "doc_id", "place").mapInArrow(comparer(least), "doc_id long, a long, b long")
    return whole.union(parts)


def merged(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = runs.withColumn("new", F.coalesce(F.col("a") > before, F.lit(True)).cast("int"))
    s = s.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("doc_id", "island").agg(F.min("a").alias("start"), F.max("b").alias("end")).select("doc_id", "start", "end")


def repeats(docs: DataFrame, least: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, start and end (words) of each passage that occurs before, apart from each other."""
    return merged(repeated(docs, least, gram))


@arrow_udf(T.StringType())
def cut(text: pa.Array, runs: pa.Array) -> pa.Array:
    got = []
    for t, r in zip(text, runs, strict=True):
        if not r.is_valid or not t.is_valid:
            got.append(t.as_py())
            continue
        d = np.frombuffer(t.as_py().encode(), np.uint8)
        w = Words(d, np.array([0, len(d)]))
        keep = np.ones(len(d), bool)
        for x in r.as_py():
            if x["end"] <= len(w.start):
                keep[w.start[x["start"]] : w.start[x["end"]] if x["end"] < len(w.start) else len(d)] = False
        got.append(d[keep].tobytes().decode())
    return pa.array(got, pa.string())


def remove(docs: DataFrame, least: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """The rows of docs without the passages that occur before."""
    key, cuts_at = free(docs, "__lode_id"), free(docs, "__lode_cut")
    cuts = repeats(docs, least, gram).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(cuts_at))
    d = docs.join(cuts.hint("merge"), docs["doc_id"] == cuts[key], "left").withColumn("text", cut("text", cuts_at))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(cuts_at).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return d.select(*columns(docs))
