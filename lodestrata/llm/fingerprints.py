"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for a byte string, the values of its prefixes as polynomials
modulo two primes near 2^31.  Any two spans, of one text or of two, are compared
in constant time, and the longest common extension of two places is found by
binary search.

``fingerprint`` gives every document the hash of its whole text and the longest
opening, to the byte, that it shares with any other document.  A text is cut at
16, 64, 256, 512 bytes and every 512 from there on.  A piece goes under its
*node*, the hash of all that stands before it: pieces of one node come from
texts that are equal so far.  All pieces are range-sorted by (node, bytes), which
brings those with the longest common extension side by side; neighbours are
compared by prefix hashes and binary search, and a document's longest result
counts.  No node or opening is one task, however many share it: the ranges also
cut inside nodes and among copies, and the pieces on both sides of a cut meet
in a second pass of two rows a partition.

Defined cases
* null text: a row with null n_bytes, fingerprint, neighbor and common_bytes.
* null doc_id: a fingerprint, but never compared.
* empty text: fingerprint 0, 0 bytes, shares nothing.
* neighbor: a document that shares common_bytes bytes, of those beside it in the
  sorted order; among several the least doc_id; null where nothing is shared.
* rows that repeat a doc_id are compared like any others: a row that is there twice is its own neighbor.
* very long texts: read whole, in pieces.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ._scratch import Scratch, width
from ._text import U, blocks, utf8

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (911_382_323, 1_367_130_551)
STEP = 512
FIRST = np.array([0, 16, 64, 256])
_made: dict[tuple[int, int, int], np.ndarray] = {}


def _powers(base: int, prime: int, bits: int) -> np.ndarray:
    if (base, prime, bits) not in _made:
        p = np.ones(1, U)
        while len(p) < 1 << bits:
            p = np.concatenate([p, p * U(pow(base, len(p), prime)) % U(prime)])
        _made[base, prime, bits] = p
    return _made[base, prime, bits]


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo prime."""
    return _powers(base, prime, max(int(n).bit_length(), 1))[: n + 1]


class Prefixes:
    """Prefix hashes of a byte string."""

    def __init__(self, d: np.ndarray):
        self.n = len(d)
        self.sums = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            s = np.zeros(len(d) + 1, U)
            np.cumsum((d.astype(U) + U(1)) * powers(base, prime, len(d))[: len(d)] % U(prime), out=s[1:])  # below 2^63 up to 4 GB
            self.sums.append(s % U(prime))

    def spans(self, a, b) -> np.ndarray:
        """62-bit hashes of the spans from a to b (arrays): equal bytes, equal hashes, wherever they stand."""
        a, b = np.asarray(a), np.asarray(b)
        out = np.zeros(np.broadcast(a, b).shape, U)
        for s, base, prime in zip(self.sums, BASES, PRIMES, strict=True):
            v = (s[b] + U(prime) - s[a]) * powers(pow(base, -1, prime), prime, self.n)[a] % U(prime)
            out = out << U(31) | v
        return out.view(np.int64)

    def equal(self, i: int, j: int, n: int, other: Prefixes | None = None) -> bool:
        """Whether n bytes from i on are those of the other text (or this one) from j on."""
        other = other or self
        return i + n <= self.n and j + n <= other.n and self.spans(i, i + n) == other.spans(j, j + n)

    def extension(self, i: int, j: int, other: Prefixes | None = None) -> int:
        """Length of the longest common extension of places i and j."""
        other = other or self
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.equal(i, j, mid, other) else (lo, mid - 1)
        return lo


def begin(k: np.ndarray) -> np.ndarray:
    """First byte of a text's piece k."""
    return np.where(k < len(FIRST), FIRST[np.minimum(k, len(FIRST) - 1)], (k - len(FIRST) + 1) * STEP)


def number(at: np.ndarray) -> np.ndarray:
    """Which piece begins at a byte."""
    return np.where(at < STEP, np.searchsorted(FIRST, at), len(FIRST) - 1 + at // STEP)


def cuts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, byte after the last) of every piece of texts of n bytes, one at least of each."""
    m = 1 + (n[:, None] > FIRST[1:]).sum(1) + np.maximum((n - 1) // STEP, 0)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(m, out=first[1:])
    of = np.repeat(np.arange(len(n)), m)
    k = np.arange(first[-1]) - first[of]
    return of, begin(k), np.minimum(begin(k + 1), n[of])


def cutter(batches):
    """The pieces of (doc_id, text): doc_id, n_bytes, fingerprint, at (first byte), node, piece."""
    for b in batches:
        for i, j, d, o in blocks(b.column(1)):
            p, n = Prefixes(d), np.diff(o)
            of, at, end = cuts(n)
            node = p.spans(o[of], o[of] + at) ^ (at * 0x9E3779B97F4A7C1)
            off = np.zeros(len(of) + 1, np.int32)
            np.cumsum(end - at, out=off[1:])
            piece = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(d))])
            numbers = [pa.array(x, pa.int64()) for x in (n[of], p.spans(o[:-1], o[1:])[of], at, node)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(of)), *numbers, piece], ["doc_id", "n_bytes", "fingerprint", "at", "node", "piece"])


def extensions(piece: pa.Array, i: np.ndarray) -> np.ndarray:
    """Bytes that pieces i and i + 1 have in common from their first on, by binary search."""
    d, o = utf8(piece)
    d, o = d[o[0] : o[-1]], o - o[0]
    p, size = Prefixes(d), np.diff(o)
    a, b = o[i], o[i + 1]
    lo, hi = np.zeros(len(i), np.int64), np.minimum(size[i], size[i + 1])
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = p.spans(a, a + mid) == p.spans(b, b + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def walker(inner: bool):
    """Over sorted pieces: a row for each document (copies = 1) and two for what neighbours share.

    ``inner``: the pieces at a partition's ends are passed on, to meet those of the next.
    """

    def shown(b, x, y, common):
        row = [b.column(c).take(pa.array(x)) for c in ("doc_id", "n_bytes", "fingerprint")]
        return pa.RecordBatch.from_arrays([*row, pa.nulls(len(x), pa.int32()), pa.array(common), b.column("doc_id").take(pa.array(y)), *blank(b, len(x))], NAMES)

    def blank(b, n):
        return [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, b.column("piece").type)]

    def edge(b):
        row = [b.column(c) for c in ("doc_id", "n_bytes", "fingerprint")]
        return pa.RecordBatch.from_arrays([*row, pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, row[0].type), *(b.column(c) for c in ("at", "node", "piece"))], NAMES)

    def walk(batches):
        held, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            seen += b.num_rows
            if inner:
                new = b.filter(pa.array(np.asarray(b.column("at")) == 0))
                row = [new.column(c) for c in ("doc_id", "n_bytes", "fingerprint")]
                yield pa.RecordBatch.from_arrays([*row, pa.array(np.ones(new.num_rows, np.int32)), pa.nulls(new.num_rows, pa.int64()), pa.nulls(new.num_rows, row[0].type), *blank(b, new.num_rows)], NAMES)
                if held is None:
                    yield edge(b.slice(0, 1))
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            node, at, n = (np.asarray(b.column(c)) for c in ("node", "at", "n_bytes"))
            i = np.flatnonzero(node[1:] == node[:-1])
            if len(i):
                got = extensions(b.column("piece"), i)
                upto = begin(number(at[i]) + 1)
                both = at[i] + got
                more = (both >= upto) & (np.minimum(n[i], n[i + 1]) > upto)  # their next pieces share a node
                i, both = i[(both > 0) & ~more], both[(both > 0) & ~more]
                yield shown(b, i, i + 1, both)
                yield shown(b, i + 1, i, both)
            held = b.slice(b.num_rows - 1)
        if inner and seen > 1:
            yield edge(held)

    return walk


NAMES = ["doc_id", "n_bytes", "fingerprint", "copies", "common", "other", "at", "node", "piece"]


@arrow_udf(T.StructType().add("n_bytes", T.LongType()).add("fingerprint", T.LongType()))
def whole(text: pa.Array) -> pa.Array:
    """Length and hash of each text."""
    size, made = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, d, o in blocks(text):
        size.append(np.diff(o))
        made.append(Prefixes(d).spans(o[:-1], o[1:]))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (size, made)], ["n_bytes", "fingerprint"], mask=text.is_null())


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, fingerprint, neighbor and common_bytes of each row."""
    _made.clear()  # not to travel with the tasks
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    key = ["node", "piece", "doc_id", "fingerprint"]
    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    cut = known.mapInArrow(cutter, f"doc_id {kind}, n_bytes long, fingerprint long, at long, node long, piece binary")
    made = f"doc_id {kind}, n_bytes long, fingerprint long, copies int, common long, other {kind}, at long, node long, piece binary"
    found = Scratch(spark).table(cut.repartitionByRange(width(spark), *key).sortWithinPartitions(*key).mapInArrow(walker(True), made))
    ends = found.where("piece is not null").select("doc_id", "n_bytes", "fingerprint", "at", "node", "piece")
    ends = ends.repartition(1).sortWithinPartitions(*key).mapInArrow(walker(False), made)
    every = found.where("piece is null").union(ends)
    best = every.groupBy("doc_id", "n_bytes", "fingerprint").agg(F.sum("copies").cast("int").alias("copies"), F.min(F.when(F.col("common").isNotNull(), F.struct((-F.col("common")).alias("less"), "other"))).alias("b"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    best = best.select("doc_id", "n_bytes", "fingerprint", F.col("b.other").alias("neighbor"), F.coalesce(-F.col("b.less"), F.lit(0)).alias("common_bytes"))
    rest = docs.where("doc_id is null or text is null").select("doc_id", whole("text").alias("m"))
    return best.union(rest.select("doc_id", "m.n_bytes", "m.fingerprint", F.lit(None).cast(kind), F.lit(None).cast("long")))
