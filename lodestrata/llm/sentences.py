"""Substring dedup by sliding sentence spans.

A text's words (ASCII case and all else between them ignored) are cut to
sentences: after ``. ! ? , ; :`` and line ends, and after words picked by their
own hash, so that text without punctuation has ends too.  A span starts at every
sentence and takes as many consecutive sentences, two at least, as make
``words`` words; another ends at every sentence and takes as many before it.  So
each run of that length is the union of spans inside it.  A shorter text of two
sentences or more is one span.  Where a passage stands between other words, all but its first
sentence are cut alike everywhere, so its spans are equal.

Span hashes of all documents are aggregated to the repeated ones and their
first occurrence, and those are joined with the spans again; every occurrence
but the first marks the sentences it covers.

Defined cases
* null doc_id or null text: never compared; ``remove`` keeps the row as it is.
* texts of fewer words than a span: removed as a whole if they have several sentences and repeat a whole text.
* first: the least (doc_id, place).  Within one document the later passage goes.
* rows that repeat a doc_id are one document: a span at the same place in both is one occurrence.
* very long texts: read whole.  Texts that overlap themselves: each occurrence but the first is covered.
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

from ._scratch import Scratch, columns, free
from ._text import U, Words, blocks, mix, powers

WORDS = 20
PICKED = 16
BASE = 0x9E3779B97F4A7C15
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?,;:\n\r"]] = True


def lowered(d: np.ndarray) -> np.ndarray:
    return np.where((d >= 65) & (d <= 90), d | 32, d)


def spans(d: np.ndarray, o: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, first byte, byte after the last) of every span of a block."""
    w = Words(lowered(d), o)
    n = len(w.hash)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    cut = np.zeros(len(d) + 1, np.int64)
    np.cumsum(ENDS[d], out=cut[1:])
    first = np.zeros(n, bool)
    first[w.of[:-1][w.count > 0]] = True
    first[1:] |= (cut[w.start[1:]] > cut[w.end[:-1]]) | (w.hash[:-1] % U(PICKED) == 0)
    unit = np.append(np.flatnonzero(first), n)  # first word of each sentence
    stop = np.repeat(w.of[1:], w.count)[unit[:-1]]  # word after the document's last
    to = np.maximum(np.searchsorted(unit, unit[:-1] + words), np.arange(len(unit) - 1) + 2)
    end = unit[np.minimum(to, len(unit) - 1)]
    ok = (to < len(unit)) & (end <= stop)
    begin = np.repeat(w.of[:-1], w.count)[unit[1:] - 1]  # the document's first word, by sentence end
    since = np.minimum(np.searchsorted(unit, unit[1:] - words, "right") - 1, np.arange(len(unit) - 1) - 1)
    since = np.where((since >= 0) & (unit[since] >= begin), unit[since], -1)
    short = (unit[1:] == w.of[1:][np.searchsorted(w.of, begin, "right") - 1]) & (unit[1:] - begin < words) & (unit[:-1] > begin)
    since[short] = begin[short]
    kept = since >= 0
    both = np.unique(np.concatenate([unit[:-1][ok] * (n + 1) + end[ok], since[kept] * (n + 1) + unit[1:][kept]]))
    a, b = both // (n + 1), both % (n + 1)
    p = powers(BASE, n + 1)
    s = np.zeros(n + 1, U)
    np.cumsum(w.hash * p[:-1], out=s[1:])
    back = powers(pow(BASE, -1, 1 << 64), n + 1)
    h = mix((s[b] - s[a]) * back[a] + (b - a).astype(U))
    doc = np.searchsorted(w.of, a, "right") - 1
    last = np.where(b < w.of[doc + 1], w.start[np.minimum(b, n - 1)], o[doc + 1])
    return doc, h.view(np.int64), w.start[a] - o[doc], last - o[doc]


SPANS = T.ArrayType(T.StructType().add("hash", T.LongType()).add("place", T.LongType()))


def listing(words: int):
    @arrow_udf(SPANS)
    def spans_of(text: pa.Array) -> pa.Array:
        """Each text's spans, the place being first byte * 2^32 + byte after the last."""
        sizes, hashes, places = [], [], []
        for i, j, d, o in blocks(text):
            doc, h, a, b = spans(d, o, words)
            sizes.append(np.bincount(doc, minlength=j - i))
            hashes.append(h)
            places.append(a << 32 | b)
        off = np.zeros(len(text) + 1, np.int32)
        if sizes:
            np.cumsum(np.concatenate(sizes), out=off[1:])
        each = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (hashes, places)], ["hash", "place"])
        return pa.ListArray.from_arrays(pa.array(off), each)

    return spans_of


def all_spans(docs: DataFrame, words: int) -> DataFrame:
    d = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return d.select("doc_id", F.explode(listing(words)("text")).alias("s")).select("s.hash", "doc_id", "s.place")


def again(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, hash, place) of every occurrence of a repeated span but its first."""
    seen = all_spans(docs, words)
    first = seen.groupBy("hash").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max(F.struct("doc_id", "place")).alias("last"))
    first = Scratch(docs.sparkSession).table(first.where("first <> last").select("hash", F.col("first.doc_id").alias("fd"), F.col("first.place").alias("fp")))
    out = seen.join(first.hint("merge"), "hash").where("doc_id <> fd or place <> fp")
    return out.select("doc_id", "hash", "place")


def repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, start and end (UTF-8 bytes) of each passage to remove, apart from each other."""
    s = again(docs, words).select("doc_id", F.shiftright("place", 32).alias("a"), F.col("place").bitwiseAND((1 << 32) - 1).alias("b"))
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("new", F.coalesce(F.col("a") > before, F.lit(True)).cast("int"))
    s = s.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.groupBy("doc_id", "island").agg(F.min("a").alias("start"), F.max("b").alias("end"))
    return s.select("doc_id", "start", "end")


def cutter(words: int):
    @arrow_udf("string")
    def cut(text: pa.Array, hashes: pa.Array, places: pa.Array) -> pa.Array:
        got = []
        for t, hs, ps in zip(text, hashes, places, strict=True):
            raw = t.as_py()
            if raw is None or not hs.is_valid:
                got.append(raw)
                continue
            raw = raw.encode()
            d = np.frombuffer(raw, np.uint8)
            _, h, a, b = spans(d, np.array([0, len(d)]), words)
            mine = set(zip(h.tolist(), (a << 32 | b).tolist(), strict=True))
            keep = np.ones(len(d), bool)
            for x in zip(hs.as_py(), ps.as_py(), strict=True):
                if x in mine:  # else it is another row's of the same doc_id
                    keep[x[1] >> 32 : x[1] & (1 << 32) - 1] = False
            got.append(d[keep].tobytes().decode())
        return pa.array(got, pa.string())

    return cut


def remove(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs without the sentences that a non-first repeated span covers."""
    key, cuts_at = free(docs, "__lode_id"), free(docs, "__lode_cut")
    cuts = again(docs, words).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("hash", "place")).alias(cuts_at))
    d = docs.join(cuts.hint("merge"), docs["doc_id"] == cuts[key], "left")
    d = d.withColumn("text", cutter(words)("text", F.col(f"{cuts_at}.hash"), F.col(f"{cuts_at}.place")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(cuts_at).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return d.select(*columns(docs))
