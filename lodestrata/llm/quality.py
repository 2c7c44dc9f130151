"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or abstain on every document.  The votes of
all documents are counted by pattern (at most 3^labellers patterns, whatever
the corpus), and expectation-maximisation over the counts estimates each
labeller's accuracy and each pattern's probability of being good.  Those
posteriors label a sample of at most ``sample_rows`` different texts (the one
bounded part: fitting), on which a linear scorer over hashed byte trigrams and
hashed word shapes is trained; the scorer then reads every document.

Defined cases
* null or empty text, or one of white space alone: score 0, not kept.
* null in other columns, repeated rows: each row is scored by its text alone.
* very long texts: read whole, one at a time.
* an empty table gives an empty result; a table of one kind of document alone
  gives a scorer that agrees with the pattern posteriors, whatever they are.
* columns besides doc_id and text are not read; the stage returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ._scratch import width
from ._text import SPACE, U, blocks, mix, per_doc, runs

SAMPLE_ROWS = 6000
TRIGRAMS, SHAPES = 1 << 15, 1 << 10
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[[*range(97, 123), *range(128, 192)]] = True  # characters beyond ASCII by their last byte
LETTER_END = np.zeros(256, bool)
LETTER_END[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
ODD = np.zeros(256, bool)
ODD[[ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~"]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True

LABELLERS = ("odd_symbols", "upper_case", "repeats", "separators", "exclaims", "no_short_words", "long_words", "plain_letters", "word_mix", "sentences")


class Tokens:
    """White-space tokens of a block, with a hash of their letters for telling repeats."""

    def __init__(self, d: np.ndarray, o: np.ndarray):
        self.start, self.end = runs(~SPACE[d], o)
        self.n = self.end - self.start
        self.of = np.searchsorted(self.start, o)
        self.count = np.diff(self.of)
        c = np.zeros(len(d) + 1, U)
        np.cumsum((d.astype(U) + U(1)) * (d.astype(U) + U(977)) * U(0x9E3779B97F4A7C15), out=c[1:])
        h = mix((c[self.end] - c[self.start]) + self.n.astype(U))  # order within a word doesn't matter here
        self.repeat = np.zeros(len(h), bool)
        self.repeat[1:] = h[1:] == h[:-1]
        self.repeat[self.of[:-1][self.count > 0]] = False


def votes(arr: pa.Array) -> np.ndarray:
    """Each text's pattern of votes, in base 3: 0 abstains, 1 is bad, 2 is good; -1 without tokens."""
    out = np.full(len(arr), -1, np.int64)
    for i, j, d, o in blocks(arr):
        t = Tokens(d, o)
        words = np.maximum(t.count, 1)
        upper, lower = per_doc(UPPER[d], o), per_doc(LOWER[d], o)
        odd, pipes, shouts, stops = (per_doc(x, o) / words for x in (ODD[d], d == ord("|"), d == ord("!"), STOP[d]))
        capitals, repeats = upper / np.maximum(upper + lower, 1), per_doc(t.repeat, t.of) / words
        short, length = per_doc(t.n <= 3, t.of) / words, per_doc(t.n.astype(float), t.of) / words
        bad = [odd > 0.3, capitals > 0.5, repeats > 0.3, pipes > 0.2, shouts > 0.4, (short < 0.08) & (words >= 8), (length > 9.5) & (words >= 8)]
        good = [(odd < 0.02) & (capitals < 0.2) & ((shouts < 0.05) | (words < 12)) & (repeats < 0.1) & (pipes < 0.05), ((short > 0.15) & (short < 0.7) | (words < 12)) & (pipes < 0.05) & (repeats < 0.1) & (odd < 0.05), ((stops > 0.02) & (stops < 0.5) | (words < 12)) & (pipes < 0.05) & (repeats < 0.1) & (capitals < 0.3) & (odd < 0.05)]
        v = [np.where(x, 1, 0) for x in bad] + [np.where(x, 2, 0) for x in good]
        code = sum(x * 3**k for k, x in enumerate(v))
        out[i:j] = np.where(t.count > 0, code, -1)
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """(P(good) of each pattern, P(good), accuracies[labeller, class, vote]) by expectation-maximisation.

    A labeller's accuracies are its chances of each vote, abstention included,
    on documents of either class: of labellers that only ever vote one way, when
    they abstain tells as much.  All start out voting right 4 times in 5, which
    fixes which class is the good one.
    """
    m = len(LABELLERS)
    v = np.stack([patterns // 3**k % 3 for k in range(m)], 1)
    n = counts.astype(float)
    prior, table = 0.8, np.tile(np.array([[0.5, 0.4, 0.1], [0.5, 0.1, 0.4]]), (m, 1, 1))
    post = np.full(len(n), prior)
    for _ in range(rounds if n.sum() else 0):
        z = np.log(table)[np.arange(m)[None], :, v].sum(1) + np.log([1 - prior, prior])
        post = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500)))
        w = np.stack([(1 - post) * n, post * n], 1)
        for k in range(m):
            for vote in range(3):
                table[k, :, vote] = w[v[:, k] == vote].sum(0)
        table += 0.5  # a vote that hasn't occurred stays possible
        table /= table.sum(2, keepdims=True)
        prior = float(np.clip(w[:, 1].sum() / n.sum(), 0.01, 0.99))
    return post, prior, table


def buckets(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tokens]:
    """Bucket of the trigram from each byte on, whether it is whole; bucket of each token's shape."""
    tri = np.zeros(len(d), np.uint32)
    whole = np.zeros(len(d), bool)
    if len(d) > 2:
        x = d.astype(np.uint32)
        tri[:-2] = ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(17)
        whole[:-2] = True
        for back in (1, 2):
            at = o[1:] - back
            whole[at[at >= 0]] = False
    t = Tokens(d, o)
    cu, co = np.zeros(len(d) + 1, np.int64), np.zeros(len(d) + 1, np.int64)
    np.cumsum(UPPER[d], out=cu[1:])
    np.cumsum(ODD[d], out=co[1:])
    case = np.minimum(cu[t.end] - cu[t.start], 2)
    odd = np.minimum(co[t.end] - co[t.start], 3)
    last = d[t.end - 1] if len(t.end) else np.zeros(0, np.uint8)
    tail = np.select([LETTER_END[last], STOP[last], ODD[last]], [0, 1, 2], 3)
    shape = (((np.minimum(t.n, 15) * 3 + case) * 4 + odd) * 4 + tail) * 2 + t.repeat
    return tri, whole, shape % SHAPES, t


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A document's hashed features as (bucket, mean count)."""
    idx, val = [], []
    for _, _, d, o in blocks(pa.array([text], pa.string())):
        tri, whole, shape, _ = buckets(d, o)
        for x, base in ((tri[whole], 0), (shape, TRIGRAMS)):
            k, c = np.unique(x, return_counts=True)
            idx.append(k.astype(np.int32) + base)
            val.append((c / max(len(x), 1)).astype(np.float32))
    return np.concatenate(idx), np.concatenate(val)


def scores(arr: pa.Array, weights: np.ndarray) -> np.ndarray:
    """P(good) of each text, whole; 0 without tokens."""
    out = np.zeros(len(arr))
    wt, ws, bias = weights[:TRIGRAMS], weights[TRIGRAMS:-1], weights[-1]
    for i, j, d, o in blocks(arr):
        tri, whole, shape, t = buckets(d, o)
        z = per_doc(np.where(whole, wt[tri], 0.0), o) / np.maximum(per_doc(whole, o), 1)
        z += per_doc(ws[shape], t.of) / np.maximum(t.count, 1) + bias
        out[i:j] = np.where(t.count > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0)
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 12, batches: int = 12) -> np.ndarray:
    """Weights of the linear scorer (trigrams, shapes, bias), by Adam over batches, on soft targets."""
    w = np.zeros(TRIGRAMS + SHAPES + 1)
    if not len(rows):
        return w
    weight = np.abs(2 * target - 1)  # what the labellers leave open teaches little
    bad = (weight * (1 - target)).sum()
    good = (weight * target).sum()
    weight = weight * np.where(target < 0.5, 0.5 / max(bad, 1e-9), 0.5 / max(good, 1e-9))
    parts = []
    for k in np.array_split(np.arange(len(rows)), min(batches, len(rows))):
        idx, val = np.concatenate([rows[i][0] for i in k]), np.concatenate([rows[i][1] for i in k]).astype(np.float64)
        parts.append((k, np.repeat(np.arange(len(k)), [len(rows[i][0]) for i in k]), idx, val))
    m, s, r = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        for k, doc, idx, val in parts:
            r += 1
            z = np.bincount(doc, val * w[idx], len(k)) + w[-1]
            g = len(parts) * weight[k] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target[k])
            grad = np.append(np.bincount(idx, val * g[doc], TRIGRAMS + SHAPES), g.sum()) + 1e-7 * w
            m = 0.9 * m + 0.1 * grad
            s = 0.99 * s + 0.01 * grad**2
            w -= 0.5 * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-8)
    return w


@arrow_udf(T.LongType())
def pattern(text: pa.Array) -> pa.Array:
    return pa.array(votes(text))


@arrow_udf(T.StructType().add("pattern", T.LongType()).add("idx", T.ArrayType(T.IntegerType())).add("val", T.ArrayType(T.FloatType())))
def sampled(text: pa.Array) -> pa.Array:
    rows = [features(x.as_py()) for x in text]
    return pa.StructArray.from_arrays([pa.array(votes(text)), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["pattern", "idx", "val"])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Votes over all documents, then the scorer from at most sample_rows different texts.

    The sample is the least hashes of texts; equal texts are one, however many there are.
    """
    texts = docs.select("text").where("text is not null")
    counted = texts.select(pattern("text").alias("p")).groupBy("p").count().where("p >= 0").collect()
    total = sum(r["count"] for r in counted)
    codes = np.array([r["p"] for r in counted], np.int64)
    post, _, _ = estimate(codes, np.array([r["count"] for r in counted], np.int64))
    good = dict(zip(codes.tolist(), post.tolist(), strict=True))
    share = min(1.0, 2 * sample_rows / max(total, 1))
    h = F.xxhash64("text", F.lit(3)).bitwiseAND((1 << 62) - 1)
    rows = texts.withColumn("h", h).where(F.col("h") <= int(share * ((1 << 62) - 1)))
    rows = rows.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(sample_rows).repartition(width(docs.sparkSession))
    got = rows.select("h", sampled("text").alias("s")).select("h", "s.*").where("pattern >= 0").toArrow().sort_by("h")
    target = np.array([good[p] for p in got["pattern"].to_pylist()])
    return fit([(np.asarray(i.values), np.asarray(v.values)) for i, v in zip(got["idx"], got["val"], strict=True)], target)


def scorer(weights: np.ndarray):
    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(scores(text, weights))

    return score


def classify(docs: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, score (P(good)) and keep for each row."""
    score = scorer(train(docs, **options))
    return docs.select("doc_id", score("text").alias("score")).withColumn("keep", F.col("score") >= threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    return docs.where(scorer(train(docs, **options))("text") >= threshold)
