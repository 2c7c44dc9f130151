"""URL filter: logistic regression on hashed character n-grams of host and path.

The model is trained from a small table of labelled URLs (url, label; 1 is a
URL to reject), on the driver: its size is that of the labelled table, not of
the corpus.  Host and path have n-grams of their own, so ``bets`` in a host and
in a path weigh differently.  A URL's score is the sum of its n-grams' weights,
each counted once, through a logistic function.

Defined cases
* null or empty URL: score null, not rejected.
* no scheme, user, port, upper case: the host is what stands before the first
  ``/ ? #`` after any ``//``, without user and port, in lower case.  The path is the rest.
* very long URLs: read whole.  Repeated rows: each is scored.
* an empty pages table gives an empty result; an empty labelled table, or one of
  a single label, gives a model that rejects nothing (score 0.5 or that label's side, unrejected).
* columns besides page_id and url are not read by ``score``; ``keep`` returns all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._text import U, mix, utf8

BUCKETS, SIZES = 1 << 16, (3, 4, 5)
THRESHOLD = 0.5

_GOOD_HOSTS = """www.thestream.example.org news.harbor.example.com blog.orchard.example.net m.recipes.example.com library.example.org
docs.parser.example.net thther.example.com tionre.example.org therin.example.net www.ththat.example.com blog.tiontion.example.com
m.ththen.example.net ththre.example.org www.weather.example.org museum.example.com blog.gardening.example.org m.trains.example.net
history.example.org www.theron.example.com ththble.example.net schools.example.com www.physics.example.org blog.tionsh.example.net
m.ththth.example.org thered.example.com www.cityhall.example.net therly.example.org blog.ththou.example.com m.therwh.example.net
www.choir.example.org sports.example.com radio.example.net www.ththand.example.com blog.therst.example.org m.theres.example.com
www.chemistry.example.net farming.example.org www.adder.example.com blog.freedom.example.net m.bettermaps.example.org""".split()
_BAD_HOSTS = """casino-win.example.com www.casino-win.example.net m.casino-royal.example.org win-casino.example.com free-bets.example.org
www.free-bets.example.com m.best-bets.example.net blog.sports-bets.example.com spam-farm.example.net www.spam-farm.example.org
m.spam-links.example.com blog.link-farm.example.org cheap-pills.example.com www.cheap-pills.example.net m.pills-online.example.org
blog.cheap-meds.example.com adult-x.example.net www.adult-x.example.com m.adult-cams.example.org blog.x-adult.example.net
ads-track.example.com www.ads-track.example.net m.ad-tracker.example.org track-ads.example.com malware-dl.example.org
www.malware-dl.example.com m.free-malware.example.net phish-login.example.com www.phish-login.example.org warez-crack.example.net
www.warez-crack.example.com m.crack-keys.example.org porn-tube.example.com www.xxx-porn.example.net m.poker-bonus.example.com
www.lottery-prize.example.org free-money.example.net www.payday-loans.example.com m.get-rich.example.org""".split()
_PATHS = ("/en/425", "/de/88?page=2&ref=x", "/fr/9310.html", "/es/17/", "/en/2048#top", "/de/5120?utm_source=feed", "/index.html", "/")
_BAD_PATHS = ("/free-bonus/win", "/buy-cheap-pills", "/casino/jackpot?aff=1", "/xxx/video", "/download/crack.exe", "/click?track=ads")

#: The small labelled URL table.
LABELLED: list[tuple[str, int]] = [(f"https://{h}{p}", 0) for i, h in enumerate(_GOOD_HOSTS) for p in _PATHS[i % 2 :: 2]]
LABELLED += [(f"https://{h}{p}", 1) for i, h in enumerate(_BAD_HOSTS) for p in _PATHS[i % 2 :: 2]]
LABELLED += [(f"https://{h}{p}", 1) for i, h in enumerate(_GOOD_HOSTS) for p in _BAD_PATHS[i % 3 :: 3]]

HOST = r"^(?:[^/?#]*//)?(?:[^/?#@]*@)?([^/?#:]*)"


def parts(url):
    """(host, path) as columns."""
    low = F.lower(url)
    return F.regexp_extract(low, HOST, 1), F.regexp_replace(low, r"^(?:[^/?#]*//)?[^/?#]*", "")


def grams(arr: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct n-gram, the text between ``^`` and ``$``."""
    d, o = utf8(arr)
    d = d[o[0] : o[-1]].astype(U) if len(o) else d.astype(U)
    o = o - o[0]
    n = len(o) - 1
    size = np.diff(o) + 2
    start = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=start[1:])
    full = np.empty(start[-1], U)
    inner = np.ones(len(full), bool)
    inner[start[:-1]] = inner[start[1:] - 1] = False
    full[start[:-1]], full[start[1:] - 1] = U(ord("^")), U(ord("$"))
    full[inner] = d
    row = np.repeat(np.arange(n), size)
    left = start[1:][row] - np.arange(len(full))
    rows, buckets = [], []
    h = np.zeros(len(full), U)
    for k in range(max(SIZES)):
        shifted = np.zeros(len(full), U)
        shifted[: max(len(full) - k, 0)] = full[k:]
        h = h * U(0x100000001B3) + shifted + U(1)
        if k + 1 in SIZES:
            ok = left >= k + 1
            rows.append(row[ok])
            buckets.append((mix(h[ok] + U(salt * 31 + k)) >> U(48)).astype(np.int64) % BUCKETS)
    key = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(buckets)) if rows else np.zeros(0, np.int64)
    return key // BUCKETS, key % BUCKETS


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    (r0, b0), (r1, b1) = grams(host, 1), grams(path, 2)
    return np.concatenate([r0, r1]), np.concatenate([b0, b1 + BUCKETS])


def fit(host: pa.Array, path: pa.Array, label: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Weights of host and path n-grams and the bias, by full-batch Adam, classes balanced."""
    w = np.zeros(2 * BUCKETS + 1)
    n = len(label)
    if not n:
        return w
    row, at = features(host, path)
    weight = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    m, s = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[at], n) + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label)
        grad = np.append(np.bincount(at, g[row], 2 * BUCKETS), g.sum()) + l2 / n * w
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return w


def train(labelled: DataFrame) -> tuple[np.ndarray, bool]:
    """The weights, and whether both labels were there to learn from."""
    host, path = parts(F.col("url"))
    t = labelled.where("length(url) > 0 and label is not null").select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")).toArrow()
    label = np.asarray(t["label"].combine_chunks())
    return fit(t["host"].combine_chunks(), t["path"].combine_chunks(), label), len(set(label.tolist())) == 2


def scorer(w: np.ndarray):
    small = w.astype(np.float32)

    @arrow_udf("double")
    def score(host: pa.Array, path: pa.Array) -> pa.Array:
        row, at = features(host, path)
        z = np.bincount(row, small[at], len(host)) + float(small[-1])
        return pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), mask=np.asarray(host.is_null()))

    return score


def default_labelled(spark) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label int")


def _scored(pages: DataFrame, labelled: DataFrame | None) -> tuple[object, bool]:
    w, learnt = train(default_labelled(pages.sparkSession) if labelled is None else labelled)
    host, path = parts(F.expr("nullif(url, '')"))
    return scorer(w)(host, path), learnt


def score(pages: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, score (P(reject)) and reject for each row."""
    s, learnt = _scored(pages, labelled)
    return pages.select("page_id", "url", s.alias("score")).withColumn("reject", F.coalesce(F.col("score") >= threshold, F.lit(False)) & F.lit(learnt))


def keep(pages: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of pages whose URL isn't rejected, with all their columns."""
    s, learnt = _scored(pages, labelled)
    return pages.where(~(F.coalesce(s >= threshold, F.lit(False)) & F.lit(learnt)))
