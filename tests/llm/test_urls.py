import numpy as np
import pyarrow as pa
from lodestrata.llm import urls as L
from pyspark.sql import functions as F

BAD = ("casino-win", "free-bets", "spam-farm", "cheap-pills", "adult-x", "ads-track")


def test_parts(spark):
    cases = {
        "HTTPS://User:pw@WWW.Ex.com:80/A?b#c": ("www.ex.com", "/a?b#c"),
        "ex.com": ("ex.com", ""),
        "//ex.com?q": ("ex.com", "?q"),
        "http://ex.com/redirect=http://other.com": ("ex.com", "/redirect=http://other.com"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    host, path = L.parts(F.col("url"))
    assert {r[0]: (r[1], r[2]) for r in df.select("url", host, path).collect()} == cases


def test_grams_are_those_of_the_text():
    row, at = L.grams(pa.array(["abab", "", None, "é"]), 1)
    size = [len({s[i : i + n] for n in L.SIZES for i in range(len(s) - n + 1)}) for s in (b"^abab$", b"^$", b"^$", b"^\xc3\xa9$")]
    assert np.bincount(row, minlength=4).tolist() == size
    one, two = L.grams(pa.array(["xyz"]), 1), L.grams(pa.array(["q", "xyz"]), 1)
    assert one[1].tolist() == two[1][two[0] == 1].tolist()


def test_held_out(spark, sf):
    """The sites that make a page bad are not in the table it is trained from."""
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet")
    others = [(u, y) for u, y in L.LABELLED if not any(b in u for b in BAD)]
    assert len(others) < len(L.LABELLED)
    rows = L.score(pages, spark.createDataFrame(others, "url string, label int")).collect()
    bad = [r["reject"] for r in rows if any(b in r["url"] for b in BAD)]
    good = [r["reject"] for r in rows if not any(b in r["url"] for b in BAD)]
    assert bad and np.mean(bad) > 0.9 and np.mean(good) < 0.02


def test_query_against_site_names(spark, sf):
    from lodestrata.llm.entries import QUERIES

    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    rows = QUERIES["op4_url_filter"](spark, sf.replace("0.001", "0.01")).collect()
    truth = [any(b in r["url"] for b in BAD) for r in rows]
    found = [r["reject"] for r in rows]
    assert len(rows) == pages.count() and np.mean([a == b for a, b in zip(truth, found, strict=True)]) > 0.97
    kept = L.keep(pages)
    assert kept.columns == pages.columns and kept.count() == found.count(False)


def test_cases(spark):
    schema = "page_id long, url string, score double, reject string, label int"
    long = "http://" + "a" * 100_000 + ".example.com/"
    df = spark.createDataFrame([(1, None, 1.0, "x", 1), (2, "", 1.0, "x", 1), (3, long, 1.0, "x", 1), (None, "http://a.com", 1.0, "x", 1), (3, long, 1.0, "x", 1)], schema)
    got = L.score(df).collect()
    by = {(r["page_id"], r["url"]): (r["score"], r["reject"]) for r in got}
    assert len(got) == 5 and by[1, None] == (None, False) and by[2, ""] == (None, False) and by[None, "http://a.com"][0] is not None
    assert L.keep(df).columns == df.columns and L.score(df.limit(0)).count() == 0
    none = spark.createDataFrame([], "url string, label int")
    assert not any(r["reject"] for r in L.score(df, none).collect())
    only = spark.createDataFrame([("http://x.com", 1)], "url string, label int")
    assert not any(r["reject"] for r in L.score(df, only).collect())
