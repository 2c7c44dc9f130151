import numpy as np
import pyarrow as pa
from lodestrata.llm import quality as Q

SCHEMA = "doc_id long, text string, source string, score string, keep int"


def test_estimate_recovers_accuracies():
    r = np.random.default_rng(0)
    m, n = len(Q.LABELLERS), 40_000
    truth = r.random(n) < 0.7
    right = r.uniform(0.75, 0.95, m)
    votes = np.zeros((n, m), int)
    for k in range(m):
        speaks, ok = r.random(n) < 0.6, r.random(n) < right[k]
        votes[:, k] = np.where(speaks, np.where(ok == truth, 2, 1), 0)
    codes = (votes * 3 ** np.arange(m)).sum(1)
    patterns, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    post, prior, table = Q.estimate(patterns, counts)
    assert abs(prior - 0.7) < 0.03
    assert (((post > 0.5)[inverse]) == truth).mean() > 0.93
    said = table[:, 1, 2] / (table[:, 1, 1] + table[:, 1, 2])
    assert np.abs(said - right).max() < 0.06


def test_pattern_counts_stand_for_documents():
    patterns, counts = np.array([0, 5, 2 * 3**8]), np.array([3, 2, 4])
    one = Q.estimate(patterns, counts)
    many = Q.estimate(np.repeat(patterns, counts), np.ones(9, int))
    assert np.allclose(np.repeat(one[0], counts), many[0]) and np.isclose(one[1], many[1])


def test_scores_are_the_linear_model():
    r = np.random.default_rng(1)
    w = r.normal(size=Q.TRIGRAMS + Q.SHAPES + 1)
    texts = ["Some words here. More!", "a", "", None, "   ", "ÜBER $$ 12 12", "x" * 3_000_000]
    got = Q.scores(pa.array(texts), w)
    for t, s in zip(texts, got, strict=True):
        if not t or not t.strip():
            assert s == 0
            continue
        i, v = Q.features(t)
        assert np.isclose(s, 1 / (1 + np.exp(-np.clip((w[i] * v).sum() + w[-1], -50, 50))), atol=1e-5)


def test_against_labels(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["keep"] for r in Q.classify(docs).collect() if r["doc_id"] in labels}
    good = [kept[i] for i in kept if labels[i] == 1]
    bad = [kept[i] for i in kept if labels[i] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_query_against_labels(spark, sf):
    from lodestrata.llm.entries import QUERIES

    sf = sf.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op3_quality_classifier"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r["keep"] == (labels[r["doc_id"]] == 1) for r in got if r["doc_id"] in labels]) > 0.95


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    sizes = []
    fit = Q.fit
    monkeypatch.setattr(Q, "fit", lambda rows, target: sizes.append(len(rows)) or fit(rows, target))
    df = spark.range(40_000).selectExpr("id doc_id", "'The same page of all, which was here before.' text")
    df = df.union(spark.range(3000).selectExpr("id", "concat('Another page, and it was number ', id, ' of them.')"))
    Q.train(df, 500)
    Q.train(df.limit(40_000), 500)
    assert sizes[0] <= 500 and sizes[1] <= 1


def test_cases(spark):
    good = "The river ran past the old mill, and the miller went out to see it. It was late in the day."
    junk = "$$$ ### @@@ %%% &&& *** !!! ||| ~~~ ^^^ $$$ ### @@@ %%% &&& ***"
    rows = [(i, good + f" He came back on day {i}.", "s", "x", 1) for i in range(60)] + [(100 + i, junk + f" {i}", "s", "x", 1) for i in range(15)]
    rows += [(200, None, "s", "x", 1), (201, "", "s", "x", 1), (202, " \n", "s", "x", 1), (None, good, None, None, None), (203, good * 20_000, "s", "x", 1), (203, good * 20_000, "s", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Q.classify(df).collect()
    keep = {r["doc_id"]: r["keep"] for r in got}
    assert len(got) == len(rows) and all(keep[i] for i in range(60)) and not any(keep[100 + i] for i in range(15))
    assert not keep[200] and not keep[201] and not keep[202] and keep[None] and keep[203]
    assert {r["score"] for r in got if r["doc_id"] in (200, 201, 202)} == {0.0}
    kept = Q.keep_good(df)
    assert kept.schema == df.schema and kept.count() == sum(r["keep"] for r in got)


def test_one_kind_and_empty(spark):
    df = spark.createDataFrame([(i, f"The old man went to the sea again, and it was day {i}.", "s", "x", 1) for i in range(30)], SCHEMA)
    assert all(r["keep"] for r in Q.classify(df).collect())
    assert Q.classify(df.limit(0)).count() == 0 and Q.keep_good(df.limit(0)).count() == 0
