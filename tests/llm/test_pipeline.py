import corpus_pipeline
from lodestrata.llm import mixing, neardup, packing, quality, secrets


def test_stages(spark, sf, tmp_path):
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == before.columns
        seen.append((name, docs, after))
        docs = after
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    assert ids(b) == sorted(r["doc_id"] for r in quality.classify(a).where("keep").collect()) and 0 < b.count() < a.count()
    gone = {r["doc_id"] for r in neardup.near_duplicates(b).where("doc_id <> duplicate_of").collect()}
    assert gone and ids(c) == [i for i in ids(b) if i not in gone]
    assert ids(d) == ids(c) and secrets.scan(d).count() == 0
    assert sorted(ids(e)) == sorted(r["doc_id"] for r in mixing.assign(d).collect())
    assert sum(r["length"] for r in f.collect()) == sum(len(r["text"].encode()) + 1 for r in e.collect())


def test_run_is_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    e = mixing.mix(secrets.redact(neardup.dedup(quality.keep_good(docs))))
    want = packing.pack(e)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_secrets_go(spark, sf):
    found = secrets.scan(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"))
    assert found.count() > 0


def test_nulls_repeats_and_other_columns(spark, tmp_path):
    good = "The river ran past the old mill, and the miller went out to see it. It was late in the day, and number {} came by."
    junk = "$$$ ### @@@ %%% &&& *** !!! ||| ~~~ ^^^ $$$ ### @@@ %%% &&& ***"
    rows = [(i, good.format(f"{i} {i * 7} {i * 31}"), "en", "s", 9, "u", 1) for i in range(60)]
    rows += [(100 + i, junk + f" {i}", "en", "s", 9, "u", 1) for i in range(15)]
    rows += [(200, None, None, None, None, None, None), (201, "", "en", "s", 0, "u", 1), (None, good.format("x"), None, None, None, None, None)]
    rows += [(202, good.format("password=hunter2hunter2"), None, None, 9, None, None), rows[3], rows[3], (203, good.format("y") * 3000, "en", None, 9, "u", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `meta.url` string, __lode_h long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "meta.url", "__lode_h"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {None, 202, 203, 3} >= {r["doc_id"] for r in out} - set(range(60)) and all(r["length"] > 0 for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
