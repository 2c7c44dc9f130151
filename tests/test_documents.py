"""Ingestion, writes, stored indices, mapping, statistics, streaming."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrata.functions import json as J
from lodestrata.operators import mapping, stats, writes
from lodestrata.plans.errors import DocumentExists, UpdateNotAllowed
from lodestrata.sources.bulk import bulk_documents, documents, parse_bulk, read_pairs
from lodestrata.sources.catalog import Catalog
from lodestrata.sources.store import Store
from lodestrata.streaming import ingest as S
from pyspark.sql import functions as F

from .docs import rows

FLAT = '{"nestedJson": "{\\"nestedKey\\":\\"nestedValue\\"}", "int": 123, "bool": true, "long": 1234567890123, "string": "str", "array":[100,101,102], "arrayObj":[{"int":124},{"int":125},{"double":1.01234}], "object":{"a":1,"b":2}}'


def test_flatten():
    got = json.loads(J.flatten_text(FLAT))
    assert list(got) == "nestedJson int bool long string array_0 array_1 array_2 arrayObj_0_int arrayObj_1_int arrayObj_2_double object_a object_b".split()
    assert got["arrayObj_2_double"] == 1.01234 and got["nestedJson"] == '{"nestedKey":"nestedValue"}'
    assert J.flatten_text('{"a":[],"b":{},"c":1.50,"d":null}') == '{"a":null,"c":1.50,"d":null}'
    assert J.flatten_text("[1]") is None and J.flatten_text("{") is None and J.flatten_text(None) is None


leaf = st.none() | st.booleans() | st.integers() | st.text(max_size=5)
tree = st.recursive(leaf, lambda x: st.lists(x, min_size=1, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, min_size=1, max_size=3), max_leaves=8)


def naive(v, name=""):
    if isinstance(v, dict):
        return [x for k, y in v.items() for x in naive(y, f"{name}_{k}" if name else k)]
    if isinstance(v, list):
        return [x for i, y in enumerate(v) for x in naive(y, f"{name}_{i}")]
    return [(name, v)]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), tree, min_size=1))
def test_flatten_any(doc):
    assert json.loads(J.flatten_text(json.dumps(doc))) == dict(naive(doc))


def test_merge_and_find():
    assert J.merge_text('{"a":1.50,"b":{"x":1}}', '{"b":{"y":2},"c":[1,2.0]}') == '{"a":1.50,"b":{"y":2},"c":[1,2.0]}'
    assert J.merge_text(None, "{}") == "{}" and J.merge_text("{}", None) == "{}"
    assert J.find_key({"a": [{"t": 5}]}, "t") == 5 and J.find_key({"a": 1}, "t") is None


def test_offsets_and_buckets(spark):
    cases = [("MINUTE", 1550503374995, 54), ("MINUTE", 1550464139989, 59), ("HOUR", 1550503374995, 22), ("HOUR", 1550464139989, 28), ("DAY", 1554595199999, 23)]
    for bucket, t, want in cases:
        assert spark.range(1).select(J.shard_offset(F.lit(t), bucket)).first()[0] == want
    r = J.with_buckets(spark.createDataFrame([(1550503374995,)], "_timestamp long")).first()
    assert tuple(r)[1:] == (1550503374000, 1550503320000, 1550502000000, 1550448000000)


def test_timestamps(spark):
    df = spark.createDataFrame([('{"t":5}',), ('{"t":"7"}',), ('{"a":{"t":9}}',), ('{"t":"x"}',)], "_source string")
    top = [r[0] for r in df.select(J.timestamp_of(F.col("_source"), "t", F.lit(-1))).collect()]
    deep = [r[0] for r in df.select(J.timestamp_of(F.col("_source"), "t", F.lit(-1), deep=True)).collect()]
    assert top == [5, 7, -1, -1] and deep == [5, 7, 9, -1]


def test_words(spark):
    r = spark.createDataFrame([("b a\tc\n d  ",)], "s string").select(J.words(F.col("s"))).first()[0]
    assert r == ["b", "a", "c", "d"]


BULK = '{"index":{"_index":"i","_type":"t","_id":"1"}}\n{"message":"a|b \\u0645 \\r\\n {x}\\n"}\n{"index":{"_index":"i","_type":"t"}}\n{"t":5}\n{"delete":{"_index":"i","_type":"t"}}\n{"x":1}\n{"index":{"_index":"i","_type":"t"}}\n{"trunc":'


def test_bulk(spark):
    b = parse_bulk(BULK)
    assert len(b.rows) == 2 and b.errors and b.rows[0][:3] == ("i", "t", "1")
    assert not parse_bulk('{"index":{}}\n{"a":1}\n', "i", "t").errors and parse_bulk('{"index":{}}\n{"a":1}\n').errors
    c = Catalog(spark)
    c.put_template("x", {"template": "i", "storage": {"timestamp_path": "t"}})
    d = {r["_id"]: r for r in bulk_documents(spark, c, b).collect()}
    assert len(d) == 2 and json.loads(d["1"]["_source"])["message"] == "a|b م \r\n {x}\n"
    assert next(r for k, r in d.items() if k != "1")["_timestamp"] == 5
    assert parse_bulk("").rows == [] and bulk_documents(spark, c, parse_bulk("")).count() == 0


def test_read_pairs(spark, tmp_path):
    lines = [x for i in range(500) for x in (json.dumps({"index": {"_index": "i", "_type": "t", "_id": str(i)}}), json.dumps({"n": i}))]
    (tmp_path / "a.ndjson").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.ndjson").write_text("\n".join(lines[:2]).replace('"0"', '"b"') + "\n")
    got = read_pairs(spark.read.text(str(tmp_path))).collect()
    assert {r["_id"]: json.loads(r["_source"])["n"] for r in got} == {**{str(i): i for i in range(500)}, "b": 0}


def test_writes(spark):
    old = rows(spark, [{"a": 1}, {"a": 2}]).withColumn("_index", F.lit("i"))
    new = rows(spark, [{"doc": {"b": 3}}, {"b": 4}, {"b": 5}]).withColumn("_index", F.lit("i"))
    src = lambda df: {r["_id"]: json.loads(r["_source"]) for r in df.collect()}
    assert src(writes.overwrite(old, new))["1"] == {"b": 4}
    assert src(writes.create(old, new)) == {"0": {"a": 1}, "1": {"a": 2}, "2": {"b": 5}}
    with pytest.raises(DocumentExists):
        writes.create(old, new, strict=True)
    assert src(writes.update(old, new)) == {"0": {"a": 1, "b": 3}, "1": {"a": 2, "b": 4}, "2": {"b": 5}}
    assert src(writes.update(old, new, unwrap=False))["0"] == {"a": 1, "doc": {"b": 3}}
    with pytest.raises(UpdateNotAllowed):
        writes.update(old, new, id_enabled=False)
    assert src(writes.delete(old, new.where("_id = '1'"))) == {"0": {"a": 1}}
    assert writes.delete_where(old, F.get_json_object("_source", "$.a") == "1").count() == 1
    twice = new.union(new)
    good, bad = writes.split_duplicates(old, twice, F.col("_timestamp"))
    assert good.count() == 1 and bad.count() == 5
    assert sorted(r["_id"] for r in writes.regenerate_duplicates(old, twice, F.col("_timestamp")).collect()) == ["2", "dup_1_0", "dup_1_1", "dup_1_2", "dup_2_0", "dup_2_1"]


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.names() == []
    d = rows(spark, [{"a": 1}, {"a": 2}, {"a": 3}]).withColumn("_index", F.lit("x:1"))
    s.append(d)
    s.create(d.withColumn("_source", F.lit('{"a":9}')))
    s.update(d.where("_id = '0'").withColumn("_source", F.lit('{"b":7}')))
    assert s.delete(d.where("_id = '1'")) == 1 and s.delete(d.where("_id = '1'")) == 0
    want = {"0": {"a": 1, "b": 7}, "2": {"a": 3}}
    for _ in range(2):
        assert s.names() == ["x:1"]
        assert {r["_id"]: json.loads(r["_source"]) for r in s.read(["x:1"]).collect()} == want
        s.compact("x:1")
    s.update(d.where("_id = '2'").withColumn("_source", F.lit('{"doc":{"b":1}}')).union(d.where("_id = '2'").withColumn("_source", F.lit('{"c":2}')).withColumn("_timestamp", F.col("_timestamp") + 1)))
    want["2"] |= {"b": 1, "c": 2}
    assert {r["_id"]: json.loads(r["_source"]) for r in s.read(["x:1"]).collect()} == want
    with pytest.raises(UpdateNotAllowed):
        s.update(d, id_enabled=False)
    plan = s.read(["x:1"]).where("_timestamp >= 5")._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert all("_index" in a for a, _ in scans) and any("GreaterThanOrEqual(_timestamp,5)" in b and "EqualTo(_seq,0)" in b for _, b in scans)
    c = Catalog(spark, s)
    assert c.documents(c.matching("X:*")).count() == 2
    s.drop("x:1")
    assert s.names() == []


def test_mapping(spark):
    d = rows(spark, [{"docField": "This is a test", "numField": 123, "objectField": {"nestedNumField": 124}, "listField": [{"nestedNumField2": 125}], "emptyField": "", "d": "2009-11-15T14:12:12", "ms": "1550503374995", "old": "1950-01-01", "f": 1.5, "b": True, "n": None, "word": "x"}, {"docField": 5, "late": 1, "old": "1950-01-01"}]).withColumn("_index", F.lit("i"))
    got = {r["field"]: (r["type"], r["format"]) for r in mapping.infer(d).collect()}
    assert got == {"docField": ("text", None), "numField": ("long", None), "objectField": ("object", None), "listField": ("nested", None), "emptyField": ("string", None), "d": ("date", "strict_date_optional_time"), "ms": ("date", "epoch_millis"), "f": ("double", None), "b": ("boolean", None), "n": ("object", None), "word": ("string", None), "late": ("long", None)}
    names = {r["field"] for r in mapping.field_names(d).collect()}
    assert {"docField", "emptyField", "numField", "objectField.nestedNumField", "listField.nestedNumField2"} <= names
    assert "listField[0].nestedNumField2" in {r["field"] for r in mapping.field_names(d, indexed=True).collect()}
    c = Catalog(spark)
    c.learn(mapping.infer(d))
    assert c.mapping(["i"])["d"] == {"type": "date", "format": "strict_date_optional_time"}
    assert mapping.infer(d.limit(0)).count() == 0 and mapping.sample(d, rows=1).count() == 1


DOC = {"bool": False, "string": "Hello there", "long": 23, "double": 2.4, "obj": {"bic": "EASYATW1", "iban": "AT12 4321"}, "list": [3, 4, 5, 6, 6, 4, 4, 2], "listObjects": [{"field": 77}, {"field": 78}], "no": None}


def test_stats(spark):
    d = rows(spark, [DOC] * 20).withColumn("_index", F.lit("i"))
    s = {r["field"]: r for r in stats.measure(d).collect()}
    pick = lambda f: tuple(s[f][c] for c in ("doc_count", "sum_doc_freq", "min_value", "max_value"))
    assert pick("list") == (20, 160, "2", "6") and pick("listObjects.field") == (20, 40, "77", "78")
    assert pick("string") == (20, 40, "Hello", "there") and pick("obj.iban")[:2] == (20, 40) and pick("obj.bic")[:2] == (20, 20) and pick("bool")[:2] == (20, 20)
    assert "no" not in s and s["double"]["sum_total_term_freq"] == 0 and s["long"]["sum_total_term_freq"] == -1
    half = {k: v for k, v in DOC.items() if k != "bool"}
    e = rows(spark, [DOC] * 5 + [half] * 5).withColumn("_index", F.lit("j"))
    both = stats.merge(stats.measure(d), stats.measure(e))
    docs = spark.createDataFrame([("i", 20), ("j", 10)], "_index string, max_doc long")
    rep = {(r["_index"], r["field"]): r for r in stats.report(both, docs).collect()}
    assert rep["j", "bool"]["density"] == 50 and rep["i", "bool"]["density"] == 100
    whole = {r["field"]: r for r in stats.report(both, docs, "cluster").collect()}
    assert whole["bool"]["doc_count"] == 25 and whole["bool"]["density"] == 83 and whole["long"]["sum_total_term_freq"] == -1


def test_stats_of_mixed_types(spark):
    d = rows(spark, [{"a": 5}, {"a": "x y"}, {"b": 1}, {"b": 2}, {"b": True}]).withColumn("_index", F.lit("i"))
    s = {r["field"]: r for r in stats.measure(d).collect()}
    assert (s["a"]["kind"], s["a"]["doc_count"], s["a"]["sum_doc_freq"], s["a"]["min_value"]) == ("String", 2, 3, "5")
    assert (s["b"]["kind"], s["b"]["doc_count"]) == ("Long", 2)


def test_stream(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store")
    src.mkdir()

    def put(name, *docs):
        (src / name).write_text("".join(json.dumps({"_index": "i", "_type": "t", "_id": k, "_source": json.dumps(v)}) + "\n" for k, v in docs))

    def run():
        q = S.ingest(S.read_documents(spark, str(src)), store, str(tmp_path / "cp"), "t", availableNow=True)
        q.awaitTermination()

    put("1.json", ("a", {"t": 5}), ("b", {"t": 61_000}))
    run()
    put("2.json", ("a", {"t": 9, "new": True}))
    run()
    got = {r["_id"]: r for r in store.read(["i"]).collect()}
    assert set(got) == {"a", "b"} and got["a"]["_timestamp"] == 9 and got["b"]["_bucket1m"] == 60_000


def test_stream_buckets(spark, tmp_path):
    df = spark.createDataFrame([(0,), (30,), (90,), (10_000,)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.bucket_counts(stream, "ts").writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["count"] for r in spark.table("buckets").orderBy("bucket").collect()][:2] == [2, 1]


def test_document_rows_without_path(spark):
    d = documents(spark.createDataFrame([("i", "t", None, FLAT)], "_index string, _type string, _id string, _source string"), flatten=True).first()
    assert d["_id"] and d["_timestamp"] > 1_600_000_000_000 and json.loads(d["_source"])["array_2"] == 102


def test_stats_read_each_document_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    d = rows(spark, [DOC] * 50).withColumn("_index", F.lit("i")).withColumn("_source", counted("_source"))
    assert {r["field"] for r in stats.measure(d).collect()} == {*DOC, "obj.bic", "obj.iban", "listObjects.field"} - {"obj", "listObjects", "no"}
    assert seen.value == 50
    assert mapping.field_names(d).count() == 9 and seen.value == 100


def test_stats_of_odd_documents(spark):
    deep = {"a": [[[[{"b": [{"c": {"d": {"e": [1, "x y"]}}}]}]]]], "a.b": 2, "z": {}, "y": []}
    d = rows(spark, [deep, {"a": {"b": 3}, "a.b": True}, {"a": {"b": [4, None]}}, "[1]", "{", {}]).withColumn("_index", F.lit("i"))
    part = lambda df: {r["field"]: tuple(r)[2:5] + tuple(r)[6:] for r in stats.measure(df).collect()}
    assert part(d) == {"a.b": ("Long", 3, 3, "2", "4"), "a.b.c.d.e": ("String", 1, 3, "1", "y")}
    assert {r["field"] for r in mapping.field_names(d, indexed=True).where("field like '%e[%'").collect()} == {"a[0][0][0][0].b[0].c.d.e[0]", "a[0][0][0][0].b[0].c.d.e[1]"}
    # Rows of one id are one document; those without an id are one of each type.
    assert part(d.union(d.where("_id in ('1', '2')"))) == {"a.b": ("Long", 3, 5, "2", "4"), "a.b.c.d.e": ("String", 1, 3, "1", "y")}
    assert part(d.withColumn("_id", F.lit(None).cast("string")))["a.b"] == ("Long", 1, 3, "2", "4")
    assert part(d.limit(0)) == {}
