"""Hits, sorting, paging, targets and templates."""

import json

import pytest
from lodestrata.plans.errors import InvalidFieldType, NoSuchMapping
from lodestrata.search.engine import Engine
from lodestrata.sources.catalog import Catalog, Storage, expand

from .docs import engine_of, rows


def ids(df):
    return [r["_id"] for r in df.collect()]


def test_size_and_from(spark):
    e = engine_of(spark, sources=[{"message": f"This is sample message {i}"} for i in range(100)])
    d = e.search("docs", {"query": {"match_all": {}}}).to_dict()
    assert d["hits"]["total"] == 100 and len(d["hits"]["hits"]) == 10 and d["hits"]["max_score"] == 1.0
    assert set(d["hits"]["hits"][0]) == {"_index", "_type", "_id", "_score", "_source"}
    assert len(e.search("docs", {"size": 100}).to_dict()["hits"]["hits"]) == 100
    d = e.search("docs", {"size": 0}).to_dict()
    assert d["hits"]["total"] == 100 and d["hits"]["hits"] == [] and d["hits"]["max_score"] is None
    assert e.search("docs", {"size": "x", "from": "y"}).request.size == 10
    assert e.search("docs", {"query": {"term": {"message": "This is sample message 7"}}}).total.first()[0] == 1
    page = e.search("docs", {"sort": ["_id"], "from": 2, "size": 3}).hits
    assert ids(page) == sorted(map(str, range(100)))[2:5]


@pytest.mark.parametrize("variant", [False, True])
def test_sort_by_kind_number_text(spark, variant):
    e = engine_of(spark, sources=[{"v": 10}, {"v": 9}, {"v": "b"}, {"v": None}, {}, {"v": True}, {"v": [1]}, {"v": {"x": 1}}, {"v": "a"}], variant=variant)
    assert ids(e.search("docs", {"sort": ["v"], "size": 20}).hits) == ["3", "8", "2", "1", "0", "5", "6", "7", "4"]
    assert ids(e.search("docs", {"sort": [{"v": {"order": "desc"}}], "size": 20}).hits)[0] == "4"


def test_blank_at_the_end_of_a_match(spark):
    e = engine_of(spark, sources=[{"m": "alpha beta"}, {"m": "gamma"}])
    for text, n in (("alpha ", 1), ("alpha  ", 1), ("alpha gamma ", 2)):
        assert e.search("docs", {"query": {"match": {"m": text}}}).total.first()[0] == n


def test_range_buckets_of_dates(spark):
    df = spark.sql("select timestamp'2024-01-01' t union all select timestamp'2024-01-03' union all select timestamp'2024-02-01'")
    aggs = {"r": {"range": {"field": "t", "ranges": [{"to": "2024-01-02"}, {"from": "2024-01-02", "to": "2024-02-01"}, {"from": "2024-02-01"}]}}}
    r = Engine(spark).table(df, {"size": 0, "aggs": aggs}).to_dict()
    assert [b["doc_count"] for b in r["aggregations"]["r"]["buckets"]] == [1, 1, 1]


def test_targets(spark):
    e = engine_of(spark, "message-logs-2018-03-15t23:00:00")
    for n in ("message-logs-2018-03-16t00:00:00", "message-logs-2018-03-16t01:00:00"):
        e.catalog.register(n, rows(spark, [{"message": "x"}], kind="u"))
    assert len(e.catalog.matching("message-logs-*")) == 3
    assert len(e.catalog.matching("MESSAGE-logs-2018-03-16*")) == 2
    assert e.catalog.matching("nothing") == [] and len(e.catalog.matching("_all")) == 3
    assert e.search("message-logs-*").total.first()[0] == 15
    assert e.search("message-logs-*", types="u").total.first()[0] == 2
    assert e.search("none", {"aggs": {"n": {"sum": {"field": "x"}}}}).to_dict()["aggregations"] == {"n": {"value": None}}
    assert expand("a.b*", ["a.bc", "axbc"]) == ["a.bc"]


def test_get_and_mget(spark):
    e = engine_of(spark)
    assert e.exists("docs", "t", "3") and not e.exists("docs", "t", "99") and not e.exists("none", "t", "1")
    got = e.mget([{"_id": "1"}, {"_id": 2, "_type": "t"}, {"_id": "77"}, {"_id": "3", "_type": "u"}], index="docs")
    assert sorted(ids(got)) == ["1", "2"]


def test_msearch(spark):
    e = engine_of(spark)
    body = '{"index":"docs"}\n{"query":{"match":{"message":"fox"}},"size":1}\n{}\n{"size":0}\n'
    d = e.answer(e.msearch(body))
    assert [r["hits"]["total"] for r in d["responses"]] == [6, 13]
    with pytest.raises(ValueError):
        e.msearch('{"index":"docs"}\n')


def test_templates(spark):
    c = Catalog(spark)
    c.put_template("a", {"template": "logs-*", "storage": {"timestamp_path": "t", "unknown": 1}, "mappings": {"k": {"properties": {"d": {"type": "date"}}}}})
    assert c.template_for("logs-1").storage == Storage(timestamp_path="t")
    assert c.template_for("Logs-1") is None and c.common_template(["logs-1", "logs-2"]).name == "a"
    assert c.common_template(["logs-1", "other"]) is None and c.common_template([]) is None
    c.put_mapping("logs-1", "k", {"n": {"type": "long"}})
    c.put_mapping("logs-1", "k", {"n": {"index": "no"}})
    assert c.seeded("logs-1") == {"k": {"d": {"type": "date"}, "n": {"type": "long", "index": "no"}}}
    d = Catalog(spark)
    d.load(c.dump())
    assert d.seeded("logs-1") == c.seeded("logs-1")
    c.register("logs-1", rows(spark, [{"n": 1}]))
    assert c.get_mapping("logs-*", "k", "n")["logs-1"]["mappings"]["k"]["properties"] == {"n": {"type": "long", "index": "no"}}
    assert c.field_capabilities()["fields"]["n"]["long"]["searchable"]


def aggregated(spark, request, sources, **kw):
    return engine_of(spark, sources=sources, **kw).search("docs", request | {"size": 0}).to_dict()["aggregations"]


VALUES = [{"v": (i * 37) % 100, "t": 86_400_000 * (i % 4) + i, "k": "ab"[i % 2]} for i in range(100)]


def test_metrics(spark):
    kinds = ("avg", "sum", "min", "max", "value_count", "cardinality", "stats", "percentiles")
    a = aggregated(spark, {"aggs": {k: {k: {"field": "v"}} for k in kinds}}, VALUES)
    assert [a[k]["value"] for k in kinds[:6]] == [49.5, 4950.0, 0.0, 99.0, 100, 100]
    assert a["stats"] == {"avg": 49.5, "min": 0.0, "max": 99.0, "sum": 4950.0, "count": 100}
    assert a["percentiles"]["values"]["50.0"] == 49.0 and set(a["percentiles"]["values"]) == {"1.0", "5.0", "25.0", "50.0", "75.0", "95.0", "99.0"}


def test_metric_errors(spark):
    from lodestrata.plans.errors import SearchError, UnsupportedAggregation
    from lodestrata.plans.parse import parse_request
    from lodestrata.plans.tree import Semantics

    with pytest.raises(SearchError):
        parse_request({"aggs": {"a": {"avg": {"field": "v"}, "aggs": {"b": {"avg": {"field": "v"}}}}}})
    for kind in ("top_hits", "geo_bounds", "significant_terms", "scripted_metric"):
        with pytest.raises(UnsupportedAggregation):
            parse_request({"aggs": {"a": {kind: {"field": "v"}}}})
    bad = [{"v": "x"}, {"v": 2}]
    with pytest.raises(Exception, match="CAST|cast"):
        aggregated(spark, {"aggs": {"s": {"sum": {"field": "v"}}}}, bad)
    assert aggregated(spark, {"aggs": {"s": {"sum": {"field": "v"}}}}, bad, semantics=Semantics(lenient=True))["s"]["value"] == 2.0


def test_buckets(spark):
    a = aggregated(
        spark,
        {
            "aggs": {
                "days": {"date_histogram": {"field": "t", "interval": "day"}, "aggs": {"kinds": {"terms": {"field": "k"}, "aggs": {"s": {"sum": {"field": "v"}}}}}},
                "r": {"range": {"field": "v", "ranges": [{"to": 10}, {"from": 5, "to": 20}, {"from": 500}, {"to": 10}]}, "aggs": {"m": {"max": {"field": "v"}}}},
                "f": {"filters": {"filters": {"low": {"range": {"v": {"lt": 3}}}, "none": {"term": {"k": "z"}}}}},
                "x": {"missing": {"field": "nope"}},
            }
        },
        VALUES,
    )
    assert [b["key"] for b in a["days"]["buckets"]] == [86_400_000 * i for i in range(4)]
    assert [b["doc_count"] for b in a["days"]["buckets"]] == [25] * 4
    assert sum(k["s"]["value"] for b in a["days"]["buckets"] for k in b["kinds"]["buckets"]) == 4950
    assert [b["doc_count"] for b in a["r"]["buckets"]] == [10, 15, 0] and a["r"]["buckets"][1]["m"]["value"] == 19
    assert a["r"]["buckets"][1]["from"] == 5 and "to" not in a["r"]["buckets"][2]
    assert a["f"]["buckets"]["low"]["doc_count"] == 3 and a["f"]["buckets"]["none"]["doc_count"] == 0
    assert a["x"]["doc_count"] == 100
    none = aggregated(spark, {"query": {"term": {"k": "z"}}, "aggs": {"r": {"range": {"field": "v", "ranges": [{"to": 1}]}}, "d": {"date_histogram": {"field": "t", "interval": "day"}}}}, VALUES)
    assert none == {"r": {"buckets": []}, "d": {"buckets": []}}


def test_range_bucket_inside_histogram(spark):
    a = aggregated(spark, {"aggs": {"d": {"date_histogram": {"field": "t", "interval": "day"}, "aggs": {"r": {"range": {"field": "v", "ranges": [{"to": 50}, {"from": 1000}]}}}}}}, VALUES)
    for b in a["d"]["buckets"]:
        assert b["r"]["buckets"][1]["doc_count"] == 0 and 0 < b["r"]["buckets"][0]["doc_count"] < 25


def test_histogram_needs_a_mapping(spark):
    e = engine_of(spark, sources=VALUES)
    e.catalog.put_mapping("docs", "t", {"v": {"type": "text"}, "t": {"type": "long"}})
    agg = lambda f: {"size": 0, "aggs": {"d": {"date_histogram": {"field": f, "interval": "1d"}}}}
    assert len(e.search("docs", agg("t")).to_dict()["aggregations"]["d"]["buckets"]) == 4
    with pytest.raises(NoSuchMapping):
        e.search("docs", agg("nope")).frames  # noqa: B018
    with pytest.raises(InvalidFieldType):
        e.search("docs", agg("v")).frames  # noqa: B018


def test_intervals():
    from lodestrata.search.aggregate import interval_millis

    assert [interval_millis(x) for x in ("year", "quarter", "week", "day", "hour", "2h", "5m", "30s", "1w", "100ms", "x")] == [365 * 86_400_000, *[86_400_000] * 3, 3_600_000, 7_200_000, 300_000, 30_000, 1000, 1000, 1000]


def test_table_hits(spark, sf):
    d = Engine(spark).table(spark.read.parquet(f"{sf}/nation.parquet"), json.dumps({"query": {"term": {"n_regionkey": 1}}, "size": 2})).to_dict()
    assert d["hits"]["total"] == 5 and len(d["hits"]["hits"]) == 2 and "n_name" in d["hits"]["hits"][0]["_source"]


def test_sort_keys_are_worked_out_once(spark):
    e = engine_of(spark, sources=[{"v": v} for v in (2, "b", None, 10, "a")])
    found = e.search("docs", {"sort": [{"v": "desc"}, "_id"], "size": 10})
    for df in (found.ordered, found.hits):
        assert ids(df) == ["3", "0", "1", "4", "2"]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        orders = [x for x in plan.splitlines() if "Sort [" in x]
        assert orders and not any("json" in x or "variant" in x or "CASE" in x for x in orders)
    own = spark.createDataFrame([(1, 9), (2, 8)], "a long, __key0 long")
    assert [tuple(r) for r in Engine(spark).table(own, {"sort": ["__key0"], "size": 5}).hits.collect()] == [(2, 8), (1, 9)]
