"""Predicates on the phrase documents, by the counts they are known to give."""

import pytest
from lodestrata.plans.errors import SearchError, UnsupportedQuery
from lodestrata.plans.parse import parse_request
from lodestrata.plans.tree import Semantics

from .docs import engine_of

CASES = [
    ({"match_all": {}}, 13),
    ({"match": {"message": "the"}}, 10),
    ({"match": {"message": "fox"}}, 6),
    ({"match": {"message": "fox dog"}}, 9),
    ({"match": {"message": {"query": "fox dog", "operator": "and"}}}, 3),
    ({"match": {"message": {"query": "quick brown", "type": "phrase"}}}, 2),
    ({"match_phrase": {"message": "quick brown"}}, 2),
    ({"match_phrase": {"message": "the lazy"}}, 3),
    ({"match_phrase_prefix": {"message": "the "}}, 10),
    ({"match_phrase_prefix": {"message": "the qu"}}, 3),
    ({"match_phrase_prefix": {"message": "the quie"}}, 1),
    ({"bool": {"must": [{"match_phrase": {"message": "quick brown"}}]}}, 2),
    ({"bool": {"must_not": [{"match_phrase": {"message": "quick brown"}}]}}, 8),
    ({"bool": {"must": [{"match_phrase": {"message": "quick brown"}}], "must_not": [{"match": {"message": "jumps"}}]}}, 1),
    ({"bool": {"must": {"match": {"message": "fox"}}, "should": [{"query_string": {"query": "message:jumps"}}]}}, 4),
    ({"bool": {"must": [{"match_all": {}}]}}, 13),
    ({"bool": {}}, 13),
    ({"bool": {"should": [{"match": {"message": "fox"}}, {"match": {"message": "lazy"}}, {"match": {"message": "quick"}}], "minimum_should_match": 2}}, 4),
    ({"bool": {"should": [{"match": {"message": "fox"}}, {"match": {"message": "lazy"}}, {"match": {"message": "quick"}}], "minimum_should_match": "100%"}}, 1),
    ({"regexp": {"message": ".*lazy.*"}}, 3),
    ({"regexp": {"message": "the.*"}}, 0),
    ({"regexp": {"message": {"value": "[Tt]he.*"}}}, 10),
    ({"wildcard": {"message": "The * jumps"}}, 2),
    ({"wildcard": {"status": {"value": "f??ling"}}}, 2),
    ({"prefix": {"message": {"value": "The q"}}}, 3),
    ({"prefix": {"message": "the q"}}, 0),
    ({"exists": {"field": "message"}}, 10),
    ({"exists": {"field": "unknown"}}, 0),
    ({"dis_max": {"queries": [{"term": {"status": "ok"}}, {"match": {"message": "underdog"}}]}}, 2),
    ({"bool": {"must": [{"term": {"status": "ok"}}, {"dis_max": {"queries": [{"match": {"message": "fox"}}, {"term": {"status": "ok"}}]}}]}}, 1),
    ({"filtered": {"query": {"match": {"message": "fox"}}, "filter": {"match": {"message": "jumps"}}}}, 4),
    ({"filtered": {}}, 13),
    ({"query": {"term": {"status": "ok"}}}, 1),
    ({"ids": {"values": ["1", 2], "type": "t"}}, 2),
    ({"ids": {"values": ["1"], "type": ["u"]}}, 0),
    ({"ids": {"values": []}}, 0),
    ({"type": {"value": "t"}}, 13),
    ({"query_string": {"query": "fox", "default_field": "message"}}, 6),
    ({"query_string": {"query": '"fox jumps"', "default_field": "message"}}, 4),
    ({"query_string": {"query": "fox jumps", "default_field": "message"}}, 7),
    ({"query_string": {"query": "fox jumps", "default_field": "message", "default_operator": "AND"}}, 4),
    ({"query_string": {"query": "message:(fox AND jumps) OR status:ok"}}, 5),
    ({"query_string": {"query": "*"}}, 13),
    ({"query_string": {"query": "()"}}, 13),
    ({"query_string": {"query": "f*ling", "default_field": "status"}}, 2),
    ({"query_string": {"query": "f??ling", "default_field": "status"}}, 2),
    ({"query_string": {"query": "f?ling", "default_field": "status"}}, 0),
    ({"query_string": {"query": "f*ling the", "fields": ["status", "message"]}}, 12),
]


@pytest.fixture(scope="module", params=[False, True], ids=["json", "variant"])
def engine(spark, request):
    return engine_of(spark, variant=request.param)


@pytest.mark.parametrize("query, count", CASES, ids=[str(i) for i in range(len(CASES))])
def test_counts(engine, query, count):
    assert engine.search("docs", {"query": query}).total.first()[0] == count


def test_no_body(spark):
    assert engine_of(spark).search("docs").total.first()[0] == 13


def test_ranges(spark):
    e = engine_of(spark, sources=[{"value": i} for i in range(10)])
    count = lambda **b: e.search("docs", {"query": {"range": {"value": b}}}).total.first()[0]
    assert (count(gte=1, lte=8), count(gt=1, lt=8), count(gte="8.5"), count()) == (8, 6, 1, 10)


def test_must_not_modes(spark):
    q = {"query": {"bool": {"must_not": [{"match": {"message": "fox"}}, {"match": {"message": "jumps"}}]}}}
    assert engine_of(spark).search("docs", q).total.first()[0] == 6
    assert engine_of(spark, semantics=Semantics(must_not="any")).search("docs", q).total.first()[0] == 3


def test_exists_with_null_and_literal_keys(spark):
    e = engine_of(spark, sources=[{"a": None}, {"a.b": 1}, {"a": {"b": 2}}, {"it's": "x"}])
    n = lambda f: e.search("docs", {"query": {"exists": {"field": f}}}).total.first()[0]
    assert (n("a"), n("a.b"), n("it's")) == (2, 1, 1)
    assert e.search("docs", {"query": {"term": {"a.b": 1}}}).total.first()[0] == 1


def test_scalars_are_text(spark):
    e = engine_of(spark, sources=[{"n": 5}, {"n": "5"}, {"n": True}])
    assert e.search("docs", {"query": {"term": {"n": 5}}}).total.first()[0] == 2
    assert e.search("docs", {"query": {"term": {"n": {"value": True}}}}).total.first()[0] == 1


def test_injection_is_text(spark):
    e = engine_of(spark, sources=[{"n": "x' OR '1'='1"}, {"n": "y"}])
    assert e.search("docs", {"query": {"term": {"n": "x' OR '1'='1"}}}).total.first()[0] == 1
    assert e.search("docs", {"query": {"match": {"n": "\\"}}}).total.first()[0] == 0


@pytest.mark.parametrize("kind", ["terms", "fuzzy", "nested", "geo_distance", "multi_match", "constant_score"])
def test_unknown_kinds(kind):
    with pytest.raises(UnsupportedQuery):
        parse_request({"query": {kind: {"a": "b"}}})


@pytest.mark.parametrize("text", ["(a", "a AND", "a )", "OR a", ""])
def test_bad_query_strings(text):
    if text:
        with pytest.raises(SearchError):
            parse_request({"query": {"query_string": {"query": text, "default_field": "f"}}})
    else:
        parse_request({"query": {"query_string": {"query": text}}})


def test_filters_reach_the_scan(spark, sf):
    from lodestrata.search.engine import Engine

    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    r = Engine(spark).table(df, {"query": {"bool": {"filter": [{"range": {"l_quantity": {"gte": 5}}}, {"term": {"l_returnflag": "R"}}, {"range": {"l_shipdate": {"gte": "1995-01-01"}}}]}}, "aggs": {"s": {"sum": {"field": "l_tax"}}}})
    plan = r.frame()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,5.0)" in plan and "EqualTo(l_returnflag,R)" in plan and "GreaterThanOrEqual(l_shipdate" in plan
    read = plan.split("ReadSchema: ")[1]
    assert "l_comment" not in read and "l_extendedprice" not in read.split(">")[0]
