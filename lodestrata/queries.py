"""The engine's own queries over the driver's tables, and their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fields import Fields
from .functions.json import flatten_json, shard_offset, timestamp_of, with_buckets
from .operators import mapping, stats, writes
from .operators.place import placed, shared_dir
from .plans.parse import parse_query
from .plans.tree import Semantics
from .search.compile import Compiler
from .search.engine import Engine
from .sources.catalog import COLUMNS, Catalog
from .sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(name: str, request: dict, *columns: str, sql: str | None = None, semantics: Semantics = Semantics()):
    """Registers under a name the rows of a table that a request matches."""

    def of(qname: str):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return Engine(spark, semantics=semantics).table(table(spark, sf_dir, name), request).matched.select(*columns)

        QUERIES[qname] = run
        ORACLES[qname] = sql if sql and sql.lstrip().startswith(("select", "with")) else f"select {', '.join(columns)} from {name} where {sql}"

    return of


def q(kind: str, **body) -> dict:
    return {"query": {kind: body}}


# -- predicates -----------------------------------------------------------------

on("events", q("term", event_type="click"), "event_id", "value", sql="event_type = 'click'")("q_term")
on("lineitem", q("term", l_linenumber=3), "l_orderkey", "l_partkey", "l_quantity", sql="l_linenumber = 3")("q_term_number")
on("part", q("prefix", p_type="PROMO"), "p_partkey", "p_type", sql="starts_with(p_type, 'PROMO')")("q_prefix")
on("part", q("wildcard", p_name="*e?*n*"), "p_partkey", "p_name", sql="p_name like '%e_%n%'")("q_wildcard")
on("part", q("regexp", p_brand="Brand#[1-3]{1,2}"), "p_partkey", "p_brand", sql="regexp_full_match(p_brand, 'Brand#[1-3]{1,2}')")("q_regexp")
on("documents", q("match", text="thereat tioneron"), "doc_id", sql="text ilike '%thereat%' or text ilike '%tioneron%'")("q_match_or")
on("documents", q("match", text={"query": "eron tion", "operator": "and"}), "doc_id", sql="text ilike '%eron%' and text ilike '%tion%'")("q_match_and")
on("documents", q("match_phrase", text="of the"), "doc_id", sql="text ilike '%of the%'")("q_match_phrase")
on("documents", q("match_phrase_prefix", text="the th"), "doc_id", sql="text ilike 'the th%'")("q_phrase_prefix")
on("documents", q("query_string", query='(eron AND tion) OR "of the"', default_field="text"), "doc_id", sql="(text ilike '%eron%' and text ilike '%tion%') or text ilike '%of the%'")("q_query_string")
on("documents", q("query_string", query="source:src1? AND th*ng", default_field="text"), "doc_id", "source", sql="source ilike '%src1_%' and text ilike '%th%ng%'")("q_query_string_wild")
on("documents", q("query_string", query="es AND e OR src19", fields=["lang", "source"]), "doc_id", sql="(lang ilike '%es%' and lang ilike '%e%') or lang ilike '%src19%' or (source ilike '%es%' and source ilike '%e%') or source ilike '%src19%'")("q_query_string_fields")
on("lineitem", q("range", l_quantity={"gte": 10, "lt": 24}), "l_orderkey", "l_linenumber", "l_quantity", sql="l_quantity >= 10 and l_quantity < 24")("q_range")
on("lineitem", q("range", l_shipdate={"gt": "1995-03-15", "lte": "1996-03-15"}), "l_orderkey", "l_linenumber", sql="l_shipdate > timestamp '1995-03-15' and l_shipdate <= timestamp '1996-03-15'")("q_range_date")
on("events", {"query": {"bool": {"must": [{"match": {"event_type": "p"}}], "filter": {"range": {"value": {"lt": 80}}}, "must_not": [{"term": {"user_id": 7}}], "should": [{"range": {"value": {"gte": 20}}}, {"term": {"event_type": "view"}}]}}}, "event_id", "event_type", "value", sql="event_type ilike '%p%' and value < 80 and not (user_id = 7) and (value >= 20 or event_type = 'view')")("q_bool_full")
on("events", {"query": {"bool": {"must_not": [{"term": {"event_type": "click"}}, {"range": {"value": {"gte": 50}}}]}}}, "event_id", sql="not (event_type = 'click' and value >= 50)")("q_bool_must_not_all")
on("events", {"query": {"bool": {"must_not": [{"term": {"event_type": "click"}}, {"range": {"value": {"gte": 50}}}]}}}, "event_id", sql="not event_type = 'click' and not value >= 50", semantics=Semantics(must_not="any"))("q_bool_must_not_any")
on("events", {"query": {"bool": {"should": [{"term": {"event_type": "click"}}, {"range": {"value": {"gte": 50}}}, {"range": {"user_id": {"lt": 100}}}], "minimum_should_match": "2"}}}, "event_id", sql="(event_type = 'click')::int + (value >= 50)::int + (user_id < 100)::int >= 2")("q_bool_min_should")
on("events", {"query": {"bool": {"should": [{"term": {"event_type": "click"}}, {"range": {"value": {"gte": 50}}}, {"range": {"user_id": {"lt": 100}}}], "minimum_should_match": "-34%"}}}, "event_id", sql="(event_type = 'click')::int + (value >= 50)::int + (user_id < 100)::int >= 2")("q_bool_min_should_percent")
on("events", {"query": {"dis_max": {"queries": [{"term": {"event_type": "error"}}, {"range": {"value": {"gt": 200}}}]}}}, "event_id", sql="event_type = 'error' or value > 200")("q_dis_max")
on("events", {"query": {"filtered": {"query": {"match_all": {}}, "filter": {"range": {"value": {"lt": 10}}}}}}, "event_id", sql="value < 10")("q_filtered")
on("documents", {"query": {"query": {"match": {"text": {"query": "AND the", "type": "phrase"}}}}}, "doc_id", sql="text ilike '%and the%'")("q_match_type_phrase")
on("orders", q("exists", field="o_orderstatus"), "o_orderkey", sql="o_orderstatus is not null")("q_exists_typed")


@query("select count(*) total from lineitem")
def q_match_all_count(spark, sf_dir):
    return Engine(spark).table(table(spark, sf_dir, "lineitem"), {"query": {"match_all": {}}, "size": 0}).total


# -- document tables --------------------------------------------------------------


def event_rows(spark: SparkSession, sf_dir: str, index: str = "events") -> DataFrame:
    """Events as documents: their properties in JSON are the source; ``k`` is null for errors and missing for views."""
    e = table(spark, sf_dir, "events")
    source = F.when(F.col("event_type") == "error", F.lit('{"k": null, "w": "x y"}')).when(F.col("event_type") == "view", F.lit('{"w": "x z"}')).otherwise(F.col("props"))
    d = e.select(F.lit(index).alias("_index"), F.col("event_type").alias("_type"), F.col("event_id").cast("string").alias("_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("_timestamp"), source.alias("_source"))
    return with_buckets(d)


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    source = F.to_json(F.struct("o_custkey", "o_totalprice", "o_orderstatus"))
    d = o.select(F.lit("orders").alias("_index"), F.col("o_orderpriority").alias("_type"), F.col("o_orderkey").cast("string").alias("_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("_timestamp"), source.alias("_source"))
    return with_buckets(d)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    c = Catalog(spark)
    c.register("events", event_rows(spark, sf_dir))
    c.register("orders", order_rows(spark, sf_dir))
    return Engine(spark, c)


EVENTS = "(select event_id, event_type, ts, case event_type when 'error' then '{\"k\": null, \"w\": \"x y\"}' when 'view' then '{\"w\": \"x z\"}' else props end src from events)"


@query(f"select event_id::varchar _id from {EVENTS} where list_contains(json_keys(src), 'k')")
def q_exists_json(spark, sf_dir):
    return engine(spark, sf_dir).search("events", q("exists", field="k")).matched.select("_id")


@query(f"select event_id::varchar _id, src::json->>'k' k from {EVENTS} where src::json->>'k' = '42'")
def q_term_json(spark, sf_dir):
    return engine(spark, sf_dir).search("events", q("term", k=42)).matched.select("_id", F.get_json_object("_source", "$.k").alias("k"))


@query(f"select event_id::varchar _id from {EVENTS} where not (src::json->>'k' = '42')")
def q_missing_field_not(spark, sf_dir):
    return engine(spark, sf_dir).search("events", {"query": {"bool": {"must_not": {"term": {"k": "42"}}}}}).matched.select("_id")


@query(f"select event_id::varchar _id from {EVENTS} where (src::json->>'k')::decimal(38,10) >= 10.5 and (src::json->>'k')::decimal(38,10) < 20")
def q_range_json(spark, sf_dir):
    return engine(spark, sf_dir).search("events", q("range", k={"gte": 10.5, "lt": 20})).matched.select("_id")


@query("select o_orderkey::varchar _id, o_orderpriority _type from orders where o_orderkey in (1, 7, 32, 100, 999999999)")
def q_ids(spark, sf_dir):
    return engine(spark, sf_dir).search("orders", q("ids", values=["1", 7, "32", "100", "999999999"])).matched.select("_id", "_type")


@query("select event_id::varchar _id from events where event_type = 'purchase'")
def q_type(spark, sf_dir):
    return engine(spark, sf_dir).search("events", q("type", value="purchase")).matched.select("_id")


@query("select event_id::varchar _id from events where event_type in ('view', 'error')")
def q_type_filter(spark, sf_dir):
    return engine(spark, sf_dir).search("events", None, types="view,error").matched.select("_id")


@query("select _index, count(*) n from (select 'events' _index from events union all select 'orders' from orders) group by 1")
def index_union(spark, sf_dir):
    return engine(spark, sf_dir).search("ev*,ORDERS").matched.groupBy("_index").agg(F.count("*").alias("n"))


@query("""select event_id::varchar _id, case when event_id % 50 = 7 then 'signup' else event_type end _type from events
          where epoch_ms(ts) >= 1704500000000 and event_id % 50 <> 9""")
def stored_search(spark, sf_dir):
    """A stored index: written, compacted, then some documents replaced and others deleted, then searched by time."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    docs = engine(spark, sf_dir).search("events").matched.select(*COLUMNS)
    store.append(docs)
    store.compact("events")
    n = F.col("_id").cast("long") % 50
    store.delete(docs.where((n == 9) | (n == 7)))
    store.append(docs.where(n == 7).withColumn("_type", F.lit("signup")))
    found = Engine(spark, Catalog(spark, store)).search("ev*", {"query": {"range": {"_timestamp": {"gte": 1704500000000}}}})
    return found.matched.select("_id", "_type")


@query("select 0::bigint total")
def empty_scan(spark, sf_dir):
    return engine(spark, sf_dir).search("nothing-*", {"query": {"term": {"k": "1"}}}).total


@query("select _index, _id from (select 'events' _index, event_id::varchar _id from events where event_id in (3, 5, 8) union all select 'orders', o_orderkey::varchar from orders where o_orderkey in (1, 2))")
def mget(spark, sf_dir):
    wanted = [{"_index": "events", "_id": 3}, {"_index": "events", "_id": 5}, {"_index": "events", "_id": 8}, {"_index": "orders", "_id": 1}, {"_index": "orders", "_id": 2}, {"_index": "orders", "_id": -1}, {"_index": "none", "_id": 1}]
    return engine(spark, sf_dir).mget(wanted).select("_index", "_id")


@query("select event_id::varchar _id, event_type _type from events where event_id = 11")
def get(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id = 11").select("event_type")
    d = engine(spark, sf_dir)
    return d.get("events", e.first()[0], "11").select("_id", "_type")


@query("select 0 search, count(*) total from events where event_type = 'click' union all select 1, count(*) from orders union all select 2, count(*) from (select event_id from events union all select o_orderkey from orders)")
def msearch(spark, sf_dir):
    body = '{"index": "events", "type": "click"}\n{"query": {"match_all": {}}}\n{"index": ["orders"]}\n{}\n{}\n{"size": 0}\n'
    parts = [r.total.select(F.lit(i).alias("search"), "total") for i, r in enumerate(engine(spark, sf_dir).msearch(body))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- hits -------------------------------------------------------------------------


@query("select o_orderkey, o_orderpriority, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 25 offset 50")
def q_sort_from_size(spark, sf_dir):
    request = {"query": {"term": {"o_orderstatus": "F"}}, "sort": [{"o_totalprice": "desc"}, {"o_orderkey": {"order": "asc"}}], "from": 50, "size": 25}
    return Engine(spark).table(table(spark, sf_dir, "orders"), request).hits.select("o_orderkey", "o_orderpriority", "o_totalprice")


def sorted_nulls(name: str, first: str, second: str, sql: str):
    def run(spark, sf_dir):
        o = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s"))
        return placed(Engine(spark).table(o, {"sort": [{"s": first}, {"o_orderkey": second}], "size": 10}).ordered)

    QUERIES[name], ORACLES[name] = run, f"select o_orderkey, nullif(o_orderstatus, 'O') s, row_number() over (order by {sql}) place from orders"


sorted_nulls("q_sort_nulls_last", "asc", "desc", "s asc nulls last, o_orderkey desc")
sorted_nulls("q_sort_nulls_first", "desc", "asc", "s desc nulls first, o_orderkey asc")


@query(f"select event_id::varchar _id, row_number() over (order by case when not list_contains(json_keys(src), 'k') then null when src::json->>'k' is null then 0 else 2 end desc nulls first, (src::json->>'k')::double desc nulls first, event_id::varchar) place from {EVENTS}")
def q_sort_json(spark, sf_dir):
    return placed(engine(spark, sf_dir).search("events", {"sort": [{"k": "desc"}, "_id"], "size": 10}).ordered.select("_id"))


@query("select event_id::varchar _id, 1.0::double _score from events where event_type = 'signup'")
def q_hits(spark, sf_dir):
    r = engine(spark, sf_dir).search("events", {"query": {"type": {"value": "signup"}}, "size": 1_000_000_000})
    return r.hits.select("_id", F.lit(1.0).alias("_score"))


# -- aggregations -------------------------------------------------------------------

LINES = {"query": {"range": {"l_quantity": {"lt": 30}}}, "size": 0}
LSQL = "from lineitem where l_quantity < 30"


def metric(name: str, kind: str, field: str, sql: str, digits: int | None = 2):
    def run(spark, sf_dir):
        out = Engine(spark).table(table(spark, sf_dir, "lineitem"), LINES | {"aggs": {"v": {kind: {"field": field}}}}).frame()
        return out.select((F.round("v", digits) if digits is not None else F.col("v")).alias("value"))

    QUERIES[name], ORACLES[name] = run, f"select {sql} as value {LSQL}"


metric("a_avg", "avg", "l_extendedprice", "round(avg(l_extendedprice), 2)")
metric("a_sum", "sum", "l_quantity", "round(sum(l_quantity), 2)")
metric("a_min", "min", "l_extendedprice", "round(min(l_extendedprice), 2)")
metric("a_max", "max", "l_extendedprice", "round(max(l_extendedprice), 2)")
metric("a_value_count", "value_count", "l_returnflag", "count(l_returnflag)", None)
metric("a_cardinality", "cardinality", "l_partkey", "count(distinct l_partkey)", None)


@query(f"select round(avg(l_tax), 6) v_avg, min(l_tax) v_min, max(l_tax) v_max, round(sum(l_tax), 4) v_sum, count(l_tax) v_count {LSQL}")
def a_stats(spark, sf_dir):
    f = Engine(spark).table(table(spark, sf_dir, "lineitem"), LINES | {"aggs": {"v": {"stats": {"field": "l_tax"}}}}).frame()
    return f.select(F.round("`v.avg`", 6).alias("v_avg"), F.col("`v.min`").alias("v_min"), F.col("`v.max`").alias("v_max"), F.round("`v.sum`", 4).alias("v_sum"), F.col("`v.count`").alias("v_count"))


@query(f"select round(sum(l_tax * l_tax), 4) sum_of_squares, round(var_pop(l_tax), 8) variance, round(stddev_pop(l_tax), 8) std_deviation {LSQL}")
def a_extended_stats(spark, sf_dir):
    f = Engine(spark).table(table(spark, sf_dir, "lineitem"), LINES | {"aggs": {"v": {"extended_stats": {"field": "l_tax"}}}}).frame()
    return f.select(F.round("`v.sum_of_squares`", 4).alias("sum_of_squares"), F.round("`v.variance`", 8).alias("variance"), F.round("`v.std_deviation`", 8).alias("std_deviation"))


PERCENTS = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)


@query(" union all ".join(f"select {p} percent, (select quantile_disc(l_extendedprice, {p / 100}) {LSQL}) as value" for p in PERCENTS))
def a_percentiles(spark, sf_dir):
    f = Engine(spark).table(table(spark, sf_dir, "lineitem"), LINES | {"aggs": {"v": {"percentiles": {"field": "l_extendedprice"}}}}).frame()
    return f.select(F.expr(f"stack({len(PERCENTS)}, {', '.join(f'{p!r}D, `v.{p!r}`' for p in PERCENTS)}) as (percent, value)")).select(F.col("percent").cast("decimal(3,1)").alias("percent"), "value")


RANGES = [{"to": 10}, {"from": 5, "to": 25}, {"from": 25}, {"from": 900}]
BOUNDS = ["l_quantity < 10", "l_quantity >= 5 and l_quantity < 25", "l_quantity >= 25", "l_quantity >= 900"]


@query(" union all ".join(f"select {i} bucket, count(*) doc_count from lineitem where {b}" for i, b in enumerate(BOUNDS)))
def a_range(spark, sf_dir):
    r = Engine(spark).table(table(spark, sf_dir, "lineitem"), {"aggs": {"r": {"range": {"field": "l_quantity", "ranges": RANGES}}}})
    return r.frame("r").select(F.col("r_key").alias("bucket"), "doc_count")


@query(" union all ".join(f"select {i} bucket, count(*) doc_count, round(avg(l_discount), 6) a, round(max(l_extendedprice), 2) m from lineitem where {b}" for i, b in enumerate(BOUNDS)))
def a_range_sub(spark, sf_dir):
    aggs = {"r": {"range": {"field": "l_quantity", "ranges": RANGES}, "aggs": {"a": {"avg": {"field": "l_discount"}}, "m": {"max": {"field": "l_extendedprice"}}}}}
    f = Engine(spark).table(table(spark, sf_dir, "lineitem"), {"aggs": aggs}).frame("r")
    return f.select(F.col("r_key").alias("bucket"), "doc_count", F.round("a", 6).alias("a"), F.round("m", 2).alias("m"))


TEXT_BOUNDS = ["l_linenumber::varchar >= '2' and l_linenumber::varchar < '10'", "l_linenumber::varchar >= '10' and l_linenumber::varchar < '3'"]


@query(" union all ".join(f"select {i} bucket, count(*) doc_count from lineitem where {b}" for i, b in enumerate(TEXT_BOUNDS)))
def a_range_text(spark, sf_dir):
    aggs = {"r": {"range": {"field": "l_linenumber", "ranges": [{"from": 2, "to": 10}, {"from": 10, "to": 3}]}}}
    f = Engine(spark, semantics=Semantics(range_as_text=True)).table(table(spark, sf_dir, "lineitem"), {"aggs": aggs}).frame("r")
    return f.select(F.col("r_key").alias("bucket"), "doc_count")


def floor_ms(size: int, name: str = "ts") -> str:
    return f"((epoch_us({name}) // 1000) // {size}) * {size}"


def histogram(name: str, interval: str, size: int):
    def run(spark, sf_dir):
        r = Engine(spark).table(table(spark, sf_dir, "events"), {"aggs": {"h": {"date_histogram": {"field": "ts", "interval": interval}}}})
        return r.frame("h").select(F.col("h_key").alias("key"), "doc_count")

    QUERIES[name], ORACLES[name] = run, f"select {floor_ms(size)} as key, count(*) doc_count from events group by 1"


histogram("a_date_hist", "day", 86_400_000)
histogram("a_date_hist_5m", "5m", 300_000)
histogram("a_date_hist_year", "year", 365 * 86_400_000)


@query("select epoch_us(date_trunc('month', ts)) // 1000 as key, count(*) doc_count from events group by 1")
def a_date_hist_calendar(spark, sf_dir):
    r = Engine(spark, semantics=Semantics(calendar=True)).table(table(spark, sf_dir, "events"), {"aggs": {"h": {"date_histogram": {"field": "ts", "interval": "month"}}}})
    return r.frame("h").select(F.col("h_key").alias("key"), "doc_count")


@query(f"select {floor_ms(86_400_000)} as key, count(*) doc_count, round(sum(value), 2) total, count(distinct user_id) users from events group by 1")
def a_date_hist_sub(spark, sf_dir):
    aggs = {"h": {"date_histogram": {"field": "ts", "interval": "day"}, "aggs": {"total": {"sum": {"field": "value"}}, "users": {"cardinality": {"field": "user_id"}}}}}
    f = Engine(spark).table(table(spark, sf_dir, "events"), {"aggs": aggs}).frame("h")
    return f.select(F.col("h_key").alias("key"), "doc_count", F.round("total", 2).alias("total"), "users")


@query(f"select {floor_ms(86_400_000)} as day, {floor_ms(3_600_000)} as hour, count(*) doc_count, max(value) top from events group by 1, 2")
def a_date_hist_nested(spark, sf_dir):
    aggs = {"d": {"date_histogram": {"field": "ts", "interval": "day"}, "aggs": {"h": {"date_histogram": {"field": "ts", "interval": "hour"}, "aggs": {"top": {"max": {"field": "value"}}}}}}}
    f = Engine(spark).table(table(spark, sf_dir, "events"), {"aggs": aggs}).frame("d", "h")
    return f.select(F.col("d_key").alias("day"), F.col("h_key").alias("hour"), "doc_count", "top")


@query(f"select {floor_ms(86_400_000)} as key, count(*) doc_count from events group by 1")
def a_date_hist_bucket_column(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.catalog.put_template("t", {"template": "ev*", "storage": {"timestamp_path": "time"}})
    f = e.search("events", {"aggs": {"h": {"date_histogram": {"field": "time", "interval": "day"}}}}).frame("h")
    return f.select(F.col("h_key").alias("key"), "doc_count")


@query("with t as (select event_type, count(*) c from events group by 1 order by c desc, event_type limit 3) select e.event_type as key, count(*) doc_count, round(avg(value), 4) a from events e where event_type in (select event_type from t) group by 1")
def a_terms(spark, sf_dir):
    aggs = {"t": {"terms": {"field": "event_type", "size": 3}, "aggs": {"a": {"avg": {"field": "value"}}}}}
    f = Engine(spark).table(table(spark, sf_dir, "events"), {"aggs": aggs}).frame("t")
    return f.select(F.col("t_key").alias("key"), "doc_count", F.round("a", 4).alias("a"))


@query("select floor(value / 25) * 25 as key, count(*) doc_count from events group by 1")
def a_histogram(spark, sf_dir):
    f = Engine(spark).table(table(spark, sf_dir, "events"), {"aggs": {"t": {"histogram": {"field": "value", "interval": 25}}}}).frame("t")
    return f.select(F.col("t_key").alias("key"), "doc_count")


@query("select 0 bucket, count(*) doc_count from events where event_type = 'error' union all select 1, count(*) from events where value > 100")
def a_filters(spark, sf_dir):
    aggs = {"f": {"filters": {"filters": {"errors": {"term": {"event_type": "error"}}, "large": {"range": {"value": {"gt": 100}}}}}}}
    f = Engine(spark).table(table(spark, sf_dir, "events"), {"aggs": aggs}).frame("f")
    return f.select(F.col("f_key").alias("bucket"), "doc_count")


@query(f"select count(*) doc_count from {EVENTS} where not list_contains(json_keys(src), 'k')")
def a_missing(spark, sf_dir):
    return engine(spark, sf_dir).search("events", {"aggs": {"m": {"missing": {"field": "k"}}}}).frame("m").select("doc_count")


@query(f"select count(*) doc_count, round(sum((src::json->>'k')::decimal(38,10))::double, 2) s from {EVENTS}")
def a_sum_json(spark, sf_dir):
    f = engine(spark, sf_dir).search("events", {"aggs": {"s": {"sum": {"field": "k"}}}}).frame()
    return f.select("doc_count", F.round(F.col("s").cast("double"), 2).alias("s"))


# -- ingestion and writes --------------------------------------------------------------


@query(f"select event_id, {floor_ms(1000)} b1s, {floor_ms(60_000)} b1m, {floor_ms(3_600_000)} b1h, {floor_ms(86_400_000)} b1d from events")
def ingest_buckets(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))).alias("_source"))
    d = with_buckets(e.withColumn("_timestamp", timestamp_of(F.col("_source"), "t")))
    return d.select("event_id", F.col("_bucket1s").alias("b1s"), F.col("_bucket1m").alias("b1m"), F.col("_bucket1h").alias("b1h"), F.col("_bucket1d").alias("b1d"))


@query("select event_id, '{\"a_k\":' || (props::json->>'k') || ',\"a_t\":\"' || event_type || '\",\"l_0\":' || user_id || ',\"l_1_x\":true}' flat from events")
def flatten(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    nested = F.concat(F.lit('{"a":{"k":'), F.get_json_object("props", "$.k"), F.lit(',"t":"'), "event_type", F.lit('"},"l":['), F.col("user_id").cast("string"), F.lit(',{"x":true}]}'))
    return e.select("event_id", flatten_json(nested).alias("flat"))


def order_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of all orders that have lines, at the sum of their lines; a batch of all orders, at their price."""
    key = [F.lit("o").alias("_index"), F.lit("t").alias("_type")]
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("p"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("p"))
    return tuple(d.select(*key, F.col("o_orderkey").cast("string").alias("_id"), "o_orderkey", "p") for d in (lines, orders))


STATES = "lines as (select l_orderkey k, round(sum(l_extendedprice), 2) p from lineitem group by 1), o as (select o_orderkey k, round(o_totalprice, 2) p from orders)"


@query(f"with {STATES} select coalesce(o.k, lines.k) o_orderkey, coalesce(o.p, lines.p) p from o full join lines on o.k = lines.k")
def upsert_latest(spark, sf_dir):
    old, new = order_states(spark, sf_dir)
    return writes.overwrite(old, new.union(new.withColumn("p", F.lit(-1.0))), F.col("p")).select("o_orderkey", "p")


@query(f"with {STATES} select coalesce(lines.k, o.k) o_orderkey, coalesce(lines.p, o.p) p from o full join lines on o.k = lines.k")
def create_only(spark, sf_dir):
    return writes.create(*order_states(spark, sf_dir)).select("o_orderkey", "p")


@query("select o_orderkey::varchar _id, o_custkey cust, case when c_custkey is null then 'new' else o_orderstatus end status, null::bigint x from orders left join customer on c_custkey = o_orderkey where false union all select coalesce(o_orderkey, c_custkey)::varchar, o_custkey, case when c_custkey is not null then 'new' else o_orderstatus end, c_nationkey from orders full join customer on c_custkey = o_orderkey")
def update_merge(spark, sf_dir):
    d = order_rows(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    part = F.concat(F.lit('{"doc":{"o_orderstatus":"new","x":'), F.col("c_nationkey").cast("string"), F.lit("}}"))
    batch = d.join(c.select(F.col("c_custkey").cast("string").alias("_id"), part.alias("new")), "_id", "right")
    batch = batch.select(*[F.coalesce("_index", F.lit("orders")).alias("_index") if n == "_index" else F.coalesce("_type", F.lit("added")).alias("_type") if n == "_type" else F.col("new").alias("_source") if n == "_source" else F.col(n) for n in d.columns])
    out = writes.update(d, batch)
    return out.select("_id", F.get_json_object("_source", "$.o_custkey").cast("long").alias("cust"), F.get_json_object("_source", "$.o_orderstatus").alias("status"), F.get_json_object("_source", "$.x").cast("long").alias("x"))


@query("select o_orderkey from orders where not o_totalprice >= 100000")
def delete_by_query(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return writes.delete_where(o, Compiler(Fields(o)).query(parse_query({"range": {"o_totalprice": {"gte": 100000}}}))).select("o_orderkey")


@query("select o_orderkey from orders where o_orderkey not in (select c_custkey from customer)")
def delete_by_id(spark, sf_dir):
    d = order_rows(spark, sf_dir)
    gone = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id"))
    return writes.delete(d, gone, ["_id"]).select(F.col("_id").cast("long").alias("o_orderkey"))


@query(f"with {STATES} select k o_orderkey, n from o, (select unnest([1, 2]) n) where n = 2 or k in (select k from lines)")
def dedupe_reject(spark, sf_dir):
    old, new = order_states(spark, sf_dir)
    twice = new.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return writes.split_duplicates(old, twice, F.col("n"))[1].select("o_orderkey", "n")


@query(f"with {STATES}, x as (select k, n - 1 + (k in (select k from lines))::int c from o, (select unnest([1, 2]) n)) select k o_orderkey, case when c > 0 then 'dup_' || c || '_' || k else k::varchar end _id from x")
def regenerate_ids(spark, sf_dir):
    old, new = order_states(spark, sf_dir)
    twice = new.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return writes.regenerate_duplicates(old, twice, F.col("n")).select("o_orderkey", "_id")


# -- schema and statistics ----------------------------------------------------------------


@query(f"""
with e as (select *, row_number() over (order by epoch_us(ts) // 1000, event_id::varchar) n from {EVENTS})
select 'k' field, case when event_type = 'error' then 'object' else 'long' end as type from e where event_type <> 'view' qualify row_number() over (order by n) = 1
union all select 'w', 'text'""")
def mapping_infer(spark, sf_dir):
    return mapping.infer(event_rows(spark, sf_dir).withColumn("_type", F.lit("all"))).select("field", "type")


@query("select unnest(['k', 'o.a', 'o.l', 'o.l.b']) field")
def field_names(spark, sf_dir):
    d = event_rows(spark, sf_dir).withColumn("_source", F.concat(F.lit('{"k":'), "_id", F.lit(',"o":{"a":"x","l":[1,{"b":true}]}}')))
    return mapping.field_names(d).select("field").distinct()


STATS_SQL = """
select 'events' _index, 'user' field, count(*) doc_count, count(*) sum_doc_freq, -1 sum_total_term_freq, min(user_id)::varchar min_value, max(user_id)::varchar max_value from events
union all select 'events', 'type', count(*), 2 * count(*), -1, least(min(event_type), 'kind'), greatest(max(event_type), 'kind') from events
union all select 'events', 'l', count(*), 3 * count(*), -1, '1', '3' from events
union all select 'events', 'on', count(*), count(*), -1, null, null from events where value > 50
"""


def stat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    on_ = F.when(F.col("value") > 50, F.lit(',"on":true')).otherwise(F.lit(""))
    src = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"type":"'), "event_type", F.lit(' kind","l":[1,2,3]'), on_, F.lit("}"))
    return e.select(F.lit("events").alias("_index"), F.lit("t").alias("_type"), F.col("event_id").cast("string").alias("_id"), src.alias("_source"))


@query(STATS_SQL)
def field_stats(spark, sf_dir):
    return stats.measure(stat_rows(spark, sf_dir)).drop("kind")


@query(STATS_SQL)
def field_stats_merge(spark, sf_dir):
    d = stat_rows(spark, sf_dir)
    half = F.col("_source").contains('"click')
    return stats.merge(stats.measure(d.where(half)), stats.measure(d.where(~half))).drop("kind")


@query("select event_id, ((epoch_us(ts) // 1000) % 60000) // 1000 as m, ((epoch_us(ts) // 1000) % 3600000) // 60000 as h, ((epoch_us(ts) // 1000) % 86400000) // 3600000 as d from events")
def shard_offsets(spark, sf_dir):
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", *[shard_offset(t, b).alias(n) for b, n in (("MINUTE", "m"), ("HOUR", "h"), ("DAY", "d"))])


@query()
def sample(spark, sf_dir):
    return mapping.sample(table(spark, sf_dir, "events"), percent=25, seed=7)


FLAGSHIP = {
    "query": {"bool": {"filter": [{"term": {"event_type": "purchase"}}, {"range": {"value": {"gte": 50, "lt": 150}}}]}},
    "aggs": {"per_day": {"date_histogram": {"field": "ts", "interval": "day"}, "aggs": {"total": {"sum": {"field": "value"}}}}},
}


@query(f"select {floor_ms(86_400_000)} as key, count(*) doc_count, round(sum(value), 2) total from events where event_type = 'purchase' and value >= 50 and value < 150 group by 1")
def entry(spark, sf_dir):
    f = Engine(spark).table(table(spark, sf_dir, "events"), json.dumps(FLAGSHIP)).frame("per_day")
    return f.select(F.col("per_day_key").alias("key"), "doc_count", F.round("total", 2).alias("total"))
