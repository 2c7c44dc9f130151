"""Mixing sources to target weights that change over the training run.

Every source has a schedule: its weight at knots of training time 0..1, linear
between them, the weights of all sources adding up to 1 at any time.  The
integral of a source's weight is its cumulative demand for tokens; a document
whose tokens begin at c of its source's shuffled order is due at the time when
demand reaches c.  That inverse is the root of a quadratic in each segment, so
the position is one expression.  Documents are then range-sorted by position.

A source with more tokens than demanded ends where its demand does; one with
fewer is read again, epoch by epoch, as often as demanded.  Only a ``max_epochs``
that is given caps this; what sources then lack is told by ``shortfall``.

The default schedule starts from weights proportional to tokens^0.5 and ends at
tokens^1, from the corpus itself; any schedule table can be given.  A source's
order is that of the MD5 of doc_id and text, so any run repeats it.  Prefix sums
work by (source, first digits of the MD5), so a hot source has many tasks.

Defined cases
* null or empty text: no tokens, no position, not in the result.
* null source: a source of its own.  A source without a schedule isn't used.
* ties and repeated rows: equal (doc_id, text) follow each other.  Null doc_id: as ''.
* very long texts: their length and MD5 count, the whole of them.
* an empty table gives an empty result; columns with any names are carried by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

START, END, DIGITS = 0.5, 1.0, 3
NULL_SOURCE = "\x00"


def measured(docs: DataFrame) -> DataFrame:
    """docs under prefixed helper columns: source key, tokens, order and its bucket."""
    d = docs.where("length(text) > 0")
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    return d.select("*", F.coalesce("source", F.lit(NULL_SOURCE)).alias("__src"), (F.octet_length("text").cast("long") + 1).alias("__tok"), order.alias("__ord"))


def default_schedule(supply: DataFrame) -> DataFrame:
    """(src, t0, t1, w0, w1): tokens^START at time 0 to tokens^END at time 1."""
    w = Window.partitionBy()  # one row a source
    a, b = F.pow("supply", F.lit(START)), F.pow("supply", F.lit(END))
    return supply.select("src", F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), F.round(a / F.sum(a).over(w), 12).alias("w0"), F.round(b / F.sum(b).over(w), 12).alias("w1"))


def schedule(spark, knots: dict[str | None, list[tuple[float, float]]]) -> DataFrame:
    """A schedule table from {source: [(time, weight), ...]}: same times for all, normalised at each."""
    times = [[t for t, _ in v] for v in knots.values()]
    if not times or any(t != times[0] for t in times) or times[0][0] != 0 or times[0][-1] != 1 or sorted(set(times[0])) != times[0]:
        raise ValueError("all sources need the same increasing times from 0 to 1")
    total = [sum(v[i][1] for v in knots.values()) for i in range(len(times[0]))]
    if any(x <= 0 for x in total) or any(w < 0 for v in knots.values() for _, w in v):
        raise ValueError("weights must not be negative, nor all 0 at a time")
    rows = [(NULL_SOURCE if s is None else s, v[i][0], v[i + 1][0], v[i][1] / total[i], v[i + 1][1] / total[i + 1]) for s, v in knots.items() for i in range(len(v) - 1)]
    return spark.createDataFrame(rows, "src string, t0 double, t1 double, w0 double, w1 double")


def positions(sized: DataFrame, scratch: Scratch, plan: DataFrame | None, budget: int | None, max_epochs: int | None, digits: int) -> DataFrame:
    """sized with __epoch, __start (tokens of its source before it) and __pos in 0..1, due rows alone.

    A source's cumulative demand at time t of a segment is
    budget * (area before + w0 * d + (w1 - w0) / (2 * (t1 - t0)) * d * d), d = t - t0.
    """
    cell = scratch.table(sized.groupBy("__src", F.substring("__ord", 1, digits).alias("__cell")).agg(F.sum("__tok").alias("tok")))
    supply = cell.groupBy(F.col("__src").alias("src")).agg(F.sum("tok").alias("supply"))
    plan = default_schedule(supply) if plan is None else plan
    total = F.lit(budget).cast("long") if budget else F.sum("supply").over(Window.partitionBy())
    supply = supply.select("src", "supply", total.alias("budget"))
    before = Window.partitionBy("src").orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)
    area = (F.col("w0") + F.col("w1")) * (F.col("t1") - F.col("t0")) / 2
    seg = plan.withColumn("area", area).withColumn("area0", F.coalesce(F.sum("area").over(before), F.lit(0.0)))
    seg = seg.join(supply, "src").where("supply > 0 and area > 0")

    run = Window.partitionBy("__src").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("__src", "__cell").orderBy("__ord").rowsBetween(Window.unboundedPreceding, -1)
    d = sized.withColumn("__cell", F.substring("__ord", 1, digits)).withColumn("__in", F.coalesce(F.sum("__tok").over(inside), F.lit(0)))
    need = seg.groupBy("src").agg(F.max("supply").alias("supply"), F.max("budget").alias("budget"), F.max(F.col("area0") + F.col("area")).alias("share"), F.array_sort(F.collect_list(F.struct("t0", "t1", "w0", "w1", "area0", "area"))).alias("segs"))
    base = cell.select(F.col("__src").alias("src"), "__cell", F.coalesce(F.sum("tok").over(run), F.lit(0)).alias("__base")).join(need, "src")
    d = d.join(base.withColumnRenamed("src", "__src").hint("shuffle_merge"), ["__src", "__cell"]).withColumn("__first", F.col("__base") + F.col("__in"))
    epochs = F.ceil(F.col("share") * F.col("budget") / F.col("supply"))
    epochs = (epochs if max_epochs is None else F.least(F.lit(max_epochs), epochs)).cast("int")
    d = d.withColumn("__epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    d = d.withColumn("__start", F.col("__first") + F.col("__epoch") * F.col("supply")).withColumn("__c", F.col("__start") / F.col("budget")).where("__c < share")
    d = d.withColumn("__s", F.expr("filter(segs, s -> __c >= s.area0)[size(filter(segs, s -> __c >= s.area0)) - 1]"))
    x, slope = F.col("__c") - F.col("__s.area0"), (F.col("__s.w1") - F.col("__s.w0")) / (F.col("__s.t1") - F.col("__s.t0"))
    root = F.sqrt(F.greatest(F.col("__s.w0") * F.col("__s.w0") + 2 * slope * x, F.lit(0.0)))
    due = F.when(x <= 0, F.col("__s.t0")).otherwise(F.col("__s.t0") + 2 * x / (F.col("__s.w0") + root))
    return d.withColumn("__pos", due)


def assign(docs: DataFrame, plan: DataFrame | None = None, budget: int | None = None, max_epochs: int | None = None, digits: int = DIGITS) -> DataFrame:
    """doc_id, source, n_tokens, epoch, source_start and position (0..1) of each use of a document, sorted."""
    scratch = Scratch(docs.sparkSession)
    sized = scratch.table(measured(docs.select("doc_id", "text", "source")).select("doc_id", "source", "__src", "__tok", "__ord"))
    d = positions(sized, scratch, plan, budget, max_epochs, digits)
    out = d.select("doc_id", "source", F.col("__tok").alias("n_tokens"), F.col("__epoch").alias("epoch"), F.col("__start").alias("source_start"), F.col("__pos").alias("position"), "__ord")
    return out.orderBy("position", "__ord").drop("__ord")


def shortfall(docs: DataFrame, max_epochs: int, plan: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """source, demand and supply (tokens, all epochs) of each source that ``max_epochs`` cuts short."""
    supply = measured(docs.select("doc_id", "text", "source")).groupBy(F.col("__src").alias("src")).agg(F.sum("__tok").alias("supply"))
    plan = default_schedule(supply) if plan is None else plan
    total = F.lit(budget).cast("long") if budget else F.sum("supply").over(Window.partitionBy())
    share = plan.groupBy("src").agg(F.sum((F.col("w0") + F.col("w1")) * (F.col("t1") - F.col("t0")) / 2).alias("share"))
    d = supply.withColumn("budget", total).join(share, "src").select(F.nullif("src", F.lit(NULL_SOURCE)).alias("source"), (F.col("share") * F.col("budget")).alias("demand"), (F.col("supply") * max_epochs).alias("supply"))
    return d.where("demand > supply")


def mix(docs: DataFrame, plan: DataFrame | None = None, budget: int | None = None, max_epochs: int | None = None, digits: int = DIGITS) -> DataFrame:
    """The rows of docs, range-sorted by position, as often as they are used."""
    scratch = Scratch(docs.sparkSession)
    whole = docs.select(F.struct("*").alias("__row"), "doc_id", "text", "source")
    sized = measured(whole).select("__row", "__src", "__tok", "__ord")
    d = positions(sized, scratch, plan, budget, max_epochs, digits)
    return d.select("__row", "__pos", "__ord").orderBy("__pos", "__ord").select("__row.*")


#: The same for DuckDB, from the default schedule.
SQL = f"""
with d as (select doc_id, source, coalesce(source, chr(1)) src, strlen(text) + 1 tok,
                  md5(concat_ws(':', coalesce(doc_id::varchar, ''), text)) ord
           from documents where length(text) > 0),
sup as (select src, sum(tok)::bigint supply from d group by src),
w as (select src, supply, (sum(supply) over ())::bigint budget,
             round(pow(supply, {START}) / sum(pow(supply, {START})) over (), 12) w0,
             round(pow(supply, {END}) / sum(pow(supply, {END})) over (), 12) w1 from sup),
p as (select *, (w0 + w1) * (1.0::double - 0.0::double) / 2 share,
             ceil((w0 + w1) * (1.0::double - 0.0::double) / 2 * budget / supply)::int epochs from w),
s as (select d.*, (coalesce(sum(tok) over (partition by src order by ord rows between unbounded preceding and 1 preceding), 0))::bigint before from d),
e as (select s.*, p.supply, p.budget, p.w0, p.w1, p.share, unnest(range(0, p.epochs))::int epoch from s join p using (src)),
c as (select *, before + epoch * supply source_start, (before + epoch * supply)::double / budget x from e)
select doc_id, source, tok::bigint n_tokens, epoch, source_start,
       case when x <= 0 then 0.0::double else 2 * x / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * x, 0))) end as position
from c where x < share
"""
