"""Field statistics: mergeable, by index and field.

Of each field: how many documents have it, how many values (strings: words)
they have in it, the total term frequency (-1 where it isn't known, which
stays so in any sum), and the least and greatest value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json import words
from .mapping import NESTED, leaves, whole

KINDS = ("String", "Boolean", "Long", "Double")
MARKS = {"Boolean": 1, "Long": 2, "Double": 4, "String": 8}
KEEP_MINUS = "case when min({0}) < 0 then -1 else sum({0}) end"


def values(d: DataFrame, levels: int) -> DataFrame:
    """(_index, doc, field, kind, text, marks): the leaves, with their kind: String, Boolean, Long or Double, or Nested; nulls are skipped.

    marks: bits of what this leaf is the first of in its row: of its field and kind, and (String)
    of all that may count as a string.
    """
    named = lambda k: F.when(k == "STRING", "String").when(k == "BOOLEAN", "Boolean").when(k == "BIGINT", "Long").when(k.rlike(NESTED), "Nested").when(k != "VOID", "Double")
    found = F.transform(leaves(F.col("_source"), levels), lambda x: F.struct(x["field"].alias("field"), F.schema_of_variant(x["value"]).alias("k"), x["value"].alias("value")))
    found = F.transform(found, lambda x: F.struct(x["field"].alias("field"), named(x["k"]).alias("kind"), F.try_variant_get(x["value"], "$", "string").alias("text")))
    # Sorted, a leaf is the first of its sort where the one before is of another; Boolean comes before all other kinds.
    rows = d.select("_index", "doc", F.sort_array(F.filter(found, lambda x: x["kind"].isNotNull())).alias("all"))
    rows = rows.select("_index", "doc", F.explode(F.transform("all", lambda x, i: F.struct(x.alias("x"), F.get("all", i - 1).alias("before")))).alias("at")).select("_index", "doc", "at.x.*", "at.before")
    kind, same = F.col("kind"), F.coalesce(F.col("before.field") == F.col("field"), F.lit(False))
    first = ~same | (F.col("before.kind") != kind)
    text = (kind != "Boolean") & (~same | (F.col("before.kind") == "Boolean"))
    bits = [F.when(first & (kind == k), bit) for k, bit in MARKS.items() if k != "String"] + [F.when(text, MARKS["String"])]
    return rows.withColumn("marks", sum((F.coalesce(x, F.lit(0)) for x in bits), F.lit(0))).drop("before")


def by_field(d: DataFrame, levels: int, once: bool) -> DataFrame:
    """Counts and bounds of each field, whatever kind it turns out to have.

    once: no document is in two rows, so the marks of a row are those of its document, and
    no leaf need leave its task before it is counted.
    """
    v = values(d, levels)
    is_ = {k: F.col("kind") == k for k in KINDS}
    number = F.col("text").try_cast("double")
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    w = words(F.col("text"))
    word = lambda f: F.when(is_["String"], f(w)).when(is_["Long"] | is_["Double"], F.col("text"))
    marked = [F.count(F.when(F.col("marks").bitwiseAND(bit) > 0, 1)).alias(f"docs_{k}") for k, bit in MARKS.items()]
    rest = [
        *[F.count(F.when(c, 1)).alias(f"n_{k}") for k, c in is_.items()],
        F.sum(F.when(~is_["Boolean"], spaces + 1)).alias("freq"),
        F.min(word(F.array_min)).alias("lo_word"),
        F.max(word(F.array_max)).alias("hi_word"),
        *[f(F.when(is_[k], number)).alias(f"{n}_{k}") for k in ("Long", "Double") for n, f in (("lo", F.min), ("hi", F.max))],
        # A set, not max: with it the aggregate is by hash; with bounds of text alone Spark sorts all leaves first.
        (F.size(F.collect_set(F.when(F.col("kind") == "Nested", True))) > 0).alias("deeper"),
    ]
    if once:
        return v.groupBy("_index", "field").agg(*marked, *rest)
    own = v.where("marks > 0").groupBy("_index", "field", "doc").agg(F.bit_or("marks").alias("marks")).groupBy("_index", "field").agg(*marked)
    both = v.groupBy("_index", "field").agg(*rest).unionByName(own, allowMissingColumns=True)
    return both.groupBy("_index", "field").agg(*[F.max(c).alias(c) for c in both.columns[2:]])  # a column has a value in one of the two


def measure(docs: DataFrame) -> DataFrame:
    """(_index, field, kind, doc_count, sum_doc_freq, sum_total_term_freq, min_value, max_value) of a batch.

    A field that has strings anywhere is a String field, and its numbers count as
    strings; of other mixtures the most frequent kind counts and the rest is dropped.
    Rows of one index, type and id are one document.
    """
    d = docs.select("_index", F.concat_ws("\x00", "_type", "_id").alias("doc"), "_source")
    once = (d.groupBy(F.xxhash64("_index", "doc")).count().agg(F.max("count")).first()[0] or 0) < 2
    f = whole(docs.sparkSession, lambda levels: by_field(d, levels, once))
    is_ = {k: F.col("kind") == k for k in KINDS}
    rank = F.greatest(*[F.struct((F.lit(k == "String") & (F.sum(f"n_{k}") > 0)).alias("s"), F.sum(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for k in KINDS])
    f = f.join(f.groupBy("field").agg(rank["kind"].alias("kind")), "field")
    by = lambda c: F.coalesce(*[F.when(is_[k], c(k)) for k in KINDS])
    shown = lambda n: F.when(is_["String"], F.col(f"{n}_word")).when(is_["Long"], F.col(f"{n}_Long").cast("long").cast("string")).when(is_["Double"], F.col(f"{n}_Double").cast("string"))
    out = f.select(
        "_index",
        "field",
        "kind",
        by(lambda k: F.col(f"docs_{k}")).alias("doc_count"),
        F.when(is_["String"], F.col("freq")).when(is_["Double"], 0).otherwise(by(lambda k: F.col(f"n_{k}"))).cast("long").alias("sum_doc_freq"),
        F.when(is_["Double"], 0).otherwise(-1).cast("long").alias("sum_total_term_freq"),
        shown("lo").alias("min_value"),
        shown("hi").alias("max_value"),
    )
    return out.where("doc_count > 0")


def merge(*parts: DataFrame) -> DataFrame:
    """The statistics of batches of different documents, put together."""
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    rank = F.struct((F.col("kind") == "String").cast("int"), "doc_count", "kind")
    kinds = df.groupBy("field").agg(F.max_by("kind", rank).alias("is"))
    df = df.join(kinds, "field").where("kind = is or (is = 'String' and kind in ('Long', 'Double'))")
    number = F.when(F.col("is").isin("Long", "Double"), F.col("min_value").try_cast("double"))
    high = F.when(F.col("is").isin("Long", "Double"), F.col("max_value").try_cast("double"))
    text = F.col("is") == "String"
    out = df.groupBy("_index", "field", F.col("is").alias("kind")).agg(
        F.sum("doc_count").alias("doc_count"),
        F.expr(KEEP_MINUS.format("sum_doc_freq")).alias("sum_doc_freq"),
        F.expr(KEEP_MINUS.format("sum_total_term_freq")).alias("sum_total_term_freq"),
        F.min(F.when(text, F.col("min_value"))).alias("lo_word"),
        F.max(F.when(text, F.col("max_value"))).alias("hi_word"),
        F.min(number).alias("lo"),
        F.max(high).alias("hi"),
    )
    shown = lambda n, s: F.when(F.col("kind") == "Long", F.col(n).cast("long").cast("string")).when(F.col("kind") == "Double", F.col(n).cast("string")).otherwise(F.col(s))
    return out.select("_index", "field", "kind", "doc_count", "sum_doc_freq", "sum_total_term_freq", shown("lo", "lo_word").alias("min_value"), shown("hi", "hi_word").alias("max_value"))


def report(stats: DataFrame, max_docs: DataFrame, level: str = "indices") -> DataFrame:
    """With max_doc and density (whole percent), by index, or over all of them as ``_all``.

    max_docs: (_index, max_doc).
    """
    if level == "cluster":
        stats = merge(stats.withColumn("_index", F.lit("_all")))
        max_docs = max_docs.agg(F.sum("max_doc").alias("max_doc")).withColumn("_index", F.lit("_all"))
    df = stats.join(max_docs, "_index")
    return df.withColumn("density", F.expr("100 * doc_count div max_doc")).select("_index", "field", "kind", "max_doc", "doc_count", "density", "sum_doc_freq", "sum_total_term_freq", "min_value", "max_value")
