"""The engine: searches over the indices of a catalog."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import Fields
from ..plans import tree as t
from ..plans.parse import parse_request
from ..sources.catalog import Catalog
from .aggregate import Frame, Planner, nested
from .compile import Compiler, sort_by, sort_columns


@dataclass
class SearchResult:
    """Plans of one search; nothing runs before it is asked for."""

    request: t.Request
    matched: DataFrame
    fields: Fields
    semantics: t.Semantics

    @property
    def total(self) -> DataFrame:
        return self.matched.agg(F.count(F.lit(1)).alias("total"))

    @property
    def ordered(self) -> DataFrame:
        """All that match, in order: sorted by ranges, for what no page holds.

        Keys are columns of their own: Spark works out any other expression anew at every comparison.
        """
        if not self.request.sort:
            return self.matched
        return sort_by(self.matched, sort_columns(self.fields, self.request.sort))

    @property
    def hits(self) -> DataFrame:
        """The page asked for, in order."""
        df = self.ordered
        if self.request.offset:
            df = df.offset(self.request.offset)
        return df.limit(self.request.size)

    @cached_property
    def frames(self) -> list[Frame]:
        return Planner(self.matched, self.fields, self.semantics).frames(self.request.aggs)

    def frame(self, *names: str) -> DataFrame:
        """The buckets under these bucket names; without names, the metrics of all documents."""
        return next(f.df for f in self.frames if tuple(b.name for b in f.path) == names)

    def to_dict(self) -> dict[str, Any]:
        began = time.time()
        total = self.total.first()["total"]
        out: dict[str, Any] = {"timed_out": False, "_shards": {"total": 1, "successful": 1, "failed": 0}, "hits": {"total": total, "max_score": None, "hits": []}}
        if self.request.size:
            out["hits"]["max_score"] = 1.0
            out["hits"]["hits"] = [self.hit(r) for r in self.hits.toLocalIterator()]
        if self.request.aggs:
            out["aggregations"] = nested(self.request.aggs, self.frames, total)
        return {"took": int((time.time() - began) * 1000), **out}

    def hit(self, row) -> dict:
        if not self.fields.documents:
            return {"_score": 1.0, "_source": row.asDict(recursive=True)}
        source = row["_source"]
        return {"_index": row["_index"], "_type": row["_type"], "_id": row["_id"], "_score": 1.0, "_source": json.loads(source if isinstance(source, str) else source.toJson())}


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, semantics: t.Semantics = t.Semantics()):
        self.spark, self.semantics = spark, semantics
        self.catalog = catalog or Catalog(spark)

    def _table(self, indices: str, types: str | None) -> tuple[DataFrame, Fields]:
        names = self.catalog.matching(indices)
        df = self.catalog.documents(names)
        if types:
            df = df.where(F.col("_type").isin(self.catalog.types_matching(names, types)))
        template = self.catalog.common_template(names)
        mapping = self.catalog.mapping(names) if template is None or template.storage.mapping_enabled else None
        return df, Fields(df, template.storage.timestamp_path if template else None, mapping, self.semantics.lenient)

    def search(self, indices: str = "*", request: str | dict | None = None, types: str | None = None) -> SearchResult:
        parsed = parse_request(request)
        df, fields = self._table(indices, types)
        return SearchResult(parsed, df.where(Compiler(fields, self.semantics).query(parsed.query)), fields, self.semantics)

    def table(self, df: DataFrame, request: str | dict | None = None) -> SearchResult:
        """The same over any DataFrame: its columns are the fields."""
        parsed = parse_request(request)
        fields = Fields(df, lenient=self.semantics.lenient)
        return SearchResult(parsed, df.where(Compiler(fields, self.semantics).query(parsed.query)), fields, self.semantics)

    def msearch(self, body: str, indices: str = "*", types: str | None = None) -> list[SearchResult]:
        """Pairs of lines, header and request; a header's own index and type win."""
        lines = [x for x in body.split("\n") if x.strip()]
        if len(lines) % 2:
            raise ValueError("a header without a request")
        out = []
        for head, request in zip(map(json.loads, lines[::2]), lines[1::2], strict=True):
            index = head.get("index", indices)
            kind = head.get("type", types)
            out.append(self.search(",".join(index) if isinstance(index, list) else index, request, ",".join(kind) if isinstance(kind, list) else kind))
        return out

    def answer(self, results: list[SearchResult]) -> dict:
        """Responses of several searches, run side by side."""
        with ThreadPoolExecutor(max(1, min(8, len(results)))) as pool:
            return {"responses": list(pool.map(SearchResult.to_dict, results))}

    def get(self, index: str, kind: str, id_: str) -> DataFrame:
        df = self.catalog.documents([index] if index in self.catalog.names() else [])
        return df.where((F.col("_type") == kind) & (F.col("_id") == id_)).limit(1)

    def exists(self, index: str, kind: str, id_: str) -> bool:
        return not self.get(index, kind, id_).select("_id").isEmpty()

    def mget(self, wanted: list[dict], index: str | None = None, kind: str | None = None) -> DataFrame:
        """The documents wanted that there are; those missing are left out.

        Each item may name _index, _type and _id; the arguments stand in for the first two.
        """
        rows = [(w.get("_index", index), w.get("_type", kind), str(w["_id"])) for w in wanted]
        names = [n for n in dict.fromkeys(r[0] for r in rows) if n in self.catalog.names()]
        df = self.catalog.documents(names)
        asked = self.spark.createDataFrame(rows, "i string, t string, d string").distinct()
        on = [F.col("_id") == F.col("d"), F.col("_index").eqNullSafe(F.col("i")), F.col("t").isNull() | (F.col("_type") == F.col("t"))]
        return df.join(F.broadcast(asked), reduce(lambda a, b: a & b, on), "left_semi")  # the request itself, not data
