"""From a field's name to a column.

A typed table's field is a column of its own, so filters and projections reach
the scan.  A document table keeps each document as JSON in ``_source``; its
fields are single keys, not paths.  The timestamp that a template names is in
``_timestamp`` and its buckets in ``_bucket1s`` to ``_bucket1d``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = {1000: "_bucket1s", 60_000: "_bucket1m", 3_600_000: "_bucket1h", 86_400_000: "_bucket1d"}
META = ("_index", "_type", "_id", "_timestamp", *BUCKETS.values())
NUMBER = T.DecimalType(38, 10)


def json_path(key: str) -> str:
    """The JSON path of a literal key, whatever is in it."""
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


@dataclass
class Fields:
    """Resolves the fields of one table.

    mapping: declared types of a document table's fields, by name, or None where unknown.
    """

    df: DataFrame
    timestamp_path: str | None = None
    mapping: dict[str, dict] | None = None
    lenient: bool = False

    def __post_init__(self):
        self.types = {f.name: f.dataType for f in self.df.schema.fields}
        self.variant = "_source" in self.types and self.types["_source"].typeName() == "variant"

    @property
    def documents(self) -> bool:
        return "_source" in self.types

    def typed(self, name: str) -> T.DataType | None:
        """The column type, None where the field lies in the JSON."""
        return self.types.get(name) if not self.documents or name in META else None

    def column(self, name: str) -> Column:
        """The field as it is: a column, or text of the JSON value; null where there is none."""
        if self.typed(name) is not None:
            return F.col(f"`{name.replace('`', '``')}`")
        if not self.documents:
            return F.lit(None).cast("string")
        if self.variant:
            return F.variant_get("_source", json_path(name), "string")
        return F.get_json_object("_source", json_path(name))

    def text(self, name: str) -> Column:
        kind = self.typed(name)
        c = self.column(name)
        return c if kind is None or isinstance(kind, T.StringType) else c.cast("string")

    def exists(self, name: str) -> Column:
        """Whether the key is there, even with an explicit null; a typed column: whether it has a value."""
        if not self.documents or name in META:
            return self.column(name).isNotNull()
        if self.variant:
            return F.variant_get("_source", json_path(name), "variant").isNotNull()
        return F.coalesce(F.array_contains(F.json_object_keys("_source"), name), F.lit(False))

    def number(self, name: str) -> Column:
        """For sums and comparisons: numeric columns as they are, times as epoch milliseconds, text as an exact decimal."""
        kind = self.typed(name)
        if name == self.timestamp_path and "_timestamp" in self.types:
            return F.col("_timestamp")
        c = self.column(name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.unix_millis(c.cast("timestamp"))
        if kind is not None and isinstance(kind, T.NumericType):
            return c
        if isinstance(kind, T.BooleanType):
            return c.cast("int")
        return c.try_cast(NUMBER) if self.lenient else c.cast(NUMBER)

    def millis(self, name: str) -> Column:
        """A date field as epoch milliseconds."""
        kind = self.typed(name)
        if name == self.timestamp_path and "_timestamp" in self.types:
            return F.col("_timestamp")
        c = self.column(name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.unix_millis(c.cast("timestamp"))
        if kind is not None and isinstance(kind, T.IntegralType):
            return c.cast("long")
        declared = (self.mapping or {}).get(name, {})
        if declared.get("type") == "long" or declared.get("format") == "epoch_millis":
            return c.cast("long")
        return F.coalesce(c.try_cast("long"), F.unix_millis(F.try_to_timestamp(c)))

    def sort_keys(self, name: str) -> list[Column]:
        """Columns to sort by; in a JSON document by kind, then number, then text."""
        if self.typed(name) is not None or not self.documents:
            return [self.column(name)]
        if self.variant:
            v = F.variant_get("_source", json_path(name), "variant")
            kind, number = F.schema_of_variant(v), F.try_variant_get("_source", json_path(name), "double")
            text = F.variant_get("_source", json_path(name), "string")
            rank = F.when(v.isNull(), F.lit(None).cast("int")).when(kind.startswith("OBJECT"), 5).when(kind.startswith("ARRAY"), 4).when(kind == "BOOLEAN", 3).when(kind == "STRING", 1).when(kind == "VOID", 0).otherwise(2)
        else:
            v = F.variant_get(F.try_parse_json("_source"), json_path(name), "variant")
            kind, text = F.schema_of_variant(v), F.get_json_object("_source", json_path(name))
            number = text.try_cast("double")
            rank = F.when(v.isNull(), F.lit(None).cast("int")).when(kind.startswith("OBJECT"), 5).when(kind.startswith("ARRAY"), 4).when(kind == "BOOLEAN", 3).when(kind == "STRING", 1).when(kind == "VOID", 0).otherwise(2)
        return [rank, F.when(rank == 2, number), F.when(rank != 2, text)]
