"""The catalog: indices, their templates and mappings."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import META

DOCUMENT = "_index string, _type string, _id string, _timestamp bigint, _bucket1s bigint, _bucket1m bigint, _bucket1h bigint, _bucket1d bigint, _source string"
COLUMNS = (*META, "_source")


@dataclass(frozen=True)
class Storage:
    """Storage settings of a template; settings that aren't known are ignored."""

    distribution: str = "HASH"
    time_bucket: str = "MINUTE"
    timestamp_path: str | None = None
    id_enabled: bool = True
    field_stats_enabled: bool = True
    mapping_enabled: bool = True
    index_generation: dict = field(default_factory=dict)

    @classmethod
    def of(cls, settings: dict) -> Storage:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in settings.items() if k in known})


@dataclass(frozen=True)
class Template:
    name: str
    pattern: str
    storage: Storage = Storage()
    mappings: dict = field(default_factory=dict, compare=False)

    def matches(self, index: str) -> bool:
        return re.fullmatch(self.pattern.replace("*", "(.*)"), index) is not None

    def to_dict(self) -> dict:
        return {"template": self.pattern, "storage": asdict(self.storage), "mappings": self.mappings}


def expand(pattern: str, names: list[str]) -> list[str]:
    """The names that a comma list of patterns meets, ``*`` being any run; case is ignored.  In order of names."""
    parts = [p.strip() for p in pattern.split(",") if p.strip()]
    tests = [re.compile(".*".join(map(re.escape, (p if p != "_all" else "*").split("*"))), re.IGNORECASE) for p in parts]
    return [n for n in names if any(x.fullmatch(n) for x in tests)]


class Catalog:
    """Indices by name: DataFrames of document rows, or a store's partitions."""

    def __init__(self, spark: SparkSession, store=None):
        self.spark, self.store = spark, store
        self.frames: dict[str, DataFrame] = {}
        self.templates: dict[str, Template] = {}
        self.mappings: dict[str, dict[str, dict[str, dict]]] = {}  # index, type, field

    # -- indices

    def register(self, index: str, df: DataFrame) -> None:
        """df has the columns of documents but _index."""
        self.frames[index] = df.withColumn("_index", F.lit(index)).select(*COLUMNS)

    def names(self) -> list[str]:
        return sorted({*self.frames, *(self.store.names() if self.store else ())})

    def matching(self, pattern: str) -> list[str]:
        return expand(pattern, self.names())

    def documents(self, names: list[str]) -> DataFrame:
        """The union of these indices; without any, no rows."""
        stored = [n for n in names if n not in self.frames]
        parts = [self.frames[n] for n in names if n in self.frames]
        if stored:
            parts.append(self.store.read(stored))
        if not parts:
            return self.spark.createDataFrame([], DOCUMENT)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def types_matching(self, names: list[str], pattern: str) -> list[str]:
        """Types by pattern among the known ones; exact names need not be known."""
        known = sorted({k for n in names for k in self.mappings.get(n, {})})
        exact = [p.strip() for p in pattern.split(",") if "*" not in p]
        return list(dict.fromkeys([*expand(pattern, known), *exact]))

    # -- templates

    def put_template(self, name: str, body: dict) -> None:
        self.templates[name] = Template(name, body["template"], Storage.of(body.get("storage", {})), body.get("mappings", {}))

    def template_for(self, index: str) -> Template | None:
        """The first template, by name, whose pattern the index meets (``*`` any run, a dot any character)."""
        return next((x for _, x in sorted(self.templates.items()) if x.matches(index)), None)

    def common_template(self, names: list[str]) -> Template | None:
        """Several indices share a template only if all of them have one of the same pattern."""
        found = [self.template_for(n) for n in names]
        return found[0] if found and all(found) and len({x.pattern for x in found}) == 1 else None

    # -- mappings

    def put_mapping(self, index: str, kind: str, properties: dict[str, dict], replace: bool = False) -> None:
        """Merges field attributes (or replaces fields) into a type's mapping."""
        own = self.mappings.setdefault(index, {}).setdefault(kind, {})
        for name, attributes in properties.items():
            own[name] = dict(attributes) if replace else {**own.get(name, {}), **attributes}

    def learn(self, inferred: DataFrame) -> None:
        """Adds what inference found; a field that has a type keeps it."""
        for r in inferred.collect():
            own = self.mappings.setdefault(r["_index"], {}).setdefault(r["_type"], {})
            own.setdefault(r["field"], {"type": r["type"], **({"format": r["format"]} if r["format"] else {})})

    def seeded(self, index: str) -> dict[str, dict[str, dict]]:
        """The index's mapping over what its template declares."""
        t = self.template_for(index)
        out = {k: {n: dict(a) for n, a in v.get("properties", {}).items()} for k, v in (t.mappings if t else {}).items()}
        for kind, own in self.mappings.get(index, {}).items():
            for n, a in own.items():
                out.setdefault(kind, {}).setdefault(n, a)
        return out

    def mapping(self, names: list[str]) -> dict[str, dict] | None:
        """The first type of each field over these indices; None where nothing is known of them."""
        out: dict[str, dict] = {}
        known = False
        for n in names:
            for own in self.seeded(n).values():
                known = True
                for name, a in own.items():
                    out.setdefault(name, a)
        return out if known else None

    def get_mapping(self, indices: str = "*", types: str = "*", field_pattern: str = "*") -> dict:
        out: dict[str, Any] = {}
        for n in self.matching(indices):
            own = self.seeded(n)
            kinds = {k: {f: own[k][f] for f in expand(field_pattern, sorted(own[k]))} for k in expand(types, sorted(own))}
            out[n] = {"mappings": {k: {"properties": v} for k, v in kinds.items()}}
        return out

    def field_capabilities(self, indices: str = "*", field_pattern: str = "*") -> dict:
        """Every field can be searched and aggregated."""
        out: dict[str, dict] = {}
        for name, a in (self.mapping(self.matching(indices)) or {}).items():
            if expand(field_pattern, [name]):
                out[name] = {a["type"]: {"type": a["type"], "searchable": True, "aggregatable": True}}
        return {"fields": out}

    # -- as JSON

    def dump(self) -> str:
        return json.dumps({"templates": {k: v.to_dict() for k, v in self.templates.items()}, "mappings": self.mappings})

    def load(self, text: str) -> None:
        body = json.loads(text)
        for k, v in body["templates"].items():
            self.put_template(k, v)
        self.mappings = body["mappings"]
