"""Field types, schema inference and schema evolution.

Six field types: keyword, text, numeric, date, boolean, ip.  Every field may
have several values; ``multi`` names the fields that are stored as arrays.
Nested objects are addressed by dotted paths.
"""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError

TYPES = ("keyword", "text", "numeric", "date", "boolean", "ip")
SYSTEM = ("_id", "_source", "__present__")
SPARK_TYPES: dict[str, T.DataType] = {
    "keyword": T.StringType(), "text": T.StringType(), "numeric": T.DoubleType(), "date": T.TimestampType(), "boolean": T.BooleanType(), "ip": T.StringType(),
}

_TIMESTAMP = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}")
_COMPACT_DAY = re.compile(r"\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])", re.A)


@dataclass
class Schema:
    """Field types by name, and which fields are stored as arrays."""

    fields: dict[str, str] = field(default_factory=dict)
    multi: set[str] = field(default_factory=set)

    def __post_init__(self):
        for name, kind in self.fields.items():
            if kind not in TYPES:
                raise SchemaError(f"field '{name}': unknown type '{kind}'")
        self.fields = dict(sorted(self.fields.items()))

    @classmethod
    def parse(cls, value: str | dict | Schema) -> Schema:
        """A schema from ``{"fields": {name: type}}``, as JSON text or a dict."""
        if isinstance(value, Schema):
            return value
        try:
            x = json.loads(value) if isinstance(value, str) else value
            return cls(dict(x["fields"]), set(x.get("multi", ())))
        except (ValueError, TypeError, KeyError) as e:
            raise SchemaError(f"not a schema: {e}") from e

    def to_dict(self) -> dict:
        return {"fields": self.fields, "multi": sorted(self.multi)}

    def kind(self, name: str) -> str:
        if name not in self.fields:
            raise SchemaError(f"field '{name}' is not in the schema")
        return self.fields[name]

    def merge(self, other: Schema) -> tuple[Schema, list[str]]:
        """Both schemas' fields, this one's types first; and the names that are new."""
        new = [n for n in other.fields if n not in self.fields]
        return Schema({**other.fields, **self.fields}, self.multi | other.multi), new


def _is_ip(s: str) -> bool:
    try:
        ipaddress.ip_address(s)
    except ValueError:
        return False
    return True


def infer_scalar(value) -> str | None:
    """The type of a JSON value that is no array; None for null and objects."""
    match value:
        case bool():
            return "boolean"
        case int() | float():
            return "numeric"
        case str():
            if _TIMESTAMP.match(value) or _COMPACT_DAY.fullmatch(value):
                return "date"
            return "ip" if _is_ip(value) else "keyword"
    return None


def infer_value(value) -> str | None:
    """The type of a JSON value; an array has its elements' type if they agree."""
    if not isinstance(value, list):
        return infer_scalar(value)
    kinds = {None if isinstance(x, list) else infer_scalar(x) for x in value if x is not None}
    return kinds.pop() if len(kinds) == 1 else None


def flatten(value: dict, path: str = "") -> Iterator[tuple[str, object]]:
    """Dotted paths and values of a JSON object's leaves."""
    for key, x in value.items():
        name = f"{path}.{key}" if path else key
        if isinstance(x, dict):
            yield from flatten(x, name)
        else:
            yield name, x


def infer_documents(docs: Iterable[dict]) -> Schema:
    """The schema of JSON objects: for each field the first type that can be inferred."""
    fields: dict[str, str] = {}
    multi: set[str] = set()
    for doc in docs:
        for name, x in flatten(doc):
            if name in SYSTEM:
                continue
            if name not in fields and (kind := infer_value(x)):
                fields[name] = kind
            if isinstance(x, list):
                multi.add(name)
    return Schema(fields, multi & fields.keys())


def infer_json(lines: DataFrame, source: str = "_source", seq: str | None = None) -> Schema:
    """The schema of a column of JSON objects, inferred over all rows; seq names a column with their order.

    Each task reduces its rows to one row a field, so what reaches the driver
    is bounded by fields times partitions of one small aggregation.
    """

    def run(frames):
        first: dict[str, tuple[str, tuple]] = {}
        many: set[str] = set()
        for f in frames:
            for text, at in zip(f["s"], f["at"]):
                try:
                    doc = json.loads(text) if text else None
                except ValueError:
                    continue
                if not isinstance(doc, dict):
                    continue
                at = tuple(at)
                for name, x in flatten(doc):
                    if name in SYSTEM:
                        continue
                    if isinstance(x, list):
                        many.add(name)
                    if (name not in first or at < first[name][1]) and (kind := infer_value(x)):
                        first[name] = (kind, at)
        names = [*first, *(many - first.keys())]
        yield pd.DataFrame({"name": pd.Series(names, dtype=str), "kind": pd.Series([first.get(n, (None, None))[0] for n in names], dtype=object), "at": pd.Series([first.get(n, (None, None))[1] for n in names], dtype=object), "multi": pd.Series([n in many for n in names], dtype=bool)})

    order = F.col(seq) if seq else F.array(F.monotonically_increasing_id())
    rows = lines.select(F.col(source).alias("s"), order.alias("at")).mapInPandas(run, "name string, kind string, at array<long>, multi boolean")
    found = rows.groupBy("name").agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("at"))).alias("kind"), F.max("multi").alias("multi")).collect()
    fields = {r["name"]: r["kind"] for r in found if r["kind"]}
    return Schema(fields, {r["name"] for r in found if r["multi"] and r["kind"]})


def _columnar(t: T.DataType) -> str | None:
    match t:
        case T.StringType():
            return "keyword"
        case T.BooleanType():
            return "boolean"
        case T.DecimalType():
            return None
        case T.NumericType():
            return "numeric"
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return "date"
    return None


def infer_struct(struct: T.StructType, path: str = "") -> Schema:
    """The schema of typed columns; names with a leading underscore are left out at every level."""
    fields: dict[str, str] = {}
    multi: set[str] = set()
    for f in struct.fields:
        if f.name.startswith("_"):
            continue
        name, t = (f"{path}.{f.name}" if path else f.name), f.dataType
        if isinstance(t, T.StructType):
            inner = infer_struct(t, name)
            fields |= inner.fields
            multi |= inner.multi
            continue
        many = isinstance(t, T.ArrayType)
        if kind := _columnar(t.elementType if many else t):
            fields[name] = kind
            if many:
                multi.add(name)
    return Schema(fields, multi)
