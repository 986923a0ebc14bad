"""From JSON documents to typed columns.

``_source`` holds the document as it came; every field of the schema becomes a
column, all by JVM expressions: over the parsed variant where documents come as
JSON, by casts where they come as typed columns, which are never parsed.  A value
that does not fit its field names the field in ``_error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentError
from ..functions import analysis
from ..functions.values import ip_key, to_timestamp
from ..plans.compile import TOKENS, quoted
from ..schema import SPARK_TYPES, Schema, infer_struct

_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


#: The typed columns that documents came from, as one struct.
ROW = "__lf_row"


def source_of(df: DataFrame, *keep: str) -> DataFrame:
    """``_id`` (null if there is none), ``_source`` (times as ISO text) and the row itself of a DataFrame of typed columns.

    keep names columns that are no part of the documents and stay beside them.
    """
    own = [c for c in df.columns if c not in keep]
    ident = F.col("`_id`").cast("string") if "_id" in own else F.lit(None).cast("string")
    row = F.struct(*[F.col(quoted(c)) for c in own])
    text = F.to_json(row, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC"})
    return df.select(ident.alias("_id"), text.alias("_source"), row.alias(ROW), *[F.col(quoted(c)) for c in keep])


def _path(name: str) -> list[str]:
    plain = "$" + "".join(f"['{p}']" for p in name.split("."))
    return [f"$['{name}']", plain] if "." in name else [plain]


def _leaf(v: Column, name: str) -> Column:
    """The variant at a field's path, the literal key first; null for null and objects."""
    found = F.coalesce(*[F.try_variant_get(v, p, "variant") for p in _path(name)])
    kind = F.schema_of_variant(found)
    return F.when(~(kind.startswith("OBJECT") | (kind == "VOID")), found)


def _value(x: Column, kind: str) -> Column:
    """One value in the field's type, null if it does not fit.  Addresses stay text here."""
    t = F.schema_of_variant(x)
    text = F.try_variant_get(x, "$", "string")
    match kind:
        case "numeric":
            return F.when(t.rlike(_NUMBER), F.try_variant_get(x, "$", "double"))
        case "boolean":
            return F.when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        case "date":
            return F.when(t == "STRING", to_timestamp(text))
        case "ip":
            return F.when(t == "STRING", text)
    return F.when(t.startswith("ARRAY") | t.startswith("OBJECT"), F.to_json(x)).otherwise(text)


def _reader(kind: str):
    return lambda x: _value(x, kind)


def _typed(row: T.StructType, name: str) -> tuple[Column, T.DataType] | None:
    """The column at a field's path in the row, the literal name first; None if there is none or it is an object."""
    if name in row.names:
        c, t = F.col(ROW).getField(name), row[name].dataType
    else:
        c, t = F.col(ROW), row
        for part in name.split("."):
            if not isinstance(t, T.StructType) or part not in t.names:
                return None
            c, t = c.getField(part), t[part].dataType
    return None if isinstance(t, T.StructType | T.NullType) else (c, t)


def _cast(x: Column, t: T.DataType, kind: str) -> Column:
    """:func:`_value` for a typed column."""
    nothing = F.lit(None).cast(SPARK_TYPES[kind])
    match kind:
        case "numeric":
            return x.cast("double") if isinstance(t, T.NumericType) else nothing
        case "boolean":
            return x if isinstance(t, T.BooleanType) else nothing
        case "date":
            if isinstance(t, T.StringType):
                return to_timestamp(x)
            return x.cast("timestamp") if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else nothing
        case "ip":
            return x if isinstance(t, T.StringType) else nothing
    if isinstance(t, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(x)
    if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType | T.BinaryType):
        # as the document's JSON has it
        one = F.to_json(F.struct(x.alias("x")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC"})
        return F.get_json_object(one, "$.x")
    return x.cast("string")


def _caster(t: T.DataType, kind: str):
    return lambda x: _cast(x, t, kind)


def build(docs: DataFrame, schema: Schema) -> DataFrame:
    """Typed documents of the columns ``_id`` and ``_source``; other columns are kept.

    An id that is null is taken from the document (numbers as decimal text) and
    made up if the document has none.  ``_error`` is null for a good document.
    """
    row = docs.schema[ROW].dataType if ROW in docs.columns else None
    parsed = docs if row is not None else docs.withColumn("__lf_v", F.try_parse_json("_source"))
    values: dict[str, Column] = {"_id": F.coalesce("_id", F.expr("uuid()"))}
    errors = []
    if row is None:
        ok = F.col("__lf_v").isNotNull() & F.schema_of_variant("__lf_v").startswith("OBJECT")
        errors.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit("the document is no JSON object")))
        values["_id"] = F.coalesce("_id", F.try_variant_get("__lf_v", "$['_id']", "string"), F.expr("uuid()"))
    derived: dict[str, Column] = {}
    for name, kind in schema.fields.items():
        c = F.col(quoted(name))
        many = name in schema.multi
        if row is not None:
            found = _typed(row, name)
            if found is None:
                values[name], bad = F.lit(None).cast(T.ArrayType(SPARK_TYPES[kind]) if many else SPARK_TYPES[kind]), F.lit(False)
            else:
                v, t = found
                if many:
                    items = v if isinstance(t, T.ArrayType) else F.when(v.isNotNull(), F.array(v))
                    each = t.elementType if isinstance(t, T.ArrayType) else t
                    values[name] = F.transform(F.filter(items, lambda x: x.isNotNull()), _caster(each, kind))
                    bad = F.exists(c, lambda x: x.isNull())
                else:
                    values[name] = _cast(v, t, kind)
                    bad = v.isNotNull() & c.isNull()
        else:
            v = _leaf(F.col("__lf_v"), name)
            if many:
                items = F.when(_is_array(v), F.try_variant_get(v, "$", "array<variant>")).when(v.isNotNull(), F.array(v))
                items = F.filter(items, lambda x: x.isNotNull() & (F.schema_of_variant(x) != "VOID"))
                values[name] = F.transform(items, _reader(kind))
                bad = F.exists(c, lambda x: x.isNull())
            else:
                values[name] = _value(v, kind)
                bad = v.isNotNull() & c.isNull()
        if kind == "ip":
            derived[name] = _ip_keys(c) if many else ip_key(c)
        if kind == "text":
            derived[TOKENS + name] = analysis.tokens(c, "en_stem", many)
        if kind not in ("keyword", "text"):
            errors.append(F.when(bad, F.lit(f"field '{name}': the value is no {kind}")))
    # all values in one projection, then what is derived from them in a second
    out = parsed.withColumns(values)
    if derived:
        out = out.withColumns(derived)
    return out.withColumn("_error", F.coalesce(*errors) if errors else F.lit(None).cast("string")).drop("__lf_v", ROW)


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def array_fields(docs: DataFrame, schema: Schema) -> set[str]:
    """The fields of the schema that some document has an array in."""
    if not schema.fields:
        return set()
    if ROW in docs.columns:
        return infer_struct(docs.schema[ROW].dataType).multi & schema.fields.keys()
    names = list(schema.fields)
    v = docs.select(F.try_parse_json("_source").alias("__lf_v"))
    row = v.agg(*[F.max(_is_array(_leaf(F.col("__lf_v"), f))).alias(f"c{i}") for i, f in enumerate(names)]).first()
    return {f for f, has in zip(names, row) if has}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _ip_keys(lists):
    from ..functions.values import _ip_or_none

    return lists.map(lambda xs: None if xs is None else [_ip_or_none(x) for x in xs])


def strict(docs: DataFrame) -> DataFrame:
    """The documents, if all are good; else the first error."""
    bad = docs.where(F.col("_error").isNotNull()).select("_id", "_error").limit(1).collect()
    if bad:
        raise DocumentError(f"document '{bad[0]['_id']}': {bad[0]['_error']}")
    return docs.drop("_error")


def lenient(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good documents, and the bad ones with their errors."""
    return docs.where(F.col("_error").isNull()).drop("_error"), docs.where(F.col("_error").isNotNull())


def column_names(schema: Schema) -> list[str]:
    """The columns of a built document without ``_error``, quoted."""
    return [quoted(c) for c in empty_struct(schema).names]


def empty_struct(schema: Schema):
    """The Spark schema of built documents."""

    def t(name: str):
        x = SPARK_TYPES[schema.fields[name]]
        return T.ArrayType(x) if name in schema.multi else x

    s = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_source", T.StringType())])
    for name in schema.fields:
        s = s.add(name, t(name))
    for name, kind in schema.fields.items():
        if kind == "text":
            s = s.add(TOKENS + name, T.ArrayType(T.StringType()))
    return s
