"""Bucket and metric aggregations over the documents that match.

A request is JSON: ``{name: {kind: options, "aggs": {...}}}``.  Every path of
buckets is one ``groupBy`` on the keys of the whole path, with all metrics of
that level in the same pass; :func:`frame` gives the DataFrame of one path,
:func:`top_hits` the best documents of its buckets, and :func:`aggregate` renders
nested buckets.  Text fields cannot be aggregated.  A document without the field
counts nowhere unless the aggregation names a ``missing`` value.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParseError, SchemaError
from ..plans.compile import Corpus, Predicates, quoted

BUCKETS = ("terms", "range", "histogram", "date_histogram")
METRICS = ("avg", "sum", "min", "max", "value_count", "count", "stats", "extended_stats", "percentiles", "cardinality", "top_hits")
PERCENTS = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
#: Empty buckets that a histogram may fill in.
MAX_BUCKETS = 65_000
_UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


@dataclass
class Agg:
    name: str
    kind: str
    options: dict
    subs: list[Agg] = field(default_factory=list)

    @property
    def bucket(self) -> bool:
        return self.kind in BUCKETS


def parse(request: str | dict) -> list[Agg]:
    """The aggregations of a request."""
    if isinstance(request, str):
        try:
            request = json.loads(request)
        except ValueError as e:
            raise QueryParseError(f"aggregation parse error: {e}") from e
    if not isinstance(request, dict):
        raise QueryParseError("aggregation parse error: expected an object")
    out = []
    for name, body in request.items():
        if not isinstance(body, dict):
            raise QueryParseError(f"aggregation parse error: '{name}' is no object")
        subs = body.get("aggs", body.get("aggregations", {}))
        kinds = [k for k in body if k not in ("aggs", "aggregations")]
        if len(kinds) != 1 or kinds[0] not in BUCKETS + METRICS:
            raise QueryParseError(f"aggregation parse error: '{name}' needs one of {', '.join(BUCKETS + METRICS)}")
        a = Agg(name, kinds[0], body[kinds[0]], parse(subs))
        if not isinstance(a.options, dict) or a.kind != "top_hits" and not isinstance(a.options.get("field"), str):
            raise QueryParseError(f"aggregation parse error: '{name}' needs a field")
        if a.subs and not a.bucket:
            raise QueryParseError(f"aggregation parse error: '{name}' is a metric and has no sub-aggregations")
        out.append(a)
    return out


def _column(c: Corpus, a: Agg, kinds: tuple[str, ...] | None = None) -> Column:
    f = a.options["field"]
    kind = c.schema.kind(f)
    if kind == "text":
        raise SchemaError(f"aggregation '{a.name}': text field '{f}' cannot be aggregated")
    if kinds and kind not in kinds:
        raise SchemaError(f"aggregation '{a.name}': field '{f}' is {kind}")
    col, absent = c.column(f), a.options.get("missing")
    if absent is None:
        return col
    one = Predicates(c).literal(f, absent)
    if not c.many(f):
        return F.coalesce(col, one)
    some = F.exists(col, lambda x: x.isNotNull())
    return F.when(some, col).otherwise(F.array(one))


def micros(c: Corpus, name: str, col: Column) -> Column:
    """The values of a date field as microseconds since 1970."""
    t = c.dtype(name)
    return F.unix_micros(col.cast("timestamp") if not isinstance(t, T.TimestampType) else col)


def interval_micros(text: str) -> int:
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text or "")
    if not m or not int(m[1]):
        raise QueryParseError(f"aggregation parse error: bad interval '{text}'")
    return int(m[1]) * _UNITS[m[2]]


def _number(a: Agg, name: str, default=None) -> float:
    v = a.options.get(name, default)
    if isinstance(v, bool) or not isinstance(v, int | float):
        raise QueryParseError(f"aggregation parse error: '{a.name}' needs a number '{name}'")
    return float(v)


def _ranges(a: Agg) -> list[tuple[str, float | None, float | None]]:
    given = a.options.get("ranges")
    if not isinstance(given, list) or not given or not all(isinstance(r, dict) for r in given):
        raise QueryParseError(f"aggregation parse error: '{a.name}' needs 'ranges'")
    show = lambda x: "*" if x is None else repr(float(x)).removesuffix(".0") if float(x).is_integer() else repr(float(x))
    return [(r.get("key") or f"{show(r.get('from'))}-{show(r.get('to'))}", r.get("from"), r.get("to")) for r in given]


def _inside(lo: float | None, hi: float | None):
    return lambda v: (v >= lo if lo is not None else F.lit(True)) & (v < hi if hi is not None else F.lit(True)) & v.isNotNull()


def _keys(c: Corpus, a: Agg) -> Column:
    """The bucket keys of a document: an array, for several values or overlapping ranges, else one key or null."""
    f = a.options["field"]
    many = c.many(f)
    match a.kind:
        case "terms":
            col = _column(c, a)
            return F.array_distinct(F.filter(col, lambda x: x.isNotNull())) if many else col
        case "histogram":
            col = _column(c, a, ("numeric",))
            step, off = _number(a, "interval"), _number(a, "offset", 0)
            if step <= 0:
                raise QueryParseError(f"aggregation parse error: '{a.name}' needs an interval above 0")
            key = lambda x: F.floor((x.cast("double") - off) / step) * F.lit(step) + F.lit(off)
        case "date_histogram":
            col = _column(c, a, ("date",))
            step = interval_micros(a.options.get("fixed_interval", a.options.get("interval", "")))
            if many:
                raise SchemaError(f"aggregation '{a.name}': field '{f}' has several values")
            m = micros(c, f, col)
            return ((m - F.pmod(m, F.lit(step))) / 1000).cast("long")
        case "range":
            kind = c.schema.kind(f)
            col = _column(c, a, ("numeric", "date"))
            x = micros(c, f, col) / 1000 if kind == "date" else col
            parts = []
            for key, lo, hi in _ranges(a):
                ok = _inside(lo, hi)
                parts.append(F.when(F.exists(x, ok) if many else ok(x), F.lit(key)))
            return F.array_compact(F.array(*parts))
        case _:
            raise AssertionError(a.kind)
    return F.array_distinct(F.transform(F.filter(col, lambda x: x.isNotNull()), key)) if many else key(col)


def _with_key(c: Corpus, df: DataFrame, a: Agg, name: str) -> DataFrame:
    keys = _keys(c, a)
    df = df.withColumn(name, keys)
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return df.withColumn(name, F.explode(name))
    return df.where(F.col(name).isNotNull())


def _metric(c: Corpus, a: Agg, exact: bool) -> dict[str, Column]:
    """The aggregate columns of a metric, by their part's name ("" for the only one)."""
    f = a.options["field"]
    col = _column(c, a, None if a.kind in ("value_count", "count", "cardinality") else ("numeric", "date"))
    x = micros(c, f, col) / 1000 if c.schema.kind(f) == "date" and not c.many(f) and a.kind not in ("value_count", "count", "cardinality") else col
    many = c.many(f)
    if many:
        if a.kind in ("percentiles", "cardinality", "extended_stats"):
            raise SchemaError(f"aggregation '{a.name}': field '{f}' has several values")
        values = F.filter(x, lambda v: v.isNotNull())
        plus = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) if a.kind not in ("value_count", "count") else None
        count, total = F.coalesce(F.sum(F.size(values)), F.lit(0)), F.sum(plus)
        low, high, mean = F.min(F.array_min(values)), F.max(F.array_max(values)), total / F.when(count > 0, count)
    else:
        count, total, low, high, mean = F.count(x), F.sum(x), F.min(x), F.max(x), F.avg(x)
    real = lambda v: v.cast("double")
    total = F.coalesce(real(total), F.lit(0.0))
    match a.kind:
        case "avg":
            return {"": real(mean)}
        case "sum":
            return {"": total}
        case "min":
            return {"": real(low)}
        case "max":
            return {"": real(high)}
        case "value_count" | "count":
            return {"": count.cast("long")}
        case "cardinality":
            return {"": (F.count_distinct(x) if exact else F.approx_count_distinct(x)).cast("long")}
        case "stats":
            return {"count": count.cast("long"), "min": real(low), "max": real(high), "sum": total, "avg": real(mean)}
        case "extended_stats":
            return {"count": count.cast("long"), "min": real(low), "max": real(high), "sum": total, "avg": real(mean), "variance": F.var_pop(x), "std_deviation": F.stddev_pop(x)}
    percents = a.options.get("percents", PERCENTS)
    if not isinstance(percents, list | tuple) or not percents or not all(isinstance(p, int | float) and 0 <= p <= 100 for p in percents):
        raise QueryParseError(f"aggregation parse error: '{a.name}' needs 'percents' from 0 to 100")
    one = F.percentile if exact else F.percentile_approx
    # one sketch for all the percents
    return {"values": one(real(x), F.array(*[F.lit(float(p) / 100) for p in percents]))}


def _order(a: Agg) -> tuple[str, bool]:
    """(what, descending) of a terms aggregation's order."""
    o = a.options.get("order", {"_count": "desc"})
    if not isinstance(o, dict) or len(o) != 1:
        raise QueryParseError(f"aggregation parse error: '{a.name}' has a bad order")
    what, way = next(iter(o.items()))
    return what, way == "desc"


def _column_name(a: Agg, part: str) -> str:
    return f"{a.name}.{part}" if part else a.name


def _level(c: Corpus, df: DataFrame, keys: list[str], metrics: list[Agg], exact: bool) -> DataFrame:
    cols = [F.count(F.lit(1)).alias("doc_count")]
    for m in metrics:
        if m.kind == "top_hits":
            continue
        cols += [x.alias(_column_name(m, part)) for part, x in _metric(c, m, exact).items()]
    return df.groupBy(*[quoted(k) for k in keys]).agg(*cols)


def _buckets_of(corpus: Corpus, aggs: list[Agg], path: list[str], where: Column | None) -> tuple[DataFrame, list[Agg]]:
    """The documents with a column for each bucket key of the path, and the aggregations below it."""
    df = corpus.df if where is None else corpus.df.filter(where)
    for name in path:
        a = next((x for x in aggs if x.name == name and x.bucket), None)
        if a is None:
            raise QueryParseError(f"no bucket aggregation '{name}'")
        df = _with_key(corpus, df, a, name)
        aggs = a.subs
    return df, aggs


def frame(corpus: Corpus, request: str | dict | list[Agg], path: list[str] | None = None, *, where: Column | None = None, exact: bool = False) -> DataFrame:
    """One level of a request as a DataFrame: the keys of the path's buckets, doc_count and the level's metrics.

    All buckets are returned; size and order are of :func:`aggregate`.  exact
    makes percentiles and cardinality exact instead of sketches.
    """
    df, aggs = _buckets_of(corpus, request if isinstance(request, list) else parse(request), path or [], where)
    return _level(corpus, df, path or [], [a for a in aggs if not a.bucket], exact)


def top_hits(corpus: Corpus, request: str | dict | list[Agg], path: list[str], name: str, *, where: Column | None = None) -> DataFrame:
    """The best documents of every bucket of a path: its keys, rank from 1, ``_id`` and the fields asked for.

    Spark limits the rows of a bucket before they are shuffled.
    """
    df, aggs = _buckets_of(corpus, request if isinstance(request, list) else parse(request), path, where)
    a = next((x for x in aggs if x.name == name and x.kind == "top_hits"), None)
    if a is None:
        raise QueryParseError(f"no top_hits aggregation '{name}'")
    size, skip, order, fields = _hits_options(corpus, a)
    ident = F.col(quoted(corpus.id))
    df = df.select(*[F.col(quoted(k)) for k in path], ident.alias("__lf_id"), *[c.alias(f"__lf_o{i}") for i, (c, _) in enumerate(order)], *[corpus.column(f).alias("__lf_f_" + f) for f in fields])
    by = [F.col(f"__lf_o{i}").asc_nulls_last() if up else F.col(f"__lf_o{i}").desc_nulls_last() for i, (_, up) in enumerate(order)]
    keys = [F.col(quoted(k)) for k in path] or [F.lit(0)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by, "__lf_id"))
    best = df.withColumn("__lf_rank", rank).where(F.col("__lf_rank") <= skip + size).where(F.col("__lf_rank") > skip)
    return best.select(*[F.col(quoted(k)) for k in path], F.col("__lf_rank").alias("rank"), F.col("__lf_id").alias("_id"), *[F.col(quoted("__lf_f_" + f)).alias(f) for f in fields])


def _hits_options(c: Corpus, a: Agg) -> tuple[int, int, list[tuple[Column, bool]], list[str]]:
    size, skip = a.options.get("size", 3), a.options.get("from", 0)
    if not all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in (size, skip)):
        raise QueryParseError(f"aggregation parse error: '{a.name}' has a bad size")
    given = a.options.get("sort", [])
    order = []
    for x in given if isinstance(given, list) else [given]:
        if isinstance(x, str):
            x = {x: "asc"}
        if not isinstance(x, dict) or len(x) != 1:
            raise QueryParseError(f"aggregation parse error: '{a.name}' has a bad sort")
        f, way = next(iter(x.items()))
        way = way.get("order", "asc") if isinstance(way, dict) else way
        if c.schema.kind(f) == "text" or c.many(f):
            raise SchemaError(f"aggregation '{a.name}': cannot sort by '{f}'")
        order.append((c.column(f), way == "asc"))
    fields = a.options.get("_source", a.options.get("docvalue_fields", list(c.schema.fields)))
    if not isinstance(fields, list) or not all(isinstance(f, str) for f in fields):
        raise QueryParseError(f"aggregation parse error: '{a.name}' needs a list of fields")
    return size, skip, order, [f for f in fields if f in c.schema.fields]


def _render(a: Agg, row) -> dict:
    if a.kind in ("stats", "extended_stats"):
        return {p: row[_column_name(a, p)] for p in ("count", "min", "max", "sum", "avg", "variance", "std_deviation") if _column_name(a, p) in row}
    if a.kind == "percentiles":
        found = row[_column_name(a, "values")]
        percents = a.options.get("percents", PERCENTS)
        return {"values": {str(float(p)): None if found is None else found[i] for i, p in enumerate(percents)}}
    return {"value": row[a.name]}


def _paths(aggs: list[Agg], path: tuple[str, ...] = ()):
    for a in aggs:
        if a.bucket:
            yield (*path, a.name), a
            yield from _paths(a.subs, (*path, a.name))


def _kept(c: Corpus, df: DataFrame, a: Agg, keys: list[str]) -> DataFrame:
    """For terms: at most size buckets under each parent, chosen by order; done before anything is collected."""
    if a.kind != "terms":
        return df
    least = a.options.get("min_doc_count", 1)
    size = a.options.get("size", 10)
    what, desc = _order(a)
    by = {"_count": "doc_count", "_key": a.name, "_term": a.name}.get(what, what)
    if by not in df.columns:
        raise QueryParseError(f"aggregation parse error: '{a.name}' cannot be ordered by '{what}'")
    first = F.col(quoted(by)).desc_nulls_last() if desc else F.col(quoted(by)).asc_nulls_last()
    order = [first, F.asc(quoted(a.name))]
    df = df.where(F.col("doc_count") >= least)
    if len(keys) == 1:
        return df.orderBy(*order).limit(size)
    w = Window.partitionBy(*[quoted(k) for k in keys[:-1]]).orderBy(*order)
    return df.withColumn("__lf_rank", F.row_number().over(w)).where(F.col("__lf_rank") <= size).drop("__lf_rank")


def _below(f: DataFrame, path: tuple[str, ...], shown: DataFrame | None) -> DataFrame:
    """The rows of a level below the buckets that are shown; those are few, and Spark knows how many."""
    if shown is None:
        return f
    parent = shown.select(*[F.col(quoted(k)).alias("__p_" + k) for k in path])
    return f.join(parent, [F.col(quoted(k)).eqNullSafe(F.col(quoted("__p_" + k))) for k in path], "left_semi")


def aggregate(corpus: Corpus, request: str | dict, *, where: Column | None = None, exact: bool = False) -> dict:
    """The result of a request as nested dicts.

    Only buckets that are shown reach the driver: a terms aggregation's size and
    order are applied by Spark, below every shown parent; other buckets are
    counted first.  Every path of buckets is one scan.
    """
    aggs = parse(request)
    spark = corpus.df.sparkSession
    tables: dict[tuple[str, ...], list[dict]] = {}
    hits: dict[tuple[str, ...], list[dict]] = {}
    shown: dict[tuple[str, ...], DataFrame | None] = {(): None}
    df = corpus.df if where is None else corpus.df.filter(where)
    metrics = [a for a in aggs if not a.bucket]
    for a in metrics:
        if a.kind != "top_hits":
            _metric(corpus, a, exact)
    top = _level(corpus, df, [], metrics, exact).first().asDict() if metrics else {}

    def best(level: list[Agg], path: tuple[str, ...]) -> None:
        for a in level:
            if a.kind == "top_hits":
                found = _below(top_hits(corpus, aggs, list(path), a.name, where=where), path, shown[path])
                hits[(*path, a.name)] = sorted((r.asDict() for r in found.collect()), key=lambda r: r["rank"])

    best(aggs, ())
    for path, a in _paths(aggs):
        f = _below(frame(corpus, aggs, list(path), where=where, exact=exact), path[:-1], shown[path[:-1]])
        f = _kept(corpus, f, a, list(path))
        rows = f.limit(MAX_BUCKETS + 1).collect()
        if len(rows) > MAX_BUCKETS:
            raise QueryParseError(f"aggregation '{a.name}': more than {MAX_BUCKETS} buckets")
        tables[path] = [r.asDict() for r in rows]
        if a.subs:
            keys = f.select(*[F.col(quoted(k)) for k in path]).schema
            shown[path] = spark.createDataFrame([tuple(r[k] for k in path) for r in rows], keys)
            best(a.subs, path)

    def render(level: list[Agg], path: tuple[str, ...], parent: dict, row: dict) -> dict:
        out = {}
        for a in level:
            if a.kind == "top_hits":
                mine = [r for r in hits[(*path, a.name)] if all(r[k] == v for k, v in parent.items())]
                out[a.name] = {"hits": {"total": {"value": row["doc_count"]}, "hits": [{k: v for k, v in r.items() if k != "rank" and k not in path} for r in mine]}}
                continue
            if not a.bucket:
                out[a.name] = _render(a, row)
                continue
            rows = [r for r in tables[(*path, a.name)] if all(r[k] == v for k, v in parent.items())]
            out[a.name] = {"buckets": _buckets(corpus, a, rows, lambda r, a=a: render(a.subs, (*path, a.name), parent | {a.name: r[a.name]}, r))}
        return out

    return render(aggs, (), {}, top)


def _key_value(c: Corpus, a: Agg, key):
    if isinstance(key, datetime):
        return int((key if key.tzinfo else key.replace(tzinfo=UTC)).timestamp() * 1000)
    return key


def _buckets(c: Corpus, a: Agg, rows: list[dict], inner) -> list[dict]:
    if a.kind == "terms":
        what, desc = _order(a)
        by = {"_count": "doc_count", "_key": a.name, "_term": a.name}.get(what, what)
        rows = sorted(rows, key=lambda r: r[a.name])
        rows.sort(key=lambda r: (r[by] is not None, r[by] if r[by] is not None else 0), reverse=desc)
        return [{"key": _key_value(c, a, r[a.name]), "doc_count": r["doc_count"], **inner(r)} for r in rows]
    have = {r[a.name]: r for r in rows}
    blank = dict.fromkeys(rows[0], None) if rows else {}
    if a.kind == "range":
        out = []
        for key, lo, hi in _ranges(a):
            r = have.get(key, {**blank, a.name: key, "doc_count": 0})
            bounds = {k: float(v) for k, v in (("from", lo), ("to", hi)) if v is not None}
            out.append({"key": key, **bounds, "doc_count": r["doc_count"], **(inner(r) if key in have else {})})
        return out
    least = a.options.get("min_doc_count", 0)
    keys = sorted(have)
    if keys and least == 0:
        step = interval_micros(a.options.get("fixed_interval", a.options.get("interval", ""))) / 1000 if a.kind == "date_histogram" else _number(a, "interval")
        n = round((keys[-1] - keys[0]) / step) + 1
        if n > MAX_BUCKETS:
            raise QueryParseError(f"aggregation '{a.name}': {n} buckets, more than {MAX_BUCKETS}")
        first = keys[0]
        near = {round((k - first) / step): k for k in keys}
        keys = [near.get(i, type(first)(first + i * step)) for i in range(n)]
    return [{"key": k, "doc_count": have[k]["doc_count"], **inner(have[k])} if k in have else {"key": k, "doc_count": 0} for k in keys if k in have or least == 0 if k not in have or have[k]["doc_count"] >= least]
