"""Top-k search: matching, scoring, sorting, paging and projection, over one or two tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryParseError, SchemaError
from ..plans import dsl as json_dsl
from ..plans import nodes as n
from ..plans import querystring
from ..plans.compile import Corpus, Predicates, Scores, quoted


def query_tree(schema, query: str | None = None, filter: str | None = None, dsl: str | dict | None = None) -> n.Node:
    """The tree of a query string with an optional filter, or of a JSON query."""
    if dsl is not None:
        if query is not None or filter is not None:
            raise QueryParseError("give a query string or a JSON query, not both")
        return json_dsl.parse(dsl)
    if query is None and filter is None:
        raise QueryParseError("a query, a filter or a JSON query is needed")
    if query is None or filter is None:
        return querystring.parse(query if filter is None else filter, schema)
    return querystring.parse(f"({query}) AND ({filter})", schema)


def matching(corpus: Corpus, node: n.Node) -> Column:
    """The predicate of a tree, checked against the schema."""
    p = Predicates(corpus)
    p(node)  # the whole tree is checked, clauses that simplify away as well
    return p(n.simplify(node))


def parse_sort(sort: str, corpus: Corpus) -> tuple[str, bool]:
    """(field, ascending) of ``field``, ``field:asc`` or ``field:desc``; descending unless asc is said."""
    name, colon, way = sort.rpartition(":")
    if not colon:
        name, way = sort, "desc"
    kind = corpus.schema.kind(name)
    if kind not in ("numeric", "date"):
        raise SchemaError(f"cannot sort by '{name}': it is {kind}, not numeric or date")
    if corpus.many(name):
        raise SchemaError(f"cannot sort by '{name}': it has several values")
    return name, way == "asc"


def projected(corpus: Corpus, fields: list[str] | None) -> list[str]:
    """The top-level columns to return; unknown names are ignored, the id is always there."""
    hidden = {corpus.id, *corpus.stored.values()}
    every = [c for c in corpus.df.columns if c not in hidden]
    return [c for c in every if fields is None or c in fields]


def search(
    corpus: Corpus,
    query: str | None = None,
    *,
    filter: str | None = None,
    dsl: str | dict | None = None,
    limit: int | None = 20,
    offset: int = 0,
    fields: list[str] | None = None,
    sort: str | None = None,
    score: bool = False,
) -> DataFrame:
    """The best documents: ``_id``, the projected columns and, if asked for, ``_score``.

    Ordered by score and id, or by the sort field (missing values last, the
    score is then 0).  ``limit=None`` returns all matches, unordered.
    """
    tree = query_tree(corpus.schema, query, filter, dsl)
    corpus = corpus.cut(tree)
    out = [F.col(quoted(corpus.id)).alias("_id")] + [F.col(quoted(c)) for c in projected(corpus, fields)]
    if limit == 0:
        empty = corpus.df.limit(0).select(*out)
        return empty.withColumn("_score", F.lit(0.0)) if score else empty
    order = parse_sort(sort, corpus) if sort else None
    where = matching(corpus, tree)
    hits = corpus.df.filter(where)
    ranked = order is None and (limit is not None or score)
    key = "__lf_score"
    if ranked:
        hits = hits.withColumn(key, F.nanvl(Scores(corpus).column(n.simplify(tree)), F.lit(0.0)))
    else:
        hits = hits.withColumn(key, F.lit(0.0))
    if limit is not None:
        if order is None:
            hits = hits.orderBy(F.desc(key), F.asc(quoted(corpus.id)))
        else:
            c = corpus.column(order[0])
            hits = hits.orderBy(c.asc_nulls_last() if order[1] else c.desc_nulls_last(), F.asc(quoted(corpus.id)))
        if offset:
            hits = hits.offset(offset)
        hits = hits.limit(limit)
    if score:
        out.append(F.col(key).alias("_score"))
    return hits.select(*out)


def get(corpus: Corpus, doc_id, fields: list[str] | None = None) -> DataFrame:
    """The document with this id, as a DataFrame of at most one row."""
    where = Predicates(corpus).equal("_id", str(doc_id), False)
    return corpus.df.filter(where).limit(1).select(F.col(quoted(corpus.id)).alias("_id"), *[F.col(quoted(c)) for c in projected(corpus, fields)])


def merged(base: DataFrame, gap: DataFrame, removed: DataFrame | None = None, *, id: str = "_id", tier: str | None = None) -> DataFrame:
    """The always-fresh view: base documents that the gap neither replaces nor removes, and the gap's.

    gap has one row an id (see :func:`lakefind.operators.mutate.last_wins`).  The
    ids are joined by a left anti join whose side Spark broadcasts if it is
    small.  tier names a column that says which side a row is from (0 is the gap).
    """
    ids = gap.select(F.col(quoted(id)).alias("__lf_gone"))
    if removed is not None:
        ids = ids.unionByName(removed.select(F.col(quoted(id)).alias("__lf_gone")))
    rest = base.join(ids, F.col(quoted(id)) == F.col("__lf_gone"), "left_anti")
    if tier:
        rest, gap = rest.withColumn(tier, F.lit(1)), gap.withColumn(tier, F.lit(0))
    return rest.unionByName(gap, allowMissingColumns=True)
