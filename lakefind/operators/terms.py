"""The term dictionary of an index: which segments have a token, and in how many documents.

Beside every write of data files, ``terms/<write>`` holds (file, field, term,
docs) for the tokens of the text fields, sorted by term, and the total length of
each field under the empty term.  A search looks up its few words, then reads
only the segments that can match, and takes its BM25 statistics from there: a
rare word in a large index touches a few files instead of all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import analysis
from ..plans import nodes as n
from ..plans.compile import TOKENS, Corpus, quoted
from ..sources.table import Snapshot, VersionedTable, data_file

Words = set[tuple[str, str]]
Found = dict[tuple[str, str], dict[str, int]]
SCHEMA = "file string, field string, term string, docs long"


def write(table: VersionedTable, files: dict[str, int], struct) -> None:
    """Put the terms of newly written files beside them."""
    fields = [f[len(TOKENS) :] for f in struct.names if f.startswith(TOKENS)]
    if not files or not fields:
        return
    rows = table.files(files, struct).select(F.input_file_name().alias("file"), *[F.col(quoted(TOKENS + f)) for f in fields])
    parts = []
    for f in fields:
        c = F.col(quoted(TOKENS + f))
        parts.append(rows.select("file", F.lit(f).alias("field"), F.explode(F.array_distinct(c)).alias("term"), F.lit(1).alias("k")))
        parts.append(rows.select("file", F.lit(f).alias("field"), F.lit("").alias("term"), F.coalesce(F.size(c), F.lit(0)).alias("k")))
    out = reduce(DataFrame.unionAll, parts).groupBy("file", "field", "term").agg(F.sum("k").cast("long").alias("docs"))
    (write_id,) = {p.split("/")[1] for p in files}
    out.repartition("term").sortWithinPartitions("field", "term").write.parquet(f"{table.path}/terms/{write_id}")


def tokens_of(node: n.Node, c: Corpus) -> list[str] | None:
    """The tokens that a leaf on a text field asks for; None for other leaves."""
    match node:
        case n.Term(f, v) if c.schema.fields.get(f) == "text" and isinstance(v, str):
            return [v]
        case n.Match(f, text, _) | n.Phrase(f, text, _) if c.schema.fields.get(f) == "text":
            return list(dict.fromkeys(analysis.analyze(text, c.analyzer)))
    return None


def wanted(node: n.Node, c: Corpus) -> Words:
    """All (field, token) of a tree that the dictionary can tell about."""
    match node:
        case n.Boost():
            return wanted(node.node, c)
        case n.Bool():
            return set().union(*(wanted(x, c) for x in (*node.must, *node.should, *node.filter, *node.must_not)))
    return {(node.field, w) for w in tokens_of(node, c) or ()}


def lookup(table: VersionedTable, s: Snapshot, words: Words) -> Found:
    """The segments of a snapshot that have each word, with document counts; fields' lengths under the empty term."""
    ids = sorted({p.split("/")[1] for p in s.files})
    if not words or not ids:
        return {}
    fields = {f for f, _ in words}
    terms = {w for _, w in words} | {""}
    d = table.spark.read.schema(SCHEMA).parquet(*[f"{table.path}/terms/{i}" for i in ids])
    out: Found = {w: {} for w in words}
    for r in d.where(F.col("term").isin(sorted(terms)) & F.col("field").isin(sorted(fields))).collect():
        if (p := data_file(r["file"])) in s.files:
            out.setdefault((r["field"], r["term"]), {})[p] = r["docs"]
    return out


def candidates(node: n.Node, c: Corpus, found: Found, every: set[str]) -> set[str]:
    """The segments that can have a match."""
    match node:
        case n.MatchNone():
            return set()
        case n.Boost():
            return candidates(node.node, c, found, every)
        case n.Bool():
            musts = [candidates(x, c, found, every) for x in (*node.must, *node.filter)]
            if not musts and node.should:
                return set().union(*(candidates(x, c, found, every) for x in node.should))
            return set.intersection(every, *musts)
    words = tokens_of(node, c)
    if words is None:
        return every
    having = [set(found.get((node.field, w), ())) for w in words]
    if not having:
        return set()
    some = isinstance(node, n.Match) and not node.every
    return set.union(*having) if some else set.intersection(*having)


def statistics(s: Snapshot, found: Found) -> dict[tuple, float]:
    """The corpus statistics that the dictionary holds, under the keys of the scores."""
    out: dict[tuple, float] = {("n",): s.rows}
    for (f, w), by in found.items():
        out["df", f, w] = sum(by.values())
        out["len", f] = sum(found.get((f, ""), {}).values())
    return out
