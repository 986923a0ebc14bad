"""From the query tree to Spark columns: a predicate and a BM25 score.

Leaf predicates stay on raw columns, so that they reach the Parquet scan.  The
query model has two truth values and SQL has three: below a NOT every leaf is
made two-valued (``<=>`` or ``AND IS NOT NULL``, which are pushed down, and
``coalesce`` only for arrays); elsewhere plain comparisons do.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryParseError, SchemaError
from ..functions import analysis
from ..functions.values import date_literal, ip_key, parse_date, parse_ip, wildcard_regex
from ..schema import Schema
from . import nodes as n

K1, B = 1.2, 0.75
#: Begins the name of a column with a text field's tokens.
TOKENS = "__tokens__"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Corpus:
    """Documents that can be searched: a DataFrame, its schema, and the column with the ids.

    Predicates and scores are columns over ``df`` of the corpus; :meth:`cut` gives
    the corpus whose ``df`` has the token columns that a query tree needs.

    ``columns`` gives fields that are no plain column an expression; struct
    fields are found by their path.  ``stored`` names columns that hold a text
    field's tokens already; ``ip_keys`` says that ip columns are normalised.
    ``known`` has corpus statistics that need not be computed, and ``whole`` all
    documents, where ``df`` holds only those that can match.
    """

    df: DataFrame
    schema: Schema
    id: str = "_id"
    analyzer: str = "en_stem"
    columns: dict[str, Column] = field(default_factory=dict)
    stored: dict[str, str] = field(default_factory=dict)
    ip_keys: bool = False
    known: dict[tuple, float] = field(default_factory=dict)
    whole: DataFrame | None = None

    def __post_init__(self):
        self.types = {f.name: f.dataType for f in self.df.schema.fields}

    def cut(self, node: n.Node) -> Corpus:
        """This corpus with a token column for each text field that the tree searches: texts are cut once for all its clauses.

        The columns come out of a Generate, which no predicate on them is pushed
        through (it would cut the texts again).  Only texts that have the letters
        of a match are cut (see :func:`possible`).
        """
        fields = sorted(f for f in text_fields(node, self.schema) if f not in self.stored)
        if not fields:
            return self
        made = {TOKENS + f: self.tokens(f) for f in fields}
        add = lambda df: df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))
        raw = possible(node, self)
        few = self.df if raw is None else self.df.filter(raw)
        return replace(self, df=add(few), whole=add(self.df if self.whole is None else self.whole), stored=self.stored | {f: TOKENS + f for f in fields})

    def column(self, name: str) -> Column:
        if name == "_id":
            return F.col(quoted(self.id))
        if name in self.columns:
            return self.columns[name]
        if name in self.types:
            return F.col(quoted(name))
        self.dtype(name)
        return F.col(".".join(quoted(x) for x in name.split(".")))

    def dtype(self, name: str) -> T.DataType:
        if name == "_id":
            return self.types[self.id]
        if name in self.columns:
            return self.df.select(self.columns[name].alias("x")).schema[0].dataType
        if name in self.types:
            return self.types[name]
        t: T.DataType = self.df.schema
        for part in name.split("."):
            if not isinstance(t, T.StructType) or part not in t.names:
                raise SchemaError(f"field '{name}' has no column")
            t = t[part].dataType
        return t

    def many(self, name: str) -> bool:
        return isinstance(self.dtype(name), T.ArrayType)

    def analyzer_of(self, name: str) -> str:
        return self.analyzer if self.schema.fields.get(name) == "text" else "raw"

    def tokens(self, name: str) -> Column:
        if name in self.stored:
            return F.col(quoted(self.stored[name]))
        return analysis.tokens(self.column(name), self.analyzer_of(name), self.many(name))

    def filter(self, where: Column) -> Corpus:
        return replace(self, df=self.df.filter(where))


def text_fields(node: n.Node, schema: Schema) -> set[str]:
    """The text fields whose tokens a tree looks at."""
    match node:
        case n.Boost():
            return text_fields(node.node, schema)
        case n.Bool():
            return set().union(*(text_fields(x, schema) for x in (*node.must, *node.should, *node.must_not, *node.filter)))
        case n.Term(f, _) | n.Terms(f, _) | n.Match(f, _, _) | n.Phrase(f, _, _) | n.PhrasePrefix(f, _) | n.Prefix(f, _) | n.Wildcard(f, _) if schema.fields.get(f) == "text":
            return {f}
    return set()


def possible(node: n.Node, c: Corpus) -> Column | None:
    """What every match of a tree fulfils, as a predicate on raw columns that needs no tokens; None if there is nothing."""

    def both(parts) -> Column | None:
        parts = [p for p in parts if p is not None]
        return reduce(Column.__and__, parts) if parts else None

    def either(parts) -> Column | None:
        parts = list(parts)
        return reduce(Column.__or__, parts) if parts and all(p is not None for p in parts) else None

    def letters(f: str, words) -> list[Column | None]:
        has = [analysis.letters(w, c.analyzer) for w in words]
        return [F.contains(F.lower(c.column(f)), F.lit(x)) if x and not c.many(f) else None for x in has]

    match node:
        case n.Boost():
            return possible(node.node, c)
        case n.Bool():
            musts = [possible(x, c) for x in (*node.must, *node.filter)]
            if not musts and node.should:
                return either(possible(x, c) for x in node.should)
            return both(musts)
        case n.Term(f, v) if c.schema.fields.get(f) == "text":
            return letters(f, [v])[0] if isinstance(v, str) else None
        case n.Terms(f, vs) if c.schema.fields.get(f) == "text":
            return either(letters(f, vs)) if all(isinstance(v, str) for v in vs) else None
        case n.Match(f, text, every) if c.schema.fields.get(f) == "text":
            return (both if every else either)(letters(f, dict.fromkeys(analysis.analyze(text, c.analyzer))))
        case n.Phrase(f, text, _) if c.schema.fields.get(f) == "text":
            return both(letters(f, dict.fromkeys(analysis.analyze(text, c.analyzer))))
        case n.PhrasePrefix(f, text) | n.Prefix(f, text) if c.schema.fields.get(f) == "text":
            return both(letters(f, analysis.analyze(text, c.analyzer)[:-1]))
        case n.MatchAll() | n.MatchNone() | n.Wildcard():
            return None
    return Predicates(c)(node)


class Predicates:
    """Predicates of a corpus's query trees; checks fields and types as it goes."""

    def __init__(self, corpus: Corpus):
        self.c = corpus

    def kind(self, f: str, system: bool = False) -> str:
        if f == "_id" and system:
            return "keyword"
        return self.c.schema.kind(f)

    def string_kind(self, f: str, what: str, system: bool = False) -> str:
        k = self.kind(f, system)
        if k not in ("keyword", "text"):
            raise QueryParseError(f"{what}: field '{f}' is {k}, not keyword or text")
        return k

    def literal(self, f: str, value) -> Column:
        """A literal of the field's type, in the column's own type so that no cast hides the column."""
        k = self.kind(f, True)
        t = self.c.dtype(f)
        t = t.elementType if isinstance(t, T.ArrayType) else t
        match k:
            case "keyword" | "text":
                text = value if isinstance(value, str) else json.dumps(value)
                if isinstance(t, T.IntegralType) and text.lstrip("-").isdecimal() and str(int(text)) == text:
                    return F.lit(int(text)).cast(t) if abs(int(text)) < 2**31 else F.lit(int(text))
                return F.lit(text)
            case "numeric":
                if isinstance(value, bool) or not isinstance(value, int | float):
                    raise QueryParseError(f"field '{f}' needs a number, not {value!r}")
                if isinstance(t, T.IntegralType) and float(value).is_integer() and abs(value) < 2**31:
                    return F.lit(int(value)).cast(t)
                return F.lit(float(value))
            case "date":
                if not isinstance(value, str):
                    raise QueryParseError(f"field '{f}' needs a date, not {value!r}")
                return date_literal(parse_date(value), t)
            case "boolean":
                if value not in (True, False, "true", "false") or isinstance(value, int | float) and not isinstance(value, bool):
                    raise QueryParseError(f"field '{f}' needs true or false, not {value!r}")
                return F.lit(value in (True, "true"))
            case "ip":
                if not isinstance(value, str):
                    raise QueryParseError(f"field '{f}' needs an address, not {value!r}")
                return F.lit(parse_ip(value))
        raise AssertionError(k)

    def operand(self, f: str) -> Column:
        c = self.c.column(f)
        if self.kind(f, True) == "ip" and not self.c.ip_keys:
            if self.c.many(f):
                raise SchemaError(f"field '{f}': arrays of addresses can be searched in an index only")
            return ip_key(c)
        if f == "_id" and not isinstance(self.c.dtype(f), T.StringType | T.IntegralType):
            return c.cast("string")
        return c

    def each(self, f: str, test: Callable[[Column], Column], safe: bool) -> Column:
        """Whether any value of the field passes."""
        c = self.operand(f)
        if self.c.many(f):
            p = F.exists(c, test)
            return F.coalesce(p, F.lit(False)) if safe else p
        return test(c) & c.isNotNull() if safe else test(c)

    def equal(self, f: str, value, safe: bool) -> Column:
        c = self.operand(f)
        v = self.literal(f, value)
        if self.kind(f, True) == "keyword" and isinstance(self.c.dtype(f), T.IntegralType) and not str(value).lstrip("-").isdecimal():
            return F.lit(False)
        if self.c.many(f):
            p = F.array_contains(c, v)
            return F.coalesce(p, F.lit(False)) if safe else p
        return c.eqNullSafe(v) if safe else c == v

    def has_token(self, f: str, token: str, safe: bool) -> Column:
        p = F.array_contains(self.c.tokens(f), token)
        return F.coalesce(p, F.lit(False)) if safe else p

    def joined(self, f: str) -> Column:
        return F.concat(F.lit(" "), F.array_join(self.c.tokens(f), " "), F.lit(" "))

    def __call__(self, node: n.Node, safe: bool = False) -> Column:
        """The predicate; with safe, never null."""
        match node:
            case n.MatchAll():
                return F.lit(True)
            case n.MatchNone():
                return F.lit(False)
            case n.Boost():
                return self(node.node, safe)
            case n.Term(f, v):
                if self.kind(f) == "text":
                    if not isinstance(v, str):
                        v = json.dumps(v)
                    p = F.array_contains(self.c.tokens(f), v)
                    return F.coalesce(p, F.lit(False)) if safe else p
                return self.equal(f, v, safe)
            case n.Terms(f, vs):
                if not vs:
                    self.kind(f)
                    return F.lit(False)
                if self.kind(f) == "text" or self.c.many(f):
                    return reduce(Column.__or__, (self(n.Term(f, v), safe) for v in vs))
                c = self.operand(f)
                p = c.isin([self.literal(f, v) for v in vs])
                return p & c.isNotNull() if safe else p
            case n.Match(f, text, every):
                if self.string_kind(f, "match", True) == "keyword":
                    return self.equal(f, text, safe)
                words = list(dict.fromkeys(analysis.analyze(text, self.c.analyzer)))
                if not words:
                    return F.lit(False)
                return reduce(Column.__and__ if every else Column.__or__, (self.has_token(f, w, safe) for w in words))
            case n.Phrase(f, text, slop):
                if self.string_kind(f, "match_phrase", True) == "keyword":
                    return self.equal(f, text, safe)
                words = analysis.analyze(text, self.c.analyzer)
                if len(words) < 2:
                    return self.has_token(f, words[0], safe) if words else F.lit(False)
                every = reduce(Column.__and__, (self.has_token(f, w, safe) for w in dict.fromkeys(words)))
                if slop:
                    return every & (F.coalesce(self.sloppy(f, words, slop), F.lit(False)) if safe else self.sloppy(f, words, slop))
                p = F.contains(self.joined(f), F.lit(f" {' '.join(words)} "))
                return every & (F.coalesce(p, F.lit(False)) if safe else p)
            case n.PhrasePrefix(f, text):
                words = analysis.analyze(text, self.c.analyzer)
                if not words:
                    return F.lit(False)
                p = F.contains(self.joined(f), F.lit(" " + " ".join(words)))
                return F.coalesce(p, F.lit(False)) if safe else p
            case n.Range():
                return self.between(node, safe)
            case n.Exists(f):
                self.kind(f)
                return self.c.column(f).isNotNull()
            case n.Prefix(f, v):
                if self.string_kind(f, "prefix") == "text":
                    return self(n.PhrasePrefix(f, v), safe)
                return self.each(f, lambda x: x.startswith(F.lit(v)), safe)
            case n.Wildcard(f, pattern):
                regex = wildcard_regex(pattern)
                if self.string_kind(f, "wildcard") == "text":
                    p = F.exists(self.c.tokens(f), lambda x: x.rlike(regex))
                    return F.coalesce(p, F.lit(False)) if safe else p
                return self.each(f, lambda x: x.rlike(regex), safe)
            case n.Bool():
                return self.boolean(node, safe)
        raise AssertionError(node)

    def boolean(self, b: n.Bool, safe: bool) -> Column:
        musts = [self(x, safe) for x in (*b.must, *b.filter)]
        shoulds = [self(x, safe) for x in b.should]
        out = musts + [~self(x, True) for x in b.must_not]
        if shoulds and not musts:
            out.append(reduce(Column.__or__, shoulds))
        return reduce(Column.__and__, out) if out else F.lit(True)

    def between(self, r: n.Range, safe: bool) -> Column:
        k = self.kind(r.field)
        if k not in ("numeric", "date"):
            raise QueryParseError(f"range: field '{r.field}' is {k}; only numeric and date fields have ranges")
        lo = self.literal(r.field, r.lower) if r.lower is not None else None
        hi = self.literal(r.field, r.upper) if r.upper is not None else None
        if lo is None and hi is None:
            return self.c.column(r.field).isNotNull()

        def inside(x: Column) -> Column:
            tests = []
            if lo is not None:
                tests.append(x >= lo if r.with_lower else x > lo)
            if hi is not None:
                tests.append(x <= hi if r.with_upper else x < hi)
            return reduce(Column.__and__, tests)

        return self.each(r.field, inside, safe)

    def sloppy(self, f: str, words: list[str], slop: int) -> Column:
        """Whether the words stand in order with at most slop other places between them, over all."""
        tok = self.c.tokens(f)

        def reach(i: Column) -> Column:
            # the end of the earliest way through the words from place i; null if there is none
            at = i
            for w in words[1:]:
                gap = F.array_position(F.slice(tok, at + 2, F.lit(slop + 1)), w)
                at = F.when(gap > 0, at + gap.cast("int"))
            return at

        def good(i: Column) -> Column:
            return (F.get(tok, i) == words[0]) & F.coalesce(reach(i) - i - (len(words) - 1) <= slop, F.lit(False))

        return F.when(F.size(tok) >= len(words), F.exists(F.sequence(F.lit(0), F.size(tok) - 1), good)).otherwise(False)

    def phrase_count(self, f: str, words: list[str]) -> Column:
        tok = self.c.tokens(f)
        places = F.sequence(F.lit(1), F.size(tok) - len(words) + 1)
        same = F.array(*[F.lit(w) for w in words])
        return F.when(F.size(tok) >= len(words), F.size(F.filter(places, lambda i: F.slice(tok, i, F.lit(len(words))) == same))).otherwise(0)


class Scores:
    """BM25 scores; the corpus statistics they need come from one aggregation."""

    def __init__(self, corpus: Corpus):
        self.c, self.p = corpus, Predicates(corpus)
        self.wanted: dict[tuple, Column] = {("n",): F.count(F.lit(1))}
        self.stats: dict[tuple, float] | None = None

    def stat(self, key: tuple, make: Callable[[], Column]) -> float:
        if self.stats is None:
            if key not in self.wanted:
                self.wanted[key] = make()
            return 1.0
        return self.stats[key]

    def idf(self, key: tuple, matches: Callable[[], Column]) -> float:
        total = self.stat(("n",), lambda: F.count(F.lit(1)))
        df = self.stat(("df", *key), lambda: F.count_if(matches()))
        return math.log(1 + (total - df + 0.5) / (df + 0.5))

    def text(self, f: str, words: list[str], tf: Column) -> Column:
        """BM25 of a token or a phrase with tf occurrences."""
        idf = sum(self.idf((f, w), lambda w=w: self.p.has_token(f, w, False)) for w in words)
        length = F.coalesce(F.size(self.c.tokens(f)), F.lit(0))
        total = self.stat(("n",), lambda: F.count(F.lit(1)))
        average = self.stat(("len", f), lambda: F.sum(length)) / max(total, 1) or 1.0
        tf = F.coalesce(tf.cast("double"), F.lit(0.0))
        return F.lit(idf) * (K1 + 1) * tf / (tf + K1 * (1 - B + B * length / F.lit(average)))

    def token(self, f: str, w: str) -> Column:
        return self.text(f, [w], F.size(F.filter(self.c.tokens(f), lambda x: x == w)))

    def exact(self, node: n.Node, key: tuple) -> Column:
        """A value that a field has or has not: one occurrence in a field of average length."""
        return F.when(self.p(node, True), F.lit(self.idf(key, lambda: self.p(node)))).otherwise(0.0)

    def __call__(self, node: n.Node) -> Column:
        match node:
            case n.MatchNone():
                return F.lit(0.0)
            case n.MatchAll():
                return F.lit(1.0)
            case n.Boost(inner, factor):
                return self(inner) * F.lit(float(factor))
            case n.Term(f, v):
                if self.c.schema.fields.get(f) == "text" and isinstance(v, str):
                    return self.token(f, v)
                return self.exact(node, (f, repr(v)))
            case n.Match(f, text, every):
                if self.c.analyzer_of(f) == "raw":
                    return self.exact(node, (f, repr(text)))
                words = list(dict.fromkeys(analysis.analyze(text, self.c.analyzer)))
                if not words:
                    return F.lit(0.0)
                total = reduce(Column.__add__, (self.token(f, w) for w in words))
                return F.when(self.p(node, True), total).otherwise(0.0) if every else total
            case n.Phrase(f, text, slop):
                if self.c.analyzer_of(f) == "raw":
                    return self.exact(node, (f, repr(text)))
                words = analysis.analyze(text, self.c.analyzer)
                if len(words) < 2:
                    return self.token(f, words[0]) if words else F.lit(0.0)
                tf = F.when(self.p(node, True), 1).otherwise(0) if slop else self.p.phrase_count(f, words)
                return self.text(f, words, tf)
            case n.Bool():
                parts = [self(x) for x in (*node.must, *node.should)]
                if not parts:
                    return F.lit(0.0)
                total = reduce(Column.__add__, parts)
                # a part below a bool counts only where that bool matches
                return F.when(self.p(node, True), total).otherwise(0.0)
        return F.when(self.p(node, True), F.lit(1.0)).otherwise(0.0)

    def column(self, node: n.Node) -> Column:
        """The score of a tree; runs one aggregation if the tree needs statistics."""
        self(node)
        self.stats = {("n",): 1.0} | self.c.known
        keys = [k for k in self.wanted if k not in self.c.known]
        if keys != [("n",)] and keys:
            docs = self.c.df if self.c.whole is None else self.c.whole
            row = docs.agg(*[self.wanted[k].alias(f"s{i}") for i, k in enumerate(keys)]).first()
            self.stats |= {k: float(row[i] or 0) for i, k in enumerate(keys)}
        return self(node)
