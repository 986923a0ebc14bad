"""The JSON query language: one key names the query, its value holds the options."""

from __future__ import annotations

import json

from ..errors import QueryParseError
from . import nodes as n


def _one_field(kind: str, body) -> tuple[str, object]:
    if not isinstance(body, dict) or len(body) != 1:
        raise QueryParseError(f"{kind}: expected an object with exactly one field")
    return next(iter(body.items()))


def _option(kind: str, body: dict, name: str, types, default=None):
    value = body.get(name, default)
    if value is None and default is None and name not in body:
        raise QueryParseError(f"{kind}: '{name}' is missing")
    if not isinstance(value, types) or isinstance(value, bool) and bool not in (types if isinstance(types, tuple) else (types,)):
        raise QueryParseError(f"{kind}: '{name}' has the wrong type")
    return value


def _term(body) -> n.Node:
    f, v = _one_field("term", body)
    if isinstance(v, dict):
        if "value" not in v:
            raise QueryParseError("term: 'value' is missing")
        v = v["value"]
    if v is None or isinstance(v, list | dict):
        raise QueryParseError("term: the value must be a scalar")
    return n.Term(f, v)


def _terms(body) -> n.Node:
    f, v = _one_field("terms", body)
    if not isinstance(v, list) or any(x is None or isinstance(x, list | dict) for x in v):
        raise QueryParseError("terms: expected an array of scalars")
    return n.Terms(f, tuple(v))


def _match(body) -> n.Node:
    f, v = _one_field("match", body)
    if isinstance(v, str):
        return n.Match(f, v)
    if not isinstance(v, dict):
        raise QueryParseError("match: expected a text or an object")
    operator = _option("match", v, "operator", str, "or").lower()
    if operator not in ("or", "and"):
        raise QueryParseError(f"match: unknown operator '{operator}'")
    return n.Match(f, _option("match", v, "query", str), operator == "and")


def _match_phrase(body) -> n.Node:
    f, v = _one_field("match_phrase", body)
    if isinstance(v, str):
        return n.Phrase(f, v)
    if not isinstance(v, dict):
        raise QueryParseError("match_phrase: expected a text or an object")
    slop = _option("match_phrase", v, "slop", int, 0)
    if slop < 0:
        raise QueryParseError("match_phrase: slop must not be negative")
    return n.Phrase(f, _option("match_phrase", v, "query", str), slop)


def _multi_match(body) -> n.Node:
    if not isinstance(body, dict):
        raise QueryParseError("multi_match: expected an object")
    text = _option("multi_match", body, "query", str)
    fields = _option("multi_match", body, "fields", list)
    if not fields or not all(isinstance(f, str) for f in fields):
        raise QueryParseError("multi_match: 'fields' must name at least one field")
    # kept as a bool of its own even for one field, so that every field is checked
    return n.Bool(should=tuple(n.Match(f, text) for f in fields))


def _range(body) -> n.Node:
    f, v = _one_field("range", body)
    if not isinstance(v, dict):
        raise QueryParseError("range: expected an object with bounds")
    lower, with_lower = (v["gte"], True) if v.get("gte") is not None else (v.get("gt"), False)
    upper, with_upper = (v["lte"], True) if v.get("lte") is not None else (v.get("lt"), False)
    return n.Range(f, lower, upper, with_lower, with_upper)


def _exists(body) -> n.Node:
    if not isinstance(body, dict):
        raise QueryParseError("exists: expected an object")
    return n.Exists(_option("exists", body, "field", str))


def _pattern(kind: str, make):
    def parse(body) -> n.Node:
        f, v = _one_field(kind, body)
        if isinstance(v, dict):
            v = v.get("value")
        if not isinstance(v, str):
            raise QueryParseError(f"{kind}: expected a text")
        return make(f, v)

    return parse


def _clauses(body: dict, name: str) -> tuple[n.Node, ...]:
    x = body.get(name, [])
    return tuple(parse(q) for q in (x if isinstance(x, list) else [x]))


def _bool(body) -> n.Node:
    if not isinstance(body, dict):
        raise QueryParseError("bool: expected an object")
    return n.Bool(*(_clauses(body, c) for c in ("must", "should", "must_not", "filter")))


_KINDS = {
    "match_all": lambda _: n.MatchAll(), "match_none": lambda _: n.MatchNone(), "term": _term, "terms": _terms, "match": _match, "match_phrase": _match_phrase,
    "multi_match": _multi_match, "range": _range, "exists": _exists, "prefix": _pattern("prefix", n.Prefix), "wildcard": _pattern("wildcard", n.Wildcard), "bool": _bool,
}


def parse(query: str | dict) -> n.Node:
    """The query tree of a JSON query."""
    if isinstance(query, str):
        try:
            query = json.loads(query)
        except ValueError as e:
            raise QueryParseError(f"query is not JSON: {e}") from e
    if not isinstance(query, dict) or len(query) != 1:
        raise QueryParseError("a query is an object with exactly one key")
    kind, body = next(iter(query.items()))
    if kind not in _KINDS:
        raise QueryParseError(f"unknown variant '{kind}', expected one of {', '.join(_KINDS)}")
    return _KINDS[kind](body)
