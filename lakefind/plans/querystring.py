"""The query string language.

``word`` on any default field, ``field:word``, ``field:"a phrase"~2``, ``+must
-not``, ``AND OR NOT`` and parentheses, ``field:[a TO b}`` with ``*`` for an open
end, ``field:>=3``, ``field:IN [a b]``, ``field:*`` and ``*``, ``clause^2``.
Clauses without an operator are joined by OR; AND binds more closely.
"""

from __future__ import annotations

import re

from ..errors import LakefindError, QueryParseError
from ..schema import Schema
from . import nodes as n

_SPACE = re.compile(r"\s*")
_RANGE = re.compile(r'([\[{])\s*("(?:\\.|[^"\\])*"|\S+)\s+TO\s+("(?:\\.|[^"\\])*"|[^\s\]}]+)\s*([\]}])')
_COMPARE = re.compile(r'(>=|<=|>|<)\s*("(?:\\.|[^"\\])*"|[^\s()]+)')
_SET = re.compile(r"IN\s*\[((?:\\.|[^\]\\])*)\]")
_PHRASE = re.compile(r'"((?:\\.|[^"\\])*)"(?:~(\d+)|(\*))?')
_WORD = re.compile(r'(?:\\.|[^\s()"\\^])+')
_BOOST = re.compile(r"\^(\d+(?:\.\d+)?)")
_OPERATOR = re.compile(r"(AND|OR|NOT)(?=[\s(]|$)")


def _plain(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _bare(s: str) -> str:
    return _plain(s[1:-1] if len(s) > 1 and s[0] == s[-1] == '"' else s)


class _Parser:
    def __init__(self, text: str, schema: Schema):
        self.text, self.schema, self.at = text, schema, 0

    def fail(self, why: str):
        raise QueryParseError(f"query parse failed: {why} at {self.at} in {self.text!r}")

    def space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def take(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def peek(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def query(self, closing: bool = False) -> n.Node:
        """Clauses up to the end or the closing parenthesis."""
        chains: list[list[tuple[str, n.Node]]] = []
        joined = False
        while True:
            self.space()
            if self.at >= len(self.text):
                if closing:
                    self.fail("')' is missing")
                break
            if self.peek(")"):
                if not closing:
                    self.fail("unexpected ')'")
                break
            if (m := _OPERATOR.match(self.text, self.at)) and m[1] != "NOT":
                if not chains or joined:
                    self.fail(f"unexpected {m[1]}")
                self.at = m.end()
                joined = m[1]
                continue
            clause = self.clause()
            if joined == "AND":
                chains[-1].append(clause)
            else:
                chains.append([clause])
            joined = False
        if joined:
            self.fail(f"nothing after {joined}")
        if not chains:
            return n.MatchAll() if not closing else self.fail("empty parentheses")
        parts: dict[str, list[n.Node]] = {"+": [], "-": [], "": []}
        for chain in chains:
            if len(chain) == 1:
                parts[chain[0][0]].append(chain[0][1])
            else:
                group = n.Bool(must=tuple(x for o, x in chain if o != "-"), must_not=tuple(x for o, x in chain if o == "-"))
                parts[""].append(group)
        if not parts["+"] and not parts["-"] and len(parts[""]) == 1:
            return parts[""][0]
        return n.Bool(must=tuple(parts["+"]), should=tuple(parts[""]), must_not=tuple(parts["-"]))

    def clause(self) -> tuple[str, n.Node]:
        occur = ""
        if self.text[self.at] in "+-":
            occur = self.text[self.at]
            self.at += 1
            self.space()
        while (m := _OPERATOR.match(self.text, self.at)) and m[1] == "NOT":
            self.at = m.end()
            self.space()
            occur = "" if occur == "-" else "-"
        if self.at >= len(self.text):
            self.fail("a clause is missing")
        node = self.group(self.field())
        if m := self.take(_BOOST):
            node = n.Boost(node, float(m[1]))
        return occur, node

    def field(self) -> str | None:
        """The longest known field that stands before a colon here."""
        known = [f for f in (*self.schema.fields, "_id", "__present__") if self.peek(f + ":")]
        if known:
            f = max(known, key=len)
            self.at += len(f) + 1
            return f
        if m := re.compile(r"([A-Za-z_][\w.\-]*):").match(self.text, self.at):
            self.fail(f"field '{m[1]}' does not exist")
        return None

    def group(self, field: str | None) -> n.Node:
        if self.peek("("):
            if field is not None:
                self.fail("a field cannot be given to a group")
            self.at += 1
            node = self.query(closing=True)
            self.at += 1
            return node
        if field == "__present__":
            m = self.take(_PHRASE)
            w = m or self.take(_WORD)
            if not w:
                self.fail("a value is missing")
            name = _plain(m[1]) if m else _plain(w[0])
            return n.MatchAll() if name == "__all__" else n.Exists(name) if name in self.schema.fields else n.MatchNone()
        if field is not None:
            if m := self.take(_RANGE):
                lo, hi = (None if x == "*" else _bare(x) for x in (m[2], m[3]))
                return n.Range(field, self.bound(field, lo), self.bound(field, hi), m[1] == "[", m[4] == "]")
            if m := self.take(_COMPARE):
                v = self.bound(field, _bare(m[2]))
                return n.Range(field, v, None, m[1] == ">=") if m[1][0] == ">" else n.Range(field, None, v, True, m[1] == "<=")
            if m := self.take(_SET):
                return n.any_of(self.word(field, _bare(x)) for x in re.findall(r'"(?:\\.|[^"\\])*"|\S+', m[1]))
        if m := self.take(_PHRASE):
            text, slop, prefix = _plain(m[1]), int(m[2] or 0), bool(m[3])
            if field is not None:
                return self.phrase(field, text, slop, prefix)
            return self.default(lambda f: self.phrase(f, text, slop, prefix))
        if m := self.take(_WORD):
            w = m[0]
            if w == "*":
                return n.MatchAll() if field is None else n.Exists(field) if field != "_id" else n.MatchAll()
            w = _plain(w)
            return self.word(field, w) if field is not None else self.default(lambda f: self.word(f, w))
        self.fail("a value is missing")

    def bound(self, field: str, text: str | None):
        """A range's bound in the field's type."""
        kind = self.schema.fields.get(field)
        if text is None:
            return None
        if kind not in ("numeric", "date"):
            self.fail(f"field '{field}' has no ranges")
        return self.value(field, text)

    def value(self, field: str, text: str):
        from ..functions.values import parse_date, parse_ip

        match self.schema.fields.get(field, "keyword"):
            case "numeric":
                try:
                    return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
                except ValueError:
                    self.fail(f"'{text}' is no number for field '{field}'")
            case "boolean":
                if text not in ("true", "false"):
                    self.fail(f"'{text}' is no boolean for field '{field}'")
                return text == "true"
            case "date":
                parse_date(text)
            case "ip":
                parse_ip(text)
        return text

    def word(self, field: str, text: str) -> n.Node:
        if self.schema.fields.get(field, "keyword") in ("keyword", "text"):
            return n.Match(field, text)
        return n.Term(field, self.value(field, text))

    def phrase(self, field: str, text: str, slop: int, prefix: bool) -> n.Node:
        match self.schema.fields.get(field, "keyword"):
            case "text":
                return n.PhrasePrefix(field, text) if prefix else n.Phrase(field, text, slop)
            case "keyword":
                return n.Prefix(field, text) if prefix else n.Match(field, text)
        return n.Term(field, self.value(field, text))

    def default(self, make) -> n.Node:
        """A clause on every default field that can read the literal."""
        out = []
        for f in (*self.schema.fields, "_id"):
            try:
                out.append(make(f))
            except LakefindError:
                continue
        return n.any_of(out)


def parse(text: str, schema: Schema) -> n.Node:
    """The query tree of a query string; an empty one matches all."""
    p = _Parser(text, schema)
    node = p.query()
    return node
