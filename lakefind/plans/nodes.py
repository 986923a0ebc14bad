"""The query tree that both query languages compile to."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    """A query: which documents match, and how well."""


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class MatchNone(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    """A value as it is stored: on a text field, a token."""

    field: str
    value: object


@dataclass(frozen=True)
class Terms(Node):
    field: str
    values: tuple


@dataclass(frozen=True)
class Match(Node):
    """A text that is analyzed as the field is; any or all of its tokens."""

    field: str
    text: str
    every: bool = False


@dataclass(frozen=True)
class Phrase(Node):
    field: str
    text: str
    slop: int = 0


@dataclass(frozen=True)
class PhrasePrefix(Node):
    """A phrase whose last token may go on."""

    field: str
    text: str


@dataclass(frozen=True)
class Range(Node):
    field: str
    lower: object = None
    upper: object = None
    with_lower: bool = True
    with_upper: bool = True


@dataclass(frozen=True)
class Exists(Node):
    field: str


@dataclass(frozen=True)
class Prefix(Node):
    field: str
    value: str


@dataclass(frozen=True)
class Wildcard(Node):
    field: str
    pattern: str


@dataclass(frozen=True)
class Boost(Node):
    node: Node
    factor: float


@dataclass(frozen=True)
class Bool(Node):
    """All of must and filter, none of must_not, and one of should if there is nothing that must match."""

    must: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()
    filter: tuple[Node, ...] = ()


def any_of(nodes) -> Node:
    nodes = tuple(n for n in nodes if n != MatchNone())
    return MatchNone() if not nodes else nodes[0] if len(nodes) == 1 else Bool(should=nodes)


def all_of(nodes) -> Node:
    nodes = tuple(nodes)
    return nodes[0] if len(nodes) == 1 else Bool(must=nodes)


def simplify(node: Node) -> Node:
    """The same query with fewer nodes: empty and single-clause bools, clauses that match all or nothing."""
    match node:
        case Terms(values=()):
            return MatchNone()
        case Boost():
            inner = simplify(node.node)
            return inner if node.factor == 1 or inner == MatchNone() else Boost(inner, node.factor)
        case Bool():
            must, should, must_not, kept = ([simplify(x) for x in part] for part in (node.must, node.should, node.must_not, node.filter))
            if any(x == MatchNone() for x in must + kept) or any(x == MatchAll() for x in must_not):
                return MatchNone()
            must_not = [x for x in must_not if x != MatchNone()]
            needs_should = bool(should) and not must and not kept
            should = [x for x in should if x != MatchNone()]
            if needs_should and not should:
                return MatchNone()
            if not (must or should or kept):
                if not must_not:
                    return MatchAll()
                must = [MatchAll()]
            kept = [x for x in kept if x != MatchAll()] or (kept[:1] if not must else [])
            if not (must_not or kept) and len(must) + len(should) == 1:
                return (must + should)[0]
            return Bool(tuple(must), tuple(should), tuple(must_not), tuple(kept))
    return node
