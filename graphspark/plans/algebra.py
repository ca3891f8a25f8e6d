"""The algebra between query text and DataFrames.

Expressions are nested tuples: ("var", name), ("iri", text), ("lit", lex, datatype, lang),
("num", text), ("bool", value), (operator, operand ...), ("call", name, arguments ...),
("agg", name, distinct, expression, separator).
"""

from __future__ import annotations

from dataclasses import dataclass, field

Term = tuple
Expr = tuple


class QueryError(ValueError):
    """A query that isn't supported, or not allowed: it fails, it never returns nothing."""


@dataclass
class Path:
    """A property path: kind is link, inverse, seq, alt, plus, star or opt."""

    kind: str
    parts: tuple = ()
    name: str = ""


@dataclass
class Pattern:
    s: Term
    p: Term | Path
    o: Term
    graph: Term | None = None


@dataclass
class BGP:
    patterns: list[Pattern]


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: Expr | None = None


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Exists:
    left: object
    right: object
    negated: bool


@dataclass
class Filter:
    child: object
    condition: Expr


@dataclass
class Extend:
    child: object
    name: str
    value: Expr


@dataclass
class Values:
    names: list[str]
    rows: list[list[Term | None]]


@dataclass
class Group:
    child: object
    by: list[tuple[str, Expr]]
    values: list[tuple[str, Expr]]


@dataclass
class Query:
    form: str
    body: object
    select: list[tuple[str, Expr]] | None = None
    distinct: bool = False
    group: list[tuple[str, Expr]] | None = None
    having: list[Expr] = field(default_factory=list)
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    template: list[Pattern] = field(default_factory=list)
    target: Term | None = None


def variables_of(node: object) -> set[str]:
    """The variables that a pattern can bind."""
    if isinstance(node, BGP):
        return {t[1] for p in node.patterns for t in (p.s, p.p, p.o, p.graph) if isinstance(t, tuple) and t[0] == "var"}
    if isinstance(node, (Join, LeftJoin, Union)):
        return variables_of(node.left) | variables_of(node.right)
    if isinstance(node, (Minus, Exists)):
        return variables_of(node.left)
    if isinstance(node, Extend):
        return variables_of(node.child) | {node.name}
    if isinstance(node, Filter):
        return variables_of(node.child)
    if isinstance(node, Values):
        return set(node.names)
    if isinstance(node, Query):
        return {n for n, _ in node.select} if node.select else variables_of(node.body)
    return set()
