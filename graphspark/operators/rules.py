"""Bounded forward chaining: Horn rules over facts (s, p, o) to a fixpoint.

A rule's body is a chain of atoms that share variables; each atom is a filter of the facts
and the body a join.  The loop is semi-naive: in every round one atom ranges over the newest
facts only.  Derived facts carry the rule that first gave them, and go to a graph of their
own; dropping and deriving them again gives the same facts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .paths import COMPACT


@dataclass
class Rule:
    """body and head: (s, p, o) with ?variables; where: an SQL condition over the variables
    (without ?), with numbers as strings to be cast; never: atoms that must not be found in
    the given facts (stratified negation)."""

    name: str
    body: list[tuple[str, str, str]]
    head: list[tuple[str, str, str]]
    where: str = ""
    never: list[tuple[str, str, str]] = field(default_factory=list)


def atom(facts: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    chosen: dict[str, Column] = {}
    for term, column in zip(pattern, ("s", "p", "o"), strict=True):
        c = F.col(column)
        if not term.startswith("?"):
            facts = facts.where(c == term)
        elif term[1:] in chosen:
            facts = facts.where(chosen[term[1:]] == c)
        else:
            chosen[term[1:]] = c
    return facts.select(*[c.alias(n) for n, c in chosen.items()])


def fire(rule: Rule, facts: DataFrame, delta: DataFrame, given: DataFrame) -> DataFrame:
    """What a rule gives if at least one atom of its body is among the newest facts."""
    out = None
    for k in range(len(rule.body)):
        rows = atom(delta, rule.body[k])
        rest = [atom(facts, pattern) for j, pattern in enumerate(rule.body) if j != k]
        while rest:
            other = next((x for x in rest if set(x.columns) & set(rows.columns)), None)
            if other is None:
                raise ValueError(f"rule {rule.name}: its atoms aren't connected")
            rest = [x for x in rest if x is not other]
            rows = rows.join(other, [c for c in other.columns if c in rows.columns])
        if rule.where:
            rows = rows.where(rule.where)
        for pattern in rule.never:
            other = atom(given, pattern)
            rows = rows.join(other.distinct(), [c for c in other.columns if c in rows.columns], "left_anti")
        for head in rule.head:
            made = rows.select(*[(F.col(t[1:]) if t.startswith("?") else F.lit(t)).alias(c) for t, c in zip(head, ("s", "p", "o"), strict=True)], F.lit(rule.name).alias("rule"))
            out = made if out is None else out.unionByName(made)
    return out


def forward_chain(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Derived facts (s, p, o, rule, round) that aren't among ``facts``.  Heads hold only
    terms of the rules and of the facts, so there are finitely many and the rounds end."""
    given = stored(facts.select("s", "p", "o").distinct(), "facts")
    known, delta, derived = given, given, None
    n = 0
    while True:
        n, made = n + 1, None
        for rule in rules:
            rows = fire(rule, known, delta, given)
            made = rows if made is None else made.unionByName(rows)
        new = made.groupBy("s", "p", "o").agg(F.min("rule").alias("rule")).join(known, ["s", "p", "o"], "left_anti").withColumn("round", F.lit(n))
        new = stored(new, "derived")
        if new.isEmpty():
            return derived if derived is not None else new
        derived = new if derived is None else derived.unionByName(new)
        delta = new.select("s", "p", "o")
        known = known.unionByName(delta)
        if n % COMPACT == 0:
            known, derived = stored(known, "facts"), stored(derived, "derived")


#: Entailment of the schema vocabulary, as rules.
SCHEMA_RULES = [
    Rule("subclass-transitive", [("?a", "subClassOf", "?b"), ("?b", "subClassOf", "?c")], [("?a", "subClassOf", "?c")]),
    Rule("subclass-instance", [("?x", "type", "?a"), ("?a", "subClassOf", "?b")], [("?x", "type", "?b")]),
    Rule("subproperty-transitive", [("?a", "subPropertyOf", "?b"), ("?b", "subPropertyOf", "?c")], [("?a", "subPropertyOf", "?c")]),
    Rule("subproperty", [("?p", "subPropertyOf", "?q"), ("?x", "?p", "?y")], [("?x", "?q", "?y")]),
    Rule("domain", [("?p", "domain", "?c"), ("?x", "?p", "?y")], [("?x", "type", "?c")]),
    Rule("range", [("?p", "range", "?c"), ("?x", "?p", "?y")], [("?y", "type", "?c")]),
    Rule("inverse", [("?p", "inverseOf", "?q"), ("?x", "?p", "?y")], [("?y", "?q", "?x")]),
    Rule("symmetric", [("?p", "type", "SymmetricProperty"), ("?x", "?p", "?y")], [("?y", "?p", "?x")]),
    Rule("transitive", [("?p", "type", "TransitiveProperty"), ("?x", "?p", "?y"), ("?y", "?p", "?z")], [("?x", "?p", "?z")]),
]
