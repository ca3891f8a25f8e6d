"""From the algebra to DataFrames.

A variable bound by a pattern has its key in the column of its name and its parts beside it
(``name__num`` and so on), which Catalyst prunes where nothing reads them.  A computed
variable is one typed column.  Variables that may be unbound are tracked, as they join with
anything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths
from ..sources.mapping import IRI, NUMBER
from .algebra import BGP, Exists, Extend, Expr, Filter, Join, LeftJoin, Minus, Path, Pattern, Query, QueryError, Term, Union, Values, variables_of
from .text import parse

PARTS = ["lex", "kind", "num", "ts", "lang", "dt"]


@dataclass
class Rel:
    df: DataFrame
    types: dict[str, str] = field(default_factory=dict)  # term, num, str or bool
    maybe: set[str] = field(default_factory=set)

    def columns(self, name: str) -> list[str]:
        return [name, *(f"{name}__{p}" for p in PARTS)] if self.types[name] == "term" else [name]


@dataclass
class Value:
    kind: str
    c: Column
    parts: dict[str, Column] = field(default_factory=dict)

    def num(self) -> Column:
        if self.kind == "term":
            return self.parts["num"]
        return self.c if self.kind == "num" else F.lit(None).cast(NUMBER)

    def lex(self) -> Column:
        return self.parts["lex"] if self.kind == "term" else self.c.cast("string")


def constant(term: Term) -> Value:
    if term[0] == "iri":
        none = F.lit(None)
        return Value("term", F.lit(term[1]), {"lex": F.lit(term[1]), "kind": F.lit(IRI), "num": none.cast(NUMBER), "ts": none.cast("timestamp_ntz"), "lang": none.cast("string"), "dt": none.cast("string")})
    if term[0] == "num":
        return Value("num", F.lit(term[1]).cast(NUMBER))
    if term[0] == "bool":
        return Value("bool", F.lit(term[1]))
    _, text, dt, lang = term
    if dt in ("xsd:integer", "xsd:decimal", "xsd:double", "xsd:float"):
        return Value("num", F.lit(text).cast(NUMBER))
    if dt in ("xsd:date", "xsd:dateTime"):
        return Value("ts", F.lit(text).cast("timestamp_ntz"))
    key = f'"{text}"@{lang}' if lang else f'"{text}"^^{dt}'
    return Value("str", F.lit(text), {"key": F.lit(key)})


def key_of(term: Term) -> str:
    if term[0] == "iri":
        return term[1]
    if term[0] == "num":
        return f'"{term[1]}"^^{"xsd:decimal" if "." in term[1] else "xsd:integer"}'
    if term[0] == "lit":
        return f'"{term[1]}"@{term[3]}' if term[3] else f'"{term[1]}"^^{term[2]}'
    raise QueryError(f"{term[0]} can't stand in a pattern")


_NUMERIC, _TIMES = ("xsd:integer", "xsd:decimal", "xsd:double", "xsd:float"), ("xsd:date", "xsd:dateTime")


def key_parts(key: Column) -> dict[str, Column]:
    """The parts of a term by its key, which holds text, datatype and language of a literal."""
    literal = key.startswith('"')
    lex = F.when(literal, F.regexp_replace(key, r'(?s)^"(.*)"(\^\^.*|@.*)$', "$1")).otherwise(key)
    dt = F.when(literal, F.nullif(F.regexp_extract(key, r'(?s)^".*"\^\^(.*)$', 1), F.lit("")))
    return {
        "lex": lex, "kind": literal.cast("tinyint"), "num": F.when(dt.isin(*_NUMERIC), lex.try_cast(NUMBER)), "ts": F.when(dt.isin(*_TIMES), lex.try_cast("timestamp_ntz")),
        "lang": F.when(literal, F.nullif(F.regexp_extract(key, r'(?s)^".*"@([^"]*)$', 1), F.lit(""))), "dt": dt,
    }


class Compiler:
    """Compiles queries over one quads DataFrame."""

    def __init__(self, quads: DataFrame, sizes: dict[str, int] | None = None):
        self.quads, self.sizes, self.spark = quads, sizes or {}, quads.sparkSession

    # patterns
    def graph(self, term: Term | None) -> DataFrame:
        return self.quads if term is None or term[0] == "var" else self.quads.where(F.col("g") == key_of(term))

    def edges(self, path: Path, graph: Term | None, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
        """(src, dst) of a path.  ``sources`` and ``targets`` (one column, src or dst) are all
        ends that are asked for: closures start there, and only those ends have a path of no
        edge.  Without them every node of the graph has one."""
        kind, parts = path.kind, path.parts
        if kind == "link":
            out = self.graph(graph).where(F.col("p") == path.name).select(F.col("s").alias("src"), F.col("o_key").alias("dst"))
        elif kind == "inverse":
            flip = lambda df, to: None if df is None else df.toDF(to)
            return paths.inverse(self.edges(parts[0], graph, flip(targets, "src"), flip(sources, "dst")))
        elif kind == "alt":
            return paths.alternative(*(self.edges(p, graph, sources, targets) for p in parts))
        elif kind == "seq":
            # a closure in the middle starts from what its neighbour reaches
            if sources is None and targets is not None:
                second = self.edges(parts[1], graph, None, targets)
                first = self.edges(parts[0], graph, None, second.select(F.col("src").alias("dst")).distinct())
            else:
                first = self.edges(parts[0], graph, sources)
                middle = first.select(F.col("dst").alias("src")).distinct() if sources is not None or not _closed(parts[0]) else None
                second = self.edges(parts[1], graph, middle, targets)
            return paths.sequence(first, second)
        else:
            backwards = sources is None and targets is not None
            seeds = targets.toDF("src").distinct() if backwards else None if sources is None else sources.distinct()
            inner = self.edges(parts[0], graph)
            if backwards:
                inner = paths.inverse(inner)
            if seeds is None and kind != "plus":
                seeds = self.graph(graph).select(F.col("s").alias("src")).unionByName(self.graph(graph).select(F.col("o_key").alias("src"))).distinct()
            out = {"plus": paths.one_or_more, "star": paths.zero_or_more, "opt": paths.zero_or_one}[kind](inner, seeds)
            out = paths.inverse(out) if backwards else out
            return out if targets is None or backwards else out.join(targets.distinct(), "dst", "left_semi")
        if sources is not None and kind != "link":
            out = out.join(sources.distinct(), "src", "left_semi")
        return out

    def fixed(self, df: DataFrame, side: str, term: Term) -> DataFrame:
        """Rows with a constant subject (s) or object (o).  The key of a mapped row is compared
        as a number too, so that the scan can skip row groups and other tables' branches go."""
        key = key_of(term)
        df = df.where(F.col("s" if side == "s" else "o_key") == key)
        if term[0] == "iri" and f"{side}_at" in df.columns:
            prefix, _, number = key.partition("/") if "/" in key else ("", "", key)
            df = df.where(F.col(f"{side}_at").isNull() | (F.col(f"{side}_at") == prefix))
            if re.fullmatch("0|[1-9][0-9]{0,17}", number):
                df = df.where(F.col(f"{side}_id").isNull() | (F.col(f"{side}_id") == int(number)))
        return df

    def pattern(self, p: Pattern, bound: Rel | None = None) -> Rel:
        """One pattern; a path starts from the values that ``bound`` has for its ends."""
        if isinstance(p.p, Path):
            if p.graph is not None and p.graph[0] == "var":
                raise QueryError("a path under a graph variable")

            def ends(term: Term, name: str) -> DataFrame | None:
                if term[0] != "var":
                    return self.spark.range(1).select(F.lit(key_of(term)).alias(name))
                if bound is not None and bound.types.get(term[1]) == "term" and term[1] not in bound.maybe:
                    return bound.df.select(F.col(term[1]).alias(name))
                return None

            sources, targets = ends(p.s, "src"), ends(p.o, "dst")
            if p.s[0] == "var" and p.o[0] != "var":
                sources = None  # the constant end is the smaller one
            if p.s == p.o and _closed(p.p):
                targets = None
            df = self.edges(p.p, p.graph, sources, targets).select(F.col("src").alias("s"), F.col("dst").alias("o_key"))
            df = df.withColumns({f"o_{k}": c for k, c in key_parts(F.col("o_key")).items()})
        else:
            df = self.graph(p.graph)
            if p.p[0] != "var":
                df = df.where(F.col("p") == p.p[1])
        if p.s[0] != "var":
            df = self.fixed(df, "s", p.s)
        if p.o[0] != "var":
            df = self.fixed(df, "o", p.o)
        chosen: dict[str, list[Column]] = {}
        same: list[Column] = []

        def bind(term: object, columns: list[Column], key: Column) -> None:
            if not isinstance(term, tuple) or term[0] != "var":
                return
            if term[1] in chosen:
                same.append(chosen_key[term[1]] == key)
            else:
                chosen[term[1]] = columns
                chosen_key[term[1]] = key

        chosen_key: dict[str, Column] = {}

        def plain(name: str, column: Column) -> list[Column]:
            empty = {"num": NUMBER, "ts": "timestamp_ntz", "lang": "string", "dt": "string"}
            return [column.alias(name), column.alias(f"{name}__lex"), F.lit(IRI).cast("tinyint").alias(f"{name}__kind"), *(F.lit(None).cast(t).alias(f"{name}__{k}") for k, t in empty.items())]

        if p.s[0] == "var":
            parts = {k: c.alias(f"{p.s[1]}__{k}") for k, c in key_parts(F.col("s")).items()} if isinstance(p.p, Path) and _closed(p.p) else {}
            bind(p.s, [F.col("s").alias(p.s[1]), *(parts[k] for k in PARTS)] if parts else plain(p.s[1], F.col("s")), F.col("s"))
        if isinstance(p.p, tuple) and p.p[0] == "var":
            bind(p.p, plain(p.p[1], F.col("p")), F.col("p"))
        if p.o[0] == "var":
            o = p.o[1]
            bind(p.o, [F.col("o_key").alias(o), *(F.col(f"o_{k}").cast("tinyint").alias(f"{o}__{k}") if k == "kind" else F.col(f"o_{k}").alias(f"{o}__{k}") for k in PARTS)], F.col("o_key"))
        if p.graph is not None and p.graph[0] == "var":
            bind(p.graph, plain(p.graph[1], F.col("g")), F.col("g"))
        for condition in same:
            df = df.where(condition)
        flat = [c for cs in chosen.values() for c in cs]
        return Rel(df.select(*flat) if flat else df.select(F.lit(1).alias("_one")), dict.fromkeys(chosen, "term"))

    def cost(self, p: Pattern) -> tuple:
        fixed = sum(t[0] != "var" for t in (p.s, p.o)) + (2 if isinstance(p.p, tuple) and p.p[0] != "var" else 0)
        size = self.sizes.get(p.p[1], 10**9) if isinstance(p.p, tuple) and p.p[0] == "iri" else 10**12
        return (p.s[0] == "var" and p.o[0] == "var", size, -fixed)

    def bgp(self, node: BGP) -> Rel:
        """The most selective pattern first, then connected ones; a product is refused."""
        if not node.patterns:
            return Rel(self.spark.range(1).select(F.lit(1).alias("_one")))
        rest = sorted(node.patterns, key=self.cost)
        out = self.pattern(rest.pop(0))
        while rest:
            nxt = next((p for p in rest if not out.types or variables_of(BGP([p])) & set(out.types) or not variables_of(BGP([p]))), None)
            if nxt is None:
                raise QueryError("the patterns are not connected: a product of all rows")
            rest.remove(nxt)
            out = self.join(out, self.pattern(nxt, out))
        return out

    # joins
    def as_term(self, rel: Rel, name: str) -> Rel:
        if rel.types[name] == "term":
            return rel
        c, kind = F.col(name), rel.types[name]
        dt = {"num": "xsd:decimal", "str": "xsd:string", "bool": "xsd:boolean"}[kind]
        lex = c.cast("string")
        df = rel.df.withColumns({f"{name}__lex": lex, f"{name}__kind": F.lit(1).cast("tinyint"), f"{name}__num": c.cast(NUMBER) if kind == "num" else F.lit(None).cast(NUMBER), f"{name}__ts": F.lit(None).cast("timestamp_ntz"), f"{name}__lang": F.lit(None).cast("string"), f"{name}__dt": F.lit(dt)}).withColumn(name, F.concat(F.lit('"'), lex, F.lit(f'"^^{dt}')))
        return Rel(df, {**rel.types, name: "term"}, rel.maybe)

    def aligned(self, left: Rel, right: Rel) -> tuple[Rel, Rel, list[str]]:
        shared = [n for n in left.types if n in right.types]
        for n in shared:
            left, right = self.as_term(left, n), self.as_term(right, n)
        return left, right, shared

    def join(self, left: Rel, right: Rel, how: str = "inner") -> Rel:
        left, right, shared = self.aligned(left, right)
        loose = [n for n in shared if n in left.maybe or n in right.maybe]
        types = {**left.types, **right.types}
        if not loose or how != "inner":
            rdf = right.df.select(*[F.col(n).alias(f"_r_{n}") for n in shared], *[c for n in right.types if n not in shared for c in right.columns(n)])
            on = None
            for n in shared:
                test = left.df[n] == rdf[f"_r_{n}"] if n not in loose else left.df[n].isNull() | (left.df[n] == rdf[f"_r_{n}"])
                on = test if on is None else on & test
            df = left.df.join(rdf, on if on is not None else F.lit(True), how) if shared else left.df.crossJoin(rdf)
            df = df.drop(*[f"_r_{n}" for n in shared])
            extra = {n for n in right.types if n not in shared} if how == "left" else set()
            return Rel(df, types, (left.maybe | right.maybe | extra) - ({n for n in shared if n not in loose}))
        # unbound values join with anything: rows are parted so that bound ones keep an equality
        n, parts = loose[0], []
        order = [c for m in types for c in Rel(left.df, types).columns(m)]
        for lb in (True, False):
            for rb in (True, False):
                a = Rel(left.df.where(F.col(n).isNotNull() if lb else F.col(n).isNull()), dict(left.types), left.maybe - {n})
                b = Rel(right.df.where(F.col(n).isNotNull() if rb else F.col(n).isNull()), dict(right.types), right.maybe - {n})
                if (lb and n not in right.maybe and not rb) or (n not in left.maybe and not lb) or (n not in right.maybe and not rb):
                    continue
                if not lb:
                    a = Rel(a.df.drop(*a.columns(n)), {k: v for k, v in a.types.items() if k != n}, a.maybe)
                elif not rb:
                    b = Rel(b.df.drop(*b.columns(n)), {k: v for k, v in b.types.items() if k != n}, b.maybe)
                parts.append(self.join(a, b))
        df = parts[0].df.select(*order)
        for p in parts[1:]:
            df = df.unionByName(p.df.select(*order))
        return Rel(df, types, set().union(*(p.maybe for p in parts)) | ({n} if n in left.maybe and n in right.maybe else set()))

    def left_join(self, left: Rel, right: Rel, condition: Expr | None) -> Rel:
        left, right, shared = self.aligned(left, right)
        if condition is None and not any(n in left.maybe or n in right.maybe for n in shared):
            return self.join(left, right, "left")
        loose = [n for n in shared if n in left.maybe and n not in right.maybe]
        if loose:  # rows that have the variable join on it, the others take any value of it
            n, types = loose[0], {**left.types, **right.types}
            has = Rel(left.df.where(F.col(n).isNotNull()), left.types, left.maybe - {n})
            free = Rel(left.df.where(F.col(n).isNull()).drop(*left.columns(n)), {k: v for k, v in left.types.items() if k != n}, left.maybe - {n})
            a, b = self.left_join(has, right, condition), self.left_join(free, right, condition)
            order = [c for m in types for c in Rel(left.df, types).columns(m)]
            return Rel(a.df.select(*order).unionByName(b.df.select(*order)), types, a.maybe | b.maybe | {n})
        rdf = right.df.select(*[F.col(c).alias(f"_r_{c}") for n in shared for c in right.columns(n)], *[c for n in right.types if n not in shared for c in right.columns(n)])
        on = F.lit(True)
        for n in shared:
            on = on & (F.col(n).isNull() | F.col(f"_r_{n}").isNull() | (F.col(n) == F.col(f"_r_{n}")) if n in left.maybe | right.maybe else F.col(n) == F.col(f"_r_{n}"))
        types = {**left.types, **right.types}
        if condition is not None:
            on = on & self.truth(condition, types)
        df = left.df.join(rdf, on, "left")
        for n in shared:
            if n in left.maybe:
                df = df.withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in left.columns(n)})
        df = df.drop(*[f"_r_{c}" for n in shared for c in right.columns(n)])
        return Rel(df, types, left.maybe | right.maybe | {n for n in right.types if n not in shared})

    def semi(self, left: Rel, right: Rel, how: str, correlated: bool, late: list[Expr] = ()) -> Rel:
        """EXISTS and NOT EXISTS are correlated, and ``late`` are filters of theirs over both
        sides; MINUS removes nothing without a shared variable.  Rows with an unbound shared
        variable are parted from the others, as it agrees with any value."""
        left, right, shared = self.aligned(left, right)
        if not shared and not correlated:
            return left
        n = next((n for n in shared if n in left.maybe or n in right.maybe), None)
        if n is not None:
            without = lambda rel: Rel(rel.df.drop(*rel.columns(n)), {k: v for k, v in rel.types.items() if k != n}, rel.maybe - {n})
            bound = lambda rel: Rel(rel.df.where(F.col(n).isNotNull()), rel.types, rel.maybe - {n})
            unbound = lambda rel: Rel(rel.df.where(F.col(n).isNull()), rel.types, rel.maybe)
            out = []
            if n in right.maybe:
                # against right rows with the variable first, then against those without it
                anti = self.semi(bound(left), bound(right), "left_anti", correlated, late)
                rest = self.semi(anti, without(unbound(right)), how, correlated, late)
                out.append(rest)
                if how == "left_semi":
                    out.append(self.semi(bound(left), bound(right), how, correlated, late))
            else:
                out.append(self.semi(bound(left), right, how, correlated, late))
            if n in left.maybe:  # the column stays on the left side, though it tells nothing
                free = unbound(left)
                hidden = Rel(free.df, {k: v for k, v in free.types.items() if k != n}, free.maybe - {n})
                out.append(self.semi(hidden, without(right), how, correlated, late))
            df = out[0].df.select(*left.df.columns)
            for rel in out[1:]:
                df = df.unionByName(rel.df.select(*left.df.columns))
            return Rel(df, left.types, left.maybe)
        if not shared and not late:
            one = right.df.limit(1).select(F.lit(1).alias("_x"))
            return Rel(left.df.join(one, F.lit(True), how), left.types, left.maybe)
        used = set().union(*map(_variables, late)) if late else set()
        extra = [n for n in right.types if n not in shared and n in used]
        keys = right.df.select(*[F.col(n).alias(f"_r_{n}") for n in shared], *[c for n in extra for c in right.columns(n)]).distinct()
        on = F.lit(True)
        for n in shared:
            on = on & (F.col(n) == F.col(f"_r_{n}"))
        for condition in late:
            on = on & self.truth(condition, {**{n: right.types[n] for n in extra}, **left.types})
        return Rel(left.df.join(keys, on, how), left.types, left.maybe)

    def exists(self, node: Exists) -> Rel:
        """Filters of the inner pattern that use outer variables become part of the join."""
        left, late = self.compile(node.left), []

        def peel(inner: object) -> object:
            if isinstance(inner, Filter):
                child = peel(inner.child)
                if (_variables(inner.condition) - variables_of(inner.child)) & set(left.types):
                    late.append(inner.condition)
                    return child
                return Filter(child, inner.condition)
            if isinstance(inner, (Exists, Minus)):
                if isinstance(inner, Exists) and (_mentioned(inner.right) - variables_of(inner.left)) & set(left.types):
                    raise QueryError("EXISTS within EXISTS uses an outer variable")
                child = peel(inner.left)
                return Exists(child, inner.right, inner.negated) if isinstance(inner, Exists) else Minus(child, inner.right)
            return inner

        right = self.compile(peel(node.right))
        return self.semi(left, right, "left_anti" if node.negated else "left_semi", True, late)

    # nodes
    def compile(self, node: object) -> Rel:
        if isinstance(node, BGP):
            return self.bgp(node)
        if isinstance(node, Query):
            return self.select(node)
        if isinstance(node, Join):
            left, right = self.compile(node.left), self.compile(node.right)
            if left.types and right.types and not set(left.types) & set(right.types) and not isinstance(node.left, Values) and not isinstance(node.right, Values):
                raise QueryError("the patterns are not connected: a product of all rows")
            return self.join(left, right)
        if isinstance(node, LeftJoin):
            return self.left_join(self.compile(node.left), self.compile(node.right), node.condition)
        if isinstance(node, Union):
            left, right, _ = self.aligned(self.compile(node.left), self.compile(node.right))
            both = {**left.types, **right.types}
            lone = (set(left.types) ^ set(right.types)) | left.maybe | right.maybe
            cols = [c for n in both for c in Rel(left.df, both).columns(n)]
            return Rel(left.df.select(*[c for c in cols if c in left.df.columns]).unionByName(right.df.select(*[c for c in cols if c in right.df.columns]), allowMissingColumns=True), both, lone)
        if isinstance(node, Minus):
            return self.semi(self.compile(node.left), self.compile(node.right), "left_anti", False)
        if isinstance(node, Exists):
            return self.exists(node)
        if isinstance(node, Filter):
            rel = self.compile(node.child)
            return Rel(rel.df.where(self.truth(node.condition, rel.types)), rel.types, rel.maybe)
        if isinstance(node, Extend):
            rel = self.compile(node.child)
            return self.extend(rel, node.name, node.value)
        if isinstance(node, Values):
            return self.values(node)
        raise QueryError(f"{type(node).__name__} is not supported")

    def extend(self, rel: Rel, name: str, value: Expr) -> Rel:
        v = self.value(value, rel.types)
        if v.kind == "term":
            return Rel(rel.df.withColumns({name: v.c, **{f"{name}__{k}": v.parts[k] for k in PARTS}}), {**rel.types, name: "term"}, rel.maybe | {name})
        return Rel(rel.df.withColumn(name, v.c), {**rel.types, name: v.kind}, rel.maybe | {name})

    def values(self, node: Values) -> Rel:
        rows = [[None if t is None else key_of(t) for t in row] for row in node.rows]
        df = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in node.names))
        for n in node.names:
            df = df.withColumns({f"{n}__{k}": c for k, c in key_parts(F.col(n)).items()})
        return Rel(df, dict.fromkeys(node.names, "term"), {n for k, n in enumerate(node.names) if any(r[k] is None for r in rows)})

    # expressions
    def value(self, e: Expr, types: dict[str, str]) -> Value:
        kind = e[0]
        if kind == "var":
            if e[1] not in types:
                raise QueryError(f"?{e[1]} is not bound by the pattern that it is used in")
            if types[e[1]] != "term":
                return Value(types[e[1]], F.col(e[1]))
            return Value("term", F.col(e[1]), {k: F.col(f"{e[1]}__{k}") for k in PARTS})
        if kind in ("iri", "lit", "num", "bool"):
            return constant(e)
        if kind in ("||", "&&"):
            a, b = self.truth(e[1], types), self.truth(e[2], types)
            return Value("bool", a | b if kind == "||" else a & b)
        if kind == "!":
            return Value("bool", ~self.truth(e[1], types))
        if kind in ("=", "!=", "<", ">", "<=", ">="):
            return Value("bool", self.compare(kind, self.value(e[1], types), self.value(e[2], types)))
        if kind == "in":
            a, out = self.value(e[1], types), F.lit(False)
            for x in e[2:]:
                out = out | self.compare("=", a, self.value(x, types))
            return Value("bool", out)
        if kind in "+-*/":
            a, b = self.value(e[1], types).num(), self.value(e[2], types).num()
            out = {"+": lambda: F.try_add(a, b), "-": lambda: F.try_subtract(a, b), "*": lambda: F.try_multiply(a, b), "/": lambda: F.try_divide(a, b)}[kind]()
            return Value("num", out)
        if kind == "call":
            return self.call(e[1], [self.value(x, types) if e[1] != "bound" else x for x in e[2:]], types)
        raise QueryError(f"{kind} is not allowed here")

    def compare(self, op: str, a: Value, b: Value) -> Column:
        """Equality of terms is by value where both are numbers, else by key."""
        test = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if "num" in (a.kind, b.kind):
            return test(a.num(), b.num())
        if "ts" in (a.kind, b.kind):
            return test(*(v.parts["ts"] if v.kind == "term" else v.c for v in (a, b)))
        if a.kind == b.kind == "bool":
            return test(a.c, b.c)
        if a.kind == b.kind == "term":
            rest = test(a.c, b.c) if op in ("=", "!=") else test(a.lex(), b.lex())
            by_time = F.when(a.parts["ts"].isNotNull() & b.parts["ts"].isNotNull(), test(a.parts["ts"], b.parts["ts"])).otherwise(rest)
            return F.when(a.num().isNotNull() & b.num().isNotNull(), test(a.num(), b.num())).otherwise(by_time)
        return test(a.lex(), b.lex())

    def call(self, name: str, a: list, types: dict[str, str]) -> Value:
        if name == "bound":
            return Value("bool", F.col(a[0][1]).isNotNull() if a[0][1] in types else F.lit(False))
        text = lambda k: a[k].lex()
        term = lambda k, part: a[k].parts.get(part, F.lit(None).cast("string"))
        simple = {
            "str": lambda: text(0), "lang": lambda: F.coalesce(term(0, "lang"), F.lit("")), "datatype": lambda: term(0, "dt"), "lcase": lambda: F.lower(text(0)), "ucase": lambda: F.upper(text(0)),
            "concat": lambda: F.concat(*(x.lex() for x in a)), "substr": lambda: text(0).substr(a[1].num().cast("int"), a[2].num().cast("int") if len(a) > 2 else F.length(text(0))),
            "replace": lambda: F.regexp_replace(text(0), text(1), text(2)),
        }
        truths = {
            "regex": lambda: F.rlike(text(0), text(1)), "contains": lambda: text(0).contains(text(1)), "strstarts": lambda: text(0).startswith(text(1)), "strends": lambda: text(0).endswith(text(1)),
            "langmatches": lambda: (F.lower(text(0)) == F.lower(text(1))) | F.lower(text(0)).startswith(F.concat(F.lower(text(1)), F.lit("-"))),
            "sameterm": lambda: a[0].c == a[1].c, "isiri": lambda: term(0, "kind") == 0, "isliteral": lambda: term(0, "kind") == 1, "isnumeric": lambda: a[0].num().isNotNull(),
        }
        numbers = {
            "strlen": lambda: F.length(text(0)), "abs": lambda: F.abs(a[0].num()), "ceil": lambda: F.ceil(a[0].num()), "floor": lambda: F.floor(a[0].num()), "round": lambda: F.round(a[0].num()),
            "year": lambda: F.year(term(0, "ts")), "month": lambda: F.month(term(0, "ts")), "decimal": lambda: a[0].num(), "integer": lambda: a[0].num(),
        }
        if name in simple:
            return Value("str", simple[name]())
        if name in truths:
            return Value("bool", truths[name]())
        if name in numbers:
            return Value("num", numbers[name]().cast(NUMBER))
        if name in ("if", "coalesce"):
            picks = a[1:] if name == "if" else a
            num = all(x.kind == "num" for x in picks)
            cols = [x.num() if num else x.lex() for x in picks]
            return Value("num" if num else "str", F.when(self._truth(a[0]), cols[0]).otherwise(cols[1]) if name == "if" else F.coalesce(*cols))
        if name in ("date", "datetime"):
            return Value("ts", F.expr("null").cast("timestamp_ntz") if a[0].kind not in ("str", "term") else text(0).try_cast("timestamp_ntz"))
        raise QueryError(f"function {name} is not supported")

    def _truth(self, v: Value) -> Column:
        if v.kind == "bool":
            return v.c
        return v.num() != 0 if v.kind == "num" else F.length(v.lex()) > 0

    def truth(self, e: Expr, types: dict[str, str]) -> Column:
        return self._truth(self.value(e, types))

    # solution modifiers
    def aggregate(self, e: Expr, types: dict[str, str]) -> tuple[Column, str]:
        _, name, distinct, inner, separator = e
        if inner[0] == "star":
            return F.count("*"), "num"
        v = self.value(inner, types)
        if name == "count":
            return (F.count_distinct(v.c) if distinct else F.count(v.c)), "num"
        if name == "group_concat":
            items = F.collect_set(v.lex()) if distinct else F.collect_list(v.lex())
            return F.array_join(F.sort_array(items), separator), "str"
        if name in ("sum", "avg"):
            f = {("sum", False): F.sum, ("sum", True): F.sum_distinct}.get((name, distinct), F.avg)
            return F.coalesce(f(v.num()), F.lit(0).cast(NUMBER)), "num"
        f = {"min": F.min, "max": F.max, "sample": F.min}[name]
        return (f(v.num()), "num") if v.kind == "num" else (f(F.coalesce(v.num().cast("string"), v.lex())), "str") if name == "sample" else (f(v.num()), "num")

    def grouped(self, rel: Rel, q: Query) -> Rel:
        for name, value in q.group or []:
            if value != ("var", name):
                rel = self.extend(rel, name, value)
        keys = [n for n, _ in q.group or []]
        found: list[tuple[str, Column, str]] = []

        def lift(e: Expr) -> Expr:
            if e[0] == "agg":
                column, kind = self.aggregate(e, rel.types)
                found.append((f"_agg{len(found)}", column, kind))
                return ("var", found[-1][0])
            return tuple(lift(x) if isinstance(x, tuple) else x for x in e)

        chosen = [(n, lift(v)) for n, v in q.select or []]
        having, order = [lift(h) for h in q.having], [(lift(o), d) for o, d in q.order]
        for n, v in chosen:
            free = {x for x in _variables(v) if not x.startswith("_agg")} - set(keys)
            if free:
                raise QueryError(f"?{n} uses ?{', ?'.join(sorted(free))}, which is neither grouped nor aggregated")
        cols = [c for k in keys for c in rel.columns(k)]
        df = rel.df.groupBy(*cols).agg(*[c.alias(n) for n, c, _ in found]) if found else rel.df.select(*cols).distinct()
        out = Rel(df, {**{k: rel.types[k] for k in keys}, **{n: k for n, _, k in found}})
        for h in having:
            out = Rel(out.df.where(self.truth(h, out.types)), out.types)
        q2 = Query("select", None, chosen, q.distinct, order=order, limit=q.limit, offset=q.offset)
        return self.modify(out, q2)

    def modify(self, rel: Rel, q: Query) -> Rel:
        chosen = q.select if q.select is not None else [(n, ("var", n)) for n in rel.types if not n.startswith("_")]
        for n, v in chosen:
            if v != ("var", n):
                rel = self.extend(rel, n, v)
        for n, _ in chosen:
            if n not in rel.types:
                rel = Rel(rel.df.withColumn(n, F.lit(None).cast("string")), {**rel.types, n: "str"}, rel.maybe | {n})
        if q.order and not q.distinct:
            rel = Rel(rel.df.orderBy(*self.ordering(q, rel)), rel.types, rel.maybe)
        keep = [c for n, _ in chosen for c in rel.columns(n)]
        df = rel.df.select(*keep)
        out = Rel(df, {n: rel.types[n] for n, _ in chosen}, {n for n, _ in chosen if n in rel.maybe})
        if q.distinct:
            out.df = out.df.distinct()
            if q.order:
                out.df = out.df.orderBy(*self.ordering(q, out))
        if q.offset:
            out.df = out.df.offset(q.offset)
        if q.limit is not None:
            out.df = out.df.limit(q.limit)
        return out

    def ordering(self, q: Query, rel: Rel) -> list[Column]:
        out = []
        for e, down in q.order:
            v = self.value(e, rel.types)
            cols = [v.num(), v.lex()] if v.kind == "term" else [v.c]
            out += [c.desc() if down else c.asc() for c in cols]
        return out

    def select(self, q: Query) -> Rel:
        rel = self.compile(q.body)
        grouped = q.group is not None or any(_has_agg(v) for _, v in q.select or [])
        return self.grouped(rel, q) if grouped else self.modify(rel, q)

    def run(self, q: Query) -> DataFrame:
        """SELECT: one column per variable, unbound null.  ASK: one boolean row.  CONSTRUCT
        and DESCRIBE: distinct s, p, o."""
        if q.form == "ask":
            found = self.compile(q.body).df.limit(1)
            return found.agg((F.count("*") > 0).alias("answer"))
        if q.form == "construct":
            rel, parts = self.compile(q.body), []
            for t in q.template:
                side = [F.lit(x[1]) if x[0] == "iri" else F.lit(key_of(x)) if x[0] != "var" else self.as_term(rel, x[1]).df[x[1]] if rel.types[x[1]] == "term" else F.concat(F.lit('"'), F.col(x[1]).cast("string"), F.lit('"^^xsd:string')) for x in (t.s, t.p, t.o)]
                parts.append(rel.df.select(side[0].alias("s"), side[1].alias("p"), side[2].alias("o")))
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out.dropna().distinct()
        if q.form == "describe":
            me = q.target[1]
            cols = ["s", "p", F.col("o_key").alias("o")]
            return self.quads.where(F.col("s") == me).select(*cols).unionByName(self.quads.where(F.col("o_key") == me).select(*cols)).distinct()
        rel = self.select(q)
        return rel.df.select(*[(F.col(f"{n}__lex") if t == "term" else F.col(n)).alias(n) for n, t in rel.types.items()])


def _closed(path: Path) -> bool:
    """Whether a path has a closure, or a part of no edge."""
    return path.kind in ("plus", "star", "opt") or any(map(_closed, path.parts))


def _mentioned(node: object) -> set[str]:
    """All variables of a pattern, those of its filters included."""
    if isinstance(node, Filter):
        return _mentioned(node.child) | _variables(node.condition)
    if isinstance(node, (Join, LeftJoin, Union, Minus, Exists)):
        return _mentioned(node.left) | _mentioned(node.right) | (_variables(node.condition) if isinstance(node, LeftJoin) and node.condition else set())
    if isinstance(node, Extend):
        return _mentioned(node.child) | {node.name} | _variables(node.value)
    return variables_of(node)


def _has_agg(e: Expr) -> bool:
    return e[0] == "agg" or any(_has_agg(x) for x in e if isinstance(x, tuple))


def _variables(e: Expr) -> set[str]:
    if e[0] == "var":
        return {e[1]}
    return set().union(*(_variables(x) for x in e if isinstance(x, tuple))) if len(e) > 1 else set()


def ask(spark: SparkSession, quads: DataFrame, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Parse, compile and plan a query over quads."""
    return Compiler(quads).run(parse(text, prefixes))
