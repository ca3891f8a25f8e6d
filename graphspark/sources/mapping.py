"""Quads from relational tables.

A row becomes an individual ``<table>/<key>``, a foreign key an object property and a code
column an individual of a vocabulary.  ``quads`` is a union of one branch per predicate in
which the predicate is a constant: a pattern with a known predicate leaves a single branch
of the union, whose scan reads only the columns of that predicate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IRI, LITERAL, BLANK = 0, 1, 2
NUMBER = "decimal(28,8)"
XSD = {"string": "xsd:string", "int": "xsd:integer", "bigint": "xsd:integer", "double": "xsd:decimal", "timestamp_ntz": "xsd:dateTime", "boolean": "xsd:boolean"}

#: (predicate, table, subject key column, object): ">table:column" is a reference,
#: "=word" an IRI that stands for all rows, "*vocabulary:column" a code, else a literal column.
MAPPING = [
    ("type", "region", "r_regionkey", "=Region"), ("label", "region", "r_regionkey", "r_name"),
    ("type", "nation", "n_nationkey", "=Nation"), ("label", "nation", "n_nationkey", "n_name"), ("isPartOf", "nation", "n_nationkey", ">region:n_regionkey"),
    ("type", "customer", "c_custkey", "=Customer"), ("label", "customer", "c_custkey", "c_name"), ("locatedIn", "customer", "c_custkey", ">nation:c_nationkey"),
    ("balance", "customer", "c_custkey", "c_acctbal"), ("segment", "customer", "c_custkey", "*segment:c_mktsegment"),
    ("type", "supplier", "s_suppkey", "=Supplier"), ("label", "supplier", "s_suppkey", "s_name"), ("locatedIn", "supplier", "s_suppkey", ">nation:s_nationkey"),
    ("balance", "supplier", "s_suppkey", "s_acctbal"),
    ("type", "part", "p_partkey", "*class:p_type"), ("label", "part", "p_partkey", "p_name"), ("brand", "part", "p_partkey", "*brand:p_brand"),
    ("brandCode", "part", "p_partkey", "p_brand"), ("size", "part", "p_partkey", "p_size"), ("price", "part", "p_partkey", "p_retailprice"),
    ("type", "orders", "o_orderkey", "=Order"), ("placedBy", "orders", "o_orderkey", ">customer:o_custkey"), ("status", "orders", "o_orderkey", "*status:o_orderstatus"),
    ("total", "orders", "o_orderkey", "o_totalprice"), ("orderedOn", "orders", "o_orderkey", "o_orderdate"), ("priority", "orders", "o_orderkey", "*priority:o_orderpriority"),
]
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Name:
    """An IRI of a mapped row: its column, its prefix, and the key where that is a number."""

    c: Column
    at: str | None = None
    id: Column | None = None


def iri(prefix: str, column: str, df: DataFrame) -> Name:
    number = df.schema[column].dataType.simpleString() in ("int", "bigint")
    return Name(F.concat(F.lit(f"{prefix}/"), F.col(column).cast("string")), prefix, F.col(column).cast("long") if number else None)


def quad(g: Column, s: Name, p: Column, o: Name | Column, dt: str | None = None, num: Column | None = None, ts: Column | None = None) -> list[Column]:
    """The columns of a quad.  The key of a literal holds its datatype, so that equal keys
    are equal terms, while equal numbers may be of different keys.  The prefix and number
    of an IRI stand beside it: a constant IRI becomes a test of the key column."""
    named = isinstance(o, Name)
    lex = o.c if named else o
    key = lex if named else F.concat(F.lit('"'), lex, F.lit(f'"^^{dt}'))
    none = F.lit(None)
    return [
        g.alias("g"), s.c.alias("s"), p.alias("p"), key.alias("o_key"), F.lit(IRI if named else LITERAL).cast("tinyint").alias("o_kind"), lex.alias("o_lex"),
        F.lit(dt).cast("string").alias("o_dt"), none.cast("string").alias("o_lang"),
        (none if num is None else num).cast(NUMBER).alias("o_num"), (none if ts is None else ts).cast("timestamp_ntz").alias("o_ts"),
        F.lit(s.at).cast("string").alias("s_at"), (none if s.id is None else s.id).cast("long").alias("s_id"),
        F.lit(o.at if named else '"').cast("string").alias("o_at"), (none if not named or o.id is None else o.id).cast("long").alias("o_id"),
    ]


def branch(df: DataFrame, predicate: str, prefix: str, key: str, value: str, graph: str = "default") -> DataFrame:
    s, g, p = iri(prefix, key, df), F.lit(graph), F.lit(predicate)
    if value[0] == "=":
        return df.select(*quad(g, s, p, Name(F.lit(value[1:]), "")))
    if value[0] in ">*":
        to, column = value[1:].split(":")
        return df.where(F.col(column).isNotNull()).select(*quad(g, s, p, iri(to, column, df)))
    kind = df.schema[value].dataType.simpleString()
    number = F.col(value) if kind in ("int", "bigint", "double") else None
    if kind == "double":  # money: two decimal places
        number = F.col(value).cast("decimal(28,2)")
    lex = F.col(value).cast("string") if kind != "double" else number.cast("string")
    return df.where(F.col(value).isNotNull()).select(*quad(g, s, p, lex, XSD[kind], number, F.col(value) if kind == "timestamp_ntz" else None))


def quads(spark: SparkSession, sf_dir: str, tables: set[str] | None = None, extra: list[DataFrame] = ()) -> DataFrame:
    """Quads of the mapped tables, of lines of orders, of the class tree, and of ``extra``."""
    frames: dict[str, DataFrame] = {}
    out = []
    for predicate, name, key, value in MAPPING:
        if tables is None or name in tables:
            df = frames.setdefault(name, table(spark, sf_dir, name))
            out.append(branch(df, predicate, name, key, value))
    if tables is None or "part" in tables:
        part = frames["part"]
        tree = part.select("p_type").distinct()
        out.append(tree.select(*quad(F.lit("default"), iri("class", "p_type", tree), F.lit("subClassOf"), Name(F.lit("Part"), ""))))
    if tables is None or "lineitem" in tables:
        line = frames.setdefault("lineitem", table(spark, sf_dir, "lineitem"))
        for predicate, prefix, key in (("canProvide", "supplier", "l_suppkey"), ("hasPart", "orders", "l_orderkey")):
            pairs = line.select(key, "l_partkey").distinct()
            out.append(pairs.select(*quad(F.lit("default"), iri(prefix, key, pairs), F.lit(predicate), iri("part", "l_partkey", pairs))))
    union = out[0]
    for df in [*out[1:], *extra]:
        union = union.unionByName(df, allowMissingColumns=True)
    return union


def quads_from_rows(spark: SparkSession, rows: list[tuple], graph: str = "default") -> DataFrame:
    """Small fixtures: (s, p, o) where o is an IRI string, or a number, bool or ("text", lang)."""
    out = []
    for s, p, o in rows:
        if isinstance(o, tuple):
            out.append((graph, s, p, f'"{o[0]}"@{o[1]}' if o[1] else f'"{o[0]}"^^xsd:string', LITERAL, o[0], None if o[1] else "xsd:string", o[1], None, None))
        elif isinstance(o, (int, float)) and not isinstance(o, bool):
            dt = "xsd:integer" if isinstance(o, int) else "xsd:decimal"
            out.append((graph, s, p, f'"{o}"^^{dt}', LITERAL, str(o), dt, None, str(o), None))
        else:
            out.append((graph, s, p, str(o), IRI, str(o), None, None, None, None))
    df = spark.createDataFrame(out, "g string, s string, p string, o_key string, o_kind int, o_lex string, o_dt string, o_lang string, o_num string, o_ts timestamp_ntz")
    return df.withColumns({"o_kind": F.col("o_kind").cast("tinyint"), "o_num": F.col("o_num").cast(NUMBER)})
