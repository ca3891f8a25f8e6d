"""Shapes over orders and lines, and gates over fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shapes import Constraint, Shape, route, validate
from ..registry import query
from ..sources.mapping import quads, quads_from_rows, table

_V = "'{shape}' AS shape, {focus} AS focus, '{path}' AS path, {value} AS value, '{kind}' AS \"constraint\", '{severity}' AS severity, '{message}' AS message"


@query("SH1 SH2 SH3", f"""WITH n AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT {_V.format(shape='OrderShape', focus="'orders/' || o_orderkey", path='hasPart', value="CAST(coalesce(n, 0) AS VARCHAR)", kind='minCount', severity='Violation', message='an order needs a part')} FROM orders LEFT JOIN n ON k = o_orderkey WHERE coalesce(n, 0) < 1
UNION ALL SELECT {_V.format(shape='OrderShape', focus="'orders/' || o_orderkey", path='hasPart', value="CAST(n AS VARCHAR)", kind='maxCount', severity='Warning', message='many parts')} FROM orders JOIN n ON k = o_orderkey WHERE n > 6""")
def shape_mincount_maxcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads(spark, sf_dir, {"orders", "lineitem"})
    return validate(q, [Shape("OrderShape", "Order", [Constraint("hasPart", "minCount", 1, message="an order needs a part"), Constraint("hasPart", "maxCount", 6, "Warning", "many parts")])])


@query("SH8 SH11 SH12", f"""SELECT {_V.format(shape='StatusShape', focus="'orders/' || o_orderkey", path='status', value="'status/' || o_orderstatus", kind='in', severity='Warning', message='status is not final')} FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def shape_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(quads(spark, sf_dir, {"orders"}), [Shape("StatusShape", "Order", [Constraint("status", "in", ["status/O", "status/F"], "Warning", "status is not final")])])


@query("SH5 SH4", f"""SELECT {_V.format(shape='PlaceShape', focus="'supplier/' || s_suppkey", path='locatedIn', value="'nation/' || s_nationkey", kind='class', severity='Violation', message='a place is a region')} FROM supplier""")
def shape_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads(spark, sf_dir, {"supplier", "nation", "region"})
    return validate(q, [Shape("PlaceShape", "Supplier", [Constraint("locatedIn", "class", "Region", message="a place is a region"), Constraint("balance", "datatype", "xsd:decimal")])])


@query("SH6 SH7", f"""SELECT {_V.format(shape='PartShape', focus="'part/' || p_partkey", path='size', value="CAST(p_size AS VARCHAR)", kind='maxInclusive', severity='Violation', message='too large')} FROM part WHERE p_size > 40
UNION ALL SELECT {_V.format(shape='PartShape', focus="'part/' || p_partkey", path='brandCode', value="p_brand", kind='pattern', severity='Violation', message='unknown brand')} FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-4][0-9]$')""")
def shape_range_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(quads(spark, sf_dir, {"part"}), [Shape("PartShape", "Part", [Constraint("size", "maxInclusive", 40, message="too large"), Constraint("size", "minExclusive", 0), Constraint("brandCode", "pattern", "^Brand#[1-4][0-9]$", message="unknown brand")])])


@query("SH9 SH10", "SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate <= o_orderdate")
def shape_less_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end before they begin: a condition over two properties of joined nodes."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.where("l_shipdate <= o_orderdate").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))


@query("SH13", f"SELECT {_V.format(shape='S', focus=chr(39) + 'e2' + chr(39), path='serial', value=chr(39) + '0' + chr(39), kind='minCount', severity='Violation', message='serial number is missing')}")
def shape_single_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads_from_rows(spark, [("e1", "type", "Equipment"), ("e1", "serial", ("EQ-2026-0001", None)), ("e2", "type", "Equipment")])
    return validate(q, [Shape("S", "Equipment", [Constraint("serial", "minCount", 1, message="serial number is missing"), Constraint("serial", "pattern", "^EQ-[0-9]{4}-[0-9]{4}$")])])


@query("SH14 SH15 SH22 V1 V16 V25", "SELECT * FROM (VALUES ('c2', 'reviewer'), ('c3', 'scope'), ('c3', 'reviewer')) v(focus, slot)")
def shape_required_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads_from_rows(spark, [(c, "type", "Claim") for c in ("c1", "c2", "c3")] + [("c1", "scope", "s"), ("c1", "reviewer", "r"), ("c2", "scope", "s")])
    return validate(q, [Shape("Claim", "Claim", [Constraint("", "required", ["scope", "reviewer"])])]).select("focus", F.col("value").alias("slot"))


@query("SH16", "SELECT * FROM (VALUES ('d2', 'reason'), ('d3', 'affected')) v(d, missing)")
def shape_conditional_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retained decision needs a reason, a void one the set of what it affects."""
    d = spark.createDataFrame([("d1", "retain", "because", []), ("d2", "retain", None, ["x"]), ("d3", "void", "r", []), ("d4", "void", None, ["x"])], "d string, verdict string, reason string, affected array<string>")
    return d.select("d", F.when((F.col("verdict") == "retain") & F.col("reason").isNull(), "reason").when((F.col("verdict") == "void") & (F.size("affected") == 0), "affected").alias("missing")).where("missing IS NOT NULL")


@query("SH17 V18", "SELECT 'ev2' AS member, 'RC17' AS bound, 'RC18' AS declared")
def shape_package_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.createDataFrame([("p1", "ev1", "RC18"), ("p1", "ev2", "RC17")], "package string, member string, bound string")
    p = spark.createDataFrame([("p1", "RC18")], "package string, declared string")
    return m.join(p, "package").where("bound <> declared").select("member", "bound", "declared")


@query("SH18", """SELECT 'nation/' || n_nationkey AS nation FROM nation WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT c_mktsegment AS g FROM customer) WHERE NOT EXISTS
(SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = g))""")
def shape_relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose customers cover every segment: as many distinct segments as there are."""
    c = table(spark, sf_dir, "customer")
    own = c.groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("n"))
    every = c.agg(F.count_distinct("c_mktsegment").alias("every"))
    return own.join(every, F.col("n") == F.col("every")).select(F.concat(F.lit("nation/"), "c_nationkey").alias("nation"))


@query("SH19", "SELECT 'u2' AS unit")
def shape_revision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "rev string, n int")
    u = spark.createDataFrame([("u1", "C", "B"), ("u2", "A", "B"), ("u3", "B", "B")], "unit string, rev string, required string")
    need = order.select(F.col("rev").alias("required"), F.col("n").alias("least"))
    return u.join(order, "rev").join(need, "required").where("n < least").select("unit")


@query("SH20 SH21 V2 V7", "SELECT * FROM (VALUES ('x1', 'Stale', 'NeedsReopen'), ('x2', 'Current', 'Kept')) v(exclusion, premise, claim)")
def shape_stale_premise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame([("x1", "f1", 1), ("x2", "f2", 2)], "exclusion string, fact string, version int")
    now = spark.createDataFrame([("f1", 2), ("f2", 2)], "fact string, current int")
    stale = F.col("version") < F.col("current")
    return e.join(now, "fact").select("exclusion", F.when(stale, "Stale").otherwise("Current").alias("premise"), F.when(stale, "NeedsReopen").otherwise("Kept").alias("claim"))


@query("SH23", "SELECT 'ECU' AS token, 'Part' AS a, 'Software' AS b")
def shape_name_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("ECU", "Part"), ("ECU", "Software"), ("Bolt", "Part")], "token string, kind string")
    pairs = spark.createDataFrame([("Part", "Software")], "a string, b string")
    return t.join(pairs, t.kind == pairs.a).join(t.select("token", F.col("kind").alias("k2")), "token").where("k2 = b").select("token", "a", "b")


@query("SK5 SC16 ST2", "SELECT 'quarantine' AS lane, count(*) AS n FROM part WHERE p_size > 45 UNION ALL SELECT 'ticket', count(*) FROM part WHERE p_size > 30")
def quarantine_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validate(quads(spark, sf_dir, {"part"}), [Shape("P", "Part", [Constraint("size", "maxInclusive", 45), Constraint("size", "maxInclusive", 30, "Warning")])])
    bad, tickets = route(v)
    return bad.agg(F.lit("quarantine").alias("lane"), F.count("*").alias("n")).unionByName(tickets.agg(F.lit("ticket").alias("lane"), F.count("*").alias("n")))


@query("G13", "SELECT p_type AS class, count(*) AS affected FROM part GROUP BY 1")
def class_migration_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("class")).agg(F.count("*").alias("affected"))
