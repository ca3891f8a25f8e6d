"""Entailment, rules, temporal and probabilistic queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import temporal
from ..operators.rules import SCHEMA_RULES, Rule, forward_chain
from ..registry import query
from ..sources.mapping import quads, table


def facts(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "s string, p string, o string")


@query("E1 E2 E3 E4 E27", "SELECT * FROM (VALUES ('Lathe','subClassOf','Asset'), ('l1','type','Machine'), ('l1','type','Asset'), ('l1','uses','c1'), ('c1','type','Coolant'), ('l1','type','Equipment')) v(s, p, o)")
def schema_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = facts(spark, [("Lathe", "subClassOf", "Machine"), ("Machine", "subClassOf", "Asset"), ("l1", "type", "Lathe"), ("cooledBy", "subPropertyOf", "uses"), ("cooledBy", "domain", "Equipment"), ("cooledBy", "range", "Coolant"), ("l1", "cooledBy", "c1")])
    return forward_chain(given, SCHEMA_RULES).select("s", "p", "o")


@query("E3 E4", "SELECT 'supplier/' || l_suppkey AS s, 'Provider' AS o FROM lineitem GROUP BY 1 UNION ALL SELECT 'part/' || l_partkey, 'Provided' FROM lineitem GROUP BY 1")
def rdfs_domain_range_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that follow from the domain and the range of a property, by the rule engine."""
    q = quads(spark, sf_dir, {"lineitem"}).where("p = 'canProvide'").select("s", "p", F.col("o_key").alias("o"))
    given = q.unionByName(facts(spark, [("canProvide", "domain", "Provider"), ("canProvide", "range", "Provided")]))
    return forward_chain(given, [r for r in SCHEMA_RULES if r.name in ("domain", "range")]).select("s", "o")


@query("E7 E8 E13", "SELECT * FROM (VALUES ('b', 'partOf', 'a'), ('a', 'near', 'c'), ('m', 'locatedIn', 'site'), ('m', 'locatedIn', 'plant')) v(s, p, o)")
def inverse_symmetric_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = facts(spark, [("hasPart", "inverseOf", "partOf"), ("a", "hasPart", "b"), ("near", "type", "SymmetricProperty"), ("c", "near", "a"), ("m", "locatedIn", "hall"), ("hall", "isPartOf", "site"), ("site", "isPartOf", "plant")])
    chain = Rule("located-chain", [("?x", "locatedIn", "?y"), ("?y", "isPartOf", "?z")], [("?x", "locatedIn", "?z")])
    return forward_chain(given, [*SCHEMA_RULES[6:8], chain]).select("s", "p", "o")


@query("E9", """SELECT l_orderkey || '/' || l_linenumber AS line, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT DISTINCT x.l_orderkey, x.l_linenumber, x.l_partkey AS a, y.l_partkey AS b
FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber AND x.l_partkey < y.l_partkey)""")
def functional_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values of a functional property: the same-as pairs that follow."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    a, b = line.withColumnRenamed("l_partkey", "a"), line.withColumnRenamed("l_partkey", "b")
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("a < b").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("line"), "a", "b")


@query("E10 ER4", "SELECT n_nationkey AS a, s_suppkey AS b FROM (SELECT s_nationkey AS n_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1 HAVING count(*) > 1)")
def key_merge_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("b"), F.count("*").alias("n"))
    return s.where("n > 1").select(F.col("s_nationkey").alias("a"), "b")


@query("E12 E14 E28 G6", "SELECT * FROM (VALUES ('asymmetric', 'a', 'b'), ('irreflexive', 'c', 'c'), ('disjoint', 'x', 'Man')) v(kind, s, o)")
def disjoint_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected inconsistencies: asymmetric, irreflexive and disjoint; none found isn't a proof."""
    f = facts(spark, [("a", "above", "b"), ("b", "above", "a"), ("c", "above", "c"), ("x", "type", "Man"), ("x", "type", "Machine"), ("y", "type", "Man")])
    above = f.where("p = 'above'").select("s", "o")
    asym = above.join(above.select(F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"]).where("s < o").select(F.lit("asymmetric").alias("kind"), "s", "o")
    irr = above.where("s = o").select(F.lit("irreflexive").alias("kind"), "s", "o")
    pairs = spark.createDataFrame([("Man", "Machine")], "c1 string, c2 string")
    t = f.where("p = 'type'").select("s", "o")
    dis = t.join(pairs, t.o == pairs.c1).join(t.select("s", F.col("o").alias("o2")), "s").where("o2 = c2").select(F.lit("disjoint").alias("kind"), "s", "o")
    return asym.unionByName(irr).unionByName(dis)


@query("E15 E16 E17 E18 E21", """WITH l AS (SELECT l_orderkey AS k, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS o, coalesce(r > 0, false) AS some_returned, coalesce(r = n, true) AS all_returned, coalesce(n > 0 AND r = n, false) AS all_and_some FROM orders LEFT JOIN l ON k = o_orderkey""")
def restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some, all (true of nothing at all) and both, as tests of membership."""
    orders, line = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o")), table(spark, sf_dir, "lineitem")
    n = line.groupBy(F.col("l_orderkey").alias("o")).agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    return orders.join(n, "o", "left").select("o", F.coalesce(F.col("r") > 0, F.lit(False)).alias("some_returned"), F.coalesce(F.col("r") == F.col("n"), F.lit(True)).alias("all_returned"), F.coalesce((F.col("r") == F.col("n")) & (F.col("n") > 0), F.lit(False)).alias("all_and_some"))


@query("E22 E23", "SELECT * FROM (VALUES ('rigid-below-antirigid', 'Person', 'Student'), ('undefined', 'colour', NULL)) v(kind, a, b)")
def ontology_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = spark.createDataFrame([("Person", "Student"), ("Student", "Agent")], "a string, b string")
    meta = spark.createDataFrame([("Person", "+R"), ("Student", "~R"), ("Agent", "~R")], "cls string, tag string")
    bad = sub.join(meta.where("tag = '+R'"), sub.a == meta.cls).select("a", "b").join(meta.where("tag = '~R'").select(F.col("cls").alias("b")), "b").select(F.lit("rigid-below-antirigid").alias("kind"), "a", "b")
    used, known = spark.createDataFrame([("name",), ("colour",)], "a string"), spark.createDataFrame([("name",)], "a string")
    return bad.unionByName(used.join(known, "a", "left_anti").select(F.lit("undefined").alias("kind"), "a", F.lit(None).cast("string").alias("b")))


@query("E25 E26 M17", """SELECT 'supplier/' || s_suppkey AS s, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49) THEN 'yes' WHEN s_nationkey < 10 THEN 'no' ELSE 'unknown' END AS answer FROM supplier""")
def three_valued_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No record means no only where the nation is declared complete; else unknown."""
    s = table(spark, sf_dir, "supplier")
    bad = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"), F.lit(True).alias("found")).distinct()
    complete = spark.range(10).select(F.col("id").cast("int").alias("s_nationkey"), F.lit(True).alias("declared"))
    j = s.join(bad, "s_suppkey", "left").join(complete, "s_nationkey", "left")
    return j.select(F.concat(F.lit("supplier/"), "s_suppkey").alias("s"), F.when(F.col("found"), "yes").when(F.col("declared"), "no").otherwise("unknown").alias("answer"))


@query("E29 E30", "SELECT 'l1' AS s, 'Lathe' AS cls")
def most_specific_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = facts(spark, [("Lathe", "subClassOf", "Machine"), ("Machine", "subClassOf", "Asset"), ("l1", "type", "Lathe")])
    every = given.unionByName(forward_chain(given, SCHEMA_RULES[:2]).select("s", "p", "o"))
    types = every.where("p = 'type'").select("s", F.col("o").alias("cls"))
    above = every.where("p = 'subClassOf'").select(F.col("s").alias("lower"), F.col("o").alias("cls"))
    general = above.join(types.select("s", F.col("cls").alias("lower")), "lower").select("s", "cls")
    return types.join(general, ["s", "cls"], "left_anti")


@query("E32 R11", "SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 2")
def one_task_per_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("s"), F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n")).where("n > 2")


@query("R1 R2 R3 R4 R10 R18 R20", """SELECT 'part/' || p_partkey AS s, 'type' AS p, 'Large' AS o, 'large' AS rule, 1 AS round FROM part WHERE p_size > 45
UNION ALL SELECT 'part/' || p_partkey, 'needs', 'Crate', 'crate', 2 FROM part WHERE p_size > 45""")
def rule_two_step_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("s"), F.lit("size").alias("p"), F.col("p_size").cast("string").alias("o"))
    rules = [Rule("large", [("?x", "size", "?z")], [("?x", "type", "Large")], "try_cast(z AS int) > 45"), Rule("crate", [("?x", "type", "Large")], [("?x", "needs", "Crate")])]
    return forward_chain(part, rules)


@query("R5 R7 R13", "SELECT 'm1' AS x, 'LongMaintenance' AS o UNION ALL SELECT 'm2', 'Inspect'")
def rule_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in seconds; the present is a parameter."""
    f = facts(spark, [("m1", "start", "1000"), ("m1", "end", "100000"), ("m2", "start", "0"), ("m2", "end", "50"), ("m2", "faultAt", "7000000")])
    now = 8000000
    rules = [
        Rule("long", [("?x", "start", "?a"), ("?x", "end", "?b")], [("?x", "type", "LongMaintenance")], "try_cast(b AS long) - try_cast(a AS long) > 86400"),
        Rule("inspect", [("?x", "faultAt", "?t")], [("?x", "type", "Inspect")], f"{now} - try_cast(t AS long) <= 2592000"),
    ]
    return forward_chain(f, rules).select(F.col("s").alias("x"), "o")


@query("R8", "SELECT 'j2' AS s, 'recommended' AS p, 'milling' AS o")
def rule_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, [("j1", "material", "steel"), ("j1", "feature", "slot"), ("j1", "process", "milling"), ("j2", "material", "steel"), ("j2", "feature", "slot"), ("j3", "material", "wood"), ("j3", "feature", "slot")])
    rule = Rule("recommend", [("?a", "material", "?m"), ("?a", "feature", "?f"), ("?a", "process", "?q"), ("?b", "material", "?m"), ("?b", "feature", "?f")], [("?b", "recommended", "?q")], "a <> b")
    return forward_chain(f, [rule]).select("s", "p", "o")


@query("R9 R16 R19", "SELECT * FROM (VALUES ('weld', 'precedes', 'heat'), ('heat', 'canStart', 'true')) v(s, p, o)")
def rules_feed_each_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, [("weld", "kind", "Welding"), ("heat", "kind", "HeatTreatment"), ("weld", "part", "p1"), ("heat", "part", "p1"), ("weld", "state", "done")])
    rules = [Rule("order", [("?a", "kind", "Welding"), ("?a", "part", "?p"), ("?b", "part", "?p"), ("?b", "kind", "HeatTreatment")], [("?a", "precedes", "?b")]), Rule("start", [("?a", "precedes", "?b"), ("?a", "state", "done")], [("?b", "canStart", "true")])]
    return forward_chain(f, rules).select("s", "p", "o")


@query("R12 R17", """SELECT DISTINCT l_suppkey AS s FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 48 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def rule_capability_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of large parts without the capability, which a closed list grants."""
    need = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_size > 48"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s")).distinct()
    able = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("s"))
    return need.join(able, "s", "left_anti")


@query("R14", "SELECT * FROM (VALUES ('e1', 2.5), ('e3', NULL)) v(e, ttc) WHERE ttc < 3")
def time_to_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([("e1", 25.0, 30.0, 20.0), ("e2", 50.0, 25.0, 20.0), ("e3", 10.0, 20.0, 20.0)], "e string, gap double, own double, other double")
    return d.select("e", F.try_divide("gap", F.nullif(F.col("own") - F.col("other"), F.lit(0.0))).cast("decimal(3,1)").alias("ttc")).where("ttc < 3 AND ttc > 0")


@query("J11 R15", "SELECT 'w1' AS wall, CAST(0.50 AS DECIMAL(4,2)) AS u, CAST(0.40 AS DECIMAL(4,2)) AS lim")
def parameterised_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    walls = spark.createDataFrame([("w1", "cold", "0.50"), ("w2", "warm", "0.50")], "wall string, zone string, u string")
    limits = spark.createDataFrame([("cold", "0.40"), ("warm", "0.80")], "zone string, lim string")
    j = walls.join(limits, "zone").select("wall", F.col("u").cast("decimal(4,2)").alias("u"), F.col("lim").cast("decimal(4,2)").alias("lim"))
    return j.where("u > lim")


_ALL = "SELECT l_suppkey AS r, least(o_orderdate, l_shipdate) AS s, greatest(o_orderdate, l_shipdate) AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey"
_IV = f"SELECT row_number() OVER () AS id, * FROM ({_ALL} WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-02-01')"
#: Pairs by sums: starts before an end less ends by a start, with empty intervals put right.
_COUNTED = """WITH i AS ({rows}), st AS (SELECT {key} t, sum(n) OVER ({part} ORDER BY t) AS n FROM (SELECT {key} s AS t, count(*) AS n FROM i GROUP BY {key} s)), en AS (SELECT {key} t, sum(n) OVER ({part} ORDER BY t) AS n FROM (SELECT {key} e AS t, count(*) AS n FROM i GROUP BY {key} e)),
dg AS (SELECT {key} s AS t, count(*) AS n FROM i WHERE s = e GROUP BY {key} s), a AS (SELECT i.*, st.n AS begun FROM i ASOF LEFT JOIN st ON {on_st} i.e > st.t), b AS (SELECT a.*, en.n AS ended FROM a ASOF LEFT JOIN en ON {on_en} a.s >= en.t)
SELECT {name} CAST((sum(coalesce(begun, 0) - coalesce(ended, 0) + CASE WHEN b.s = b.e THEN dg.n ELSE -1 END)) / 2 AS DECIMAL(38,0)) AS pairs FROM b LEFT JOIN dg ON {on_dg} b.s = dg.t {group}"""


def intervals(spark: SparkSession, sf_dir: str, month: bool = True) -> DataFrame:
    """From the earlier to the later of order and shipment, with a number among those of the supplier."""
    line = table(spark, sf_dir, "lineitem")
    if month:
        line = line.where("l_shipdate >= TIMESTAMP_NTZ '1995-01-01' AND l_shipdate < TIMESTAMP_NTZ '1995-02-01'")
    j = line.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("l_suppkey", F.least("o_orderdate", "l_shipdate").cast("timestamp").alias("start"), F.greatest("o_orderdate", "l_shipdate").cast("timestamp").alias("end"))


@query("J9 R6 T3", f"WITH i AS ({_IV}) SELECT a.r AS supplier, count(*) AS pairs FROM i a JOIN i b ON a.r = b.r AND a.id < b.id AND a.s < b.e AND a.e > b.s GROUP BY a.r")
def interval_conflicts_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conflicts of one month's shipments, as pairs: the month is what is asked for.
    ``interval_conflicts_all`` counts those of all time."""
    i = intervals(spark, sf_dir)
    i = i.withColumn("id", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("start", "end")))
    return temporal.overlapping(i, "l_suppkey").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("pairs"))


@query("J9 R6", _COUNTED.format(rows=_ALL, key="r,", part="PARTITION BY r", on_st="i.r = st.r AND", on_en="a.r = en.r AND", name="b.r AS supplier,", on_dg="b.r = dg.r AND", group="GROUP BY b.r"))
def interval_conflicts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's overlapping pairs of intervals of all time, counted without making them."""
    return temporal.overlap_count(intervals(spark, sf_dir, month=False), "l_suppkey").withColumnRenamed("l_suppkey", "supplier")


@query("J10", _COUNTED.format(rows=_ALL, key="", part="", on_st="", on_en="", name="", on_dg="", group=""))
def range_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlapping pairs of all intervals, counted without making them."""
    return temporal.overlap_count(intervals(spark, sf_dir, month=False))


@query("T2 T3", """WITH p AS (SELECT unnest(range(6)) AS v), i AS (SELECT a.v AS s, b.v AS e FROM p a JOIN p b ON a.v < b.v)
SELECT CASE WHEN x.e < y.s THEN 'before' WHEN x.e = y.s THEN 'meets' WHEN x.s > y.e THEN 'after' WHEN x.s = y.e THEN 'met_by' WHEN x.s = y.s AND x.e = y.e THEN 'equal'
WHEN x.s = y.s AND x.e < y.e THEN 'starts' WHEN x.s = y.s THEN 'started_by' WHEN x.e = y.e AND x.s > y.s THEN 'finishes' WHEN x.e = y.e THEN 'finished_by'
WHEN x.s < y.s AND x.e > y.e THEN 'contains' WHEN x.s > y.s AND x.e < y.e THEN 'during' WHEN x.s < y.s THEN 'overlaps' ELSE 'overlapped_by' END AS relation, count(*) AS n FROM i x, i y GROUP BY 1""")
def allen_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    both = spark.createDataFrame([(*x, *y) for x in p for y in p], "s1 int, e1 int, s2 int, e2 int")
    return both.select(temporal.allen(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


@query("T4", "SELECT * FROM (VALUES ('before', 'before', 'before'), ('during', 'during', 'during'), ('overlaps', 'overlaps', 'before,meets,overlaps')) v(a, b, gives)")
def allen_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composition table, found by enumeration of end points."""
    p = spark.createDataFrame([(a, b) for a in range(7) for b in range(a + 1, 7)], "s int, e int")
    x, y, z = (p.select(F.col("s").alias(f"s{k}"), F.col("e").alias(f"e{k}")) for k in (1, 2, 3))
    rel = lambda i, j: temporal.allen(F.col(f"s{i}"), F.col(f"e{i}"), F.col(f"s{j}"), F.col(f"e{j}"))
    t = x.crossJoin(y).crossJoin(z).select(rel(1, 2).alias("a"), rel(2, 3).alias("b"), rel(1, 3).alias("c"))
    out = t.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set("c")), ",").alias("gives"))
    return out.where("a = b AND a IN ('before', 'during', 'overlaps')")


@query("T1 SO3", """WITH a AS (SELECT DISTINCT l_suppkey AS s, l_linestatus || l_returnflag AS st FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-02-01'),
b AS (SELECT DISTINCT l_suppkey AS s, l_linestatus || l_returnflag AS st FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-02-01' AND l_shipdate < TIMESTAMP '1995-03-01')
SELECT *, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def snapshot_diff_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    month = lambda a, b: line.where(f"l_shipdate >= TIMESTAMP_NTZ '{a}' AND l_shipdate < TIMESTAMP_NTZ '{b}'").select(F.col("l_suppkey").alias("s"), F.concat("l_linestatus", "l_returnflag").alias("st")).distinct()
    old, new = month("1995-01-01", "1995-02-01"), month("1995-02-01", "1995-03-01")
    return old.exceptAll(new).withColumn("change", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("change", F.lit("added")))


@query("J22 T6", """SELECT c.c_custkey AS k, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1996-06-30') AS value FROM customer c
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1996-06-30')""")
def as_of_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.col("o_orderdate").alias("v"))
    at = o.select("k").distinct().withColumn("at", F.lit("1996-06-30").cast("timestamp_ntz"))
    return temporal.as_of(o, at, "k", "t", "v").where("value IS NOT NULL").select("k", "value")


@query("P1 P2", "SELECT CAST(0.1352 AS DECIMAL(6,4)) AS marginal, CAST(0.51 AS DECIMAL(6,4)) AS conditional, CAST(0.7544 AS DECIMAL(6,4)) AS posterior")
def bayes_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conditional table with priors 0.20 and 0.35: total probability, condition, posterior."""
    cpt = spark.createDataFrame([(True, True, "0.90"), (True, False, "0.30"), (False, True, "0.10"), (False, False, "0.01")], "hot boolean, lng boolean, p string")
    w = F.when(F.col("hot"), F.lit("0.20")).otherwise("0.80").cast("decimal(6,4)") * F.when(F.col("lng"), F.lit("0.35")).otherwise("0.65").cast("decimal(6,4)")
    p = F.col("p").cast("decimal(6,4)")
    t = cpt.agg(F.sum(w * p).alias("m"), F.sum(F.when(F.col("hot"), w * p)).alias("h"), F.sum(F.when(F.col("hot"), w)).alias("ph"))
    return t.select(F.round("m", 4).cast("decimal(6,4)").alias("marginal"), F.round(F.col("h") / F.col("ph"), 4).cast("decimal(6,4)").alias("conditional"), F.round(F.col("h") / F.col("m"), 4).cast("decimal(6,4)").alias("posterior"))


@query("P3", "SELECT lang, CAST(round((sum(quality) + 1) / CAST(count(*) + 2 AS DOUBLE), 6) AS DECIMAL(8,6)) AS p FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def smoothed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.round((F.sum("quality") + 1) / (F.count("*") + 2), 6).cast("decimal(8,6)").alias("p"))
