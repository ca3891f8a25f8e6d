"""Operators that small fixtures show as worked examples, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import governance, paths, temporal
from ..operators.rules import SCHEMA_RULES, Rule, forward_chain
from ..operators.shapes import Constraint, Shape, validate
from ..plans.compile import ask
from ..registry import query
from ..sources.mapping import LITERAL, NUMBER, quads, table


def triples(df: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))


def name(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix}/"), F.col(column).cast("string"))


def as_quads(facts: DataFrame, graph: Column | None = None, lang: Column | None = None) -> DataFrame:
    """Quads of (s, p, o): IRIs, or texts in a language."""
    none, key = F.lit(None), F.col("o") if lang is None else F.concat(F.lit('"'), F.col("o"), F.lit('"@'), lang)
    return facts.select(
        (F.lit("default") if graph is None else graph).alias("g"), "s", "p", key.alias("o_key"), F.lit(0 if lang is None else LITERAL).cast("tinyint").alias("o_kind"), F.col("o").alias("o_lex"),
        none.cast("string").alias("o_dt"), (none if lang is None else lang).cast("string").alias("o_lang"), none.cast(NUMBER).alias("o_num"), none.cast("timestamp_ntz").alias("o_ts"),
    )


@query("GP3", "SELECT DISTINCT 'n' || n_nationkey AS x FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = s_nationkey")
def trade_within_a_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable twice in one pattern: nations that sell to themselves."""
    j = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct().join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sells = j.select(F.concat(F.lit("n"), "s_nationkey").alias("s"), F.lit("sellsTo").alias("p"), F.concat(F.lit("n"), "c_nationkey").alias("o")).distinct()
    return ask(spark, as_quads(sells), "SELECT ?x WHERE { ?x :sellsTo ?x }")


@query("GP9", "SELECT 'doc/' || doc_id AS d, substr(text, 1, 20) AS t FROM documents WHERE lang = 'de' AND length(text) > 0 AND NOT contains(substr(text, 1, 20), '\"')")
def titles_in_a_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(name("doc", "doc_id").alias("s"), F.lit("title").alias("p"), F.substring("text", 1, 20).alias("o"), "lang").where("length(o) > 0 AND NOT contains(o, '\"')")
    return ask(spark, as_quads(d, lang=F.col("lang")), 'SELECT ?d ?t WHERE { ?d :title ?t FILTER langMatches(lang(?t), "de") }')


@query("GP13", "SELECT 'part/' || p_partkey AS p, p_size % 2 = 0 AS by_value, false AS by_term FROM part")
def equal_value_other_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's size as a decimal too, every odd one wrong: equal numbers are never one term here."""
    part = table(spark, sf_dir, "part").select(name("part", "p_partkey").alias("s"), F.lit("sizeDecimal").alias("p"), F.concat(F.col("p_size") + F.col("p_size") % 2, F.lit(".0")).alias("o"))
    decimals = as_quads(part).withColumns({"o_key": F.concat(F.lit('"'), "o_lex", F.lit('"^^xsd:decimal')), "o_kind": F.lit(LITERAL).cast("tinyint"), "o_dt": F.lit("xsd:decimal"), "o_num": F.col("o_lex").cast(NUMBER)})
    q = quads(spark, sf_dir, {"part"}, extra=[decimals])
    return ask(spark, q, "SELECT ?p (?v = ?z AS ?by_value) (sameTerm(?v, ?z) AS ?by_term) WHERE { ?p :sizeDecimal ?v ; :size ?z }")


@query("J4", """WITH f AS (SELECT 'customer/' || c_custkey AS c, CASE WHEN c_mktsegment = 'BUILDING' THEN 'nation/' || c_nationkey END AS n FROM customer WHERE c_custkey <= 60)
SELECT c, 'nation/' || n_nationkey AS n, 'region/' || n_regionkey AS r FROM f JOIN nation ON f.n IS NULL OR f.n = 'nation/' || n_nationkey""")
def join_on_what_may_be_unbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty customers, as a row without a nation joins with every nation."""
    few = triples(table(spark, sf_dir, "customer").where("c_custkey <= 60"), name("customer", "c_custkey"), "asked", F.lit("yes"))
    near = triples(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), name("customer", "c_custkey"), "builtIn", name("nation", "c_nationkey"))
    q = as_quads(few).unionByName(as_quads(near)).unionByName(quads(spark, sf_dir, {"nation"}), allowMissingColumns=True)
    return ask(spark, q, "SELECT ?c ?n ?r WHERE { { ?c :asked <yes> OPTIONAL { ?c :builtIn ?n } } { ?n :isPartOf ?r } }")


@query("SC19 M4 M11", "SELECT 'orders/' || o_orderkey AS o, 'status/' || o_orderstatus AS st FROM orders WHERE year(o_orderdate) = 1996")
def graph_of_a_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("g", F.concat(F.lit("y"), F.year("o_orderdate")))
    q = as_quads(o.select(name("orders", "o_orderkey").alias("s"), F.lit("status").alias("p"), name("status", "o_orderstatus").alias("o"), "g"), F.col("g"))
    return ask(spark, q, "SELECT ?o ?st WHERE { GRAPH <y1996> { ?o :status ?st } }")


@query("PP8", """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), a AS (SELECT k FROM l WHERE n = 1)
SELECT a.k || '/1' AS src, k2.k || '/' || k2.n AS dst, CAST(k2.n - 1 AS INTEGER) AS hops, array_to_string([a.k || '/' || i FOR i IN range(1, k2.n + 1)], '>') AS way FROM a JOIN l k2 ON k2.k = a.k AND k2.n BETWEEN 2 AND 4
WHERE (SELECT count(*) FROM l x WHERE x.k = a.k AND x.n <= k2.n) = k2.n""")
def lines_within_three_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first line of each order, with the way there."""
    from .path_queries import precedes

    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.concat("l_orderkey", F.lit("/1")).alias("src")).distinct()
    out = paths.hops(precedes(spark, sf_dir), 3, lines)
    return out.select("src", "dst", "hops", F.array_join("path", ">").alias("way"))


@query("PP11 V12", """SELECT 'v' || o_orderkey AS v, bool_and(l_returnflag <> 'R') AS closed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def sources_of_orders_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's value is closed if the chains of all its lines end in a measurement: those of returned lines don't."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    step = F.concat_ws("/", F.lit("d"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    end = F.concat(F.when(F.col("l_returnflag") == "R", "open/").otherwise("m/"), step)
    e = line.select(F.concat(F.lit("v"), "l_orderkey").alias("src"), step.alias("dst")).unionByName(line.select(step.alias("src"), end.alias("dst"))).distinct()
    values = e.where("src LIKE 'v%'").select("src").distinct()
    ends = paths.one_or_more(e, values).where("dst NOT LIKE 'd/%'")
    return ends.groupBy(F.col("src").alias("v")).agg(F.bool_and(F.col("dst").startswith("m/")).alias("closed"))


@query("E1 E2 E27 E31", """WITH t AS (SELECT DISTINCT p_partkey AS k, p_type AS c, string_split(p_type, ' ')[1] AS top FROM part)
SELECT 'part/' || k AS s, 'type' AS p, top AS o FROM t UNION SELECT 'part/' || k, 'type', 'Thing' FROM t UNION SELECT 'class/' || c, 'subClassOf', 'Thing' FROM t UNION SELECT 'part/' || p_partkey, 'has', 'size' FROM part""")
def inherited_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of parts up to the top of a tree of three levels, and a property by its super-property."""
    part = table(spark, sf_dir, "part")
    top = F.split("p_type", " ")[0]
    given = triples(part, name("part", "p_partkey"), "type", name("class", "p_type")).unionByName(triples(part, name("class", "p_type"), "subClassOf", top).distinct())
    given = given.unionByName(triples(part.select(top.alias("t")).distinct(), F.col("t"), "subClassOf", F.lit("Thing")))
    given = given.unionByName(triples(part, name("part", "p_partkey"), "sized", F.lit("size"))).unionByName(spark.createDataFrame([("sized", "subPropertyOf", "has")], "s string, p string, o string"))
    return forward_chain(given, SCHEMA_RULES[:4]).select("s", "p", "o")


@query("E7 E8", """SELECT 'supplier/' || s_suppkey AS s, 'locatedIn' AS p, 'region/' || n_regionkey AS o FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'nation/' || s_nationkey, 'houses', 'supplier/' || s_suppkey FROM supplier UNION ALL SELECT 'region/' || n_regionkey, 'houses', 'supplier/' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION SELECT DISTINCT 'nation/' || b.n_nationkey, 'near', 'nation/' || a.n_nationkey FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1""")
def chains_and_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """locatedIn after isPartOf, its inverse, and a symmetric property."""
    q = quads(spark, sf_dir, {"supplier", "nation"}).where(F.col("p").isin("locatedIn", "isPartOf") & ~F.col("s").startswith("customer/")).select("s", "p", F.col("o_key").alias("o"))
    n = table(spark, sf_dir, "nation").where("n_nationkey < 24")
    given = q.unionByName(triples(n, name("nation", "n_nationkey"), "near", F.concat(F.lit("nation/"), F.col("n_nationkey") + 1)))
    given = given.unionByName(spark.createDataFrame([("locatedIn", "inverseOf", "houses"), ("near", "type", "SymmetricProperty")], "s string, p string, o string"))
    chain = Rule("located-chain", [("?x", "locatedIn", "?y"), ("?y", "isPartOf", "?z")], [("?x", "locatedIn", "?z")])
    return forward_chain(given, [*SCHEMA_RULES[6:8], chain]).select("s", "p", "o")


@query("E12 E14 E28", """SELECT 'supplier/' || l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09 INTERSECT SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_acctbal > 9000""")
def members_of_disjoint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that facts put into two classes declared to be disjoint."""
    line, s = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.09"), table(spark, sf_dir, "supplier").where("s_acctbal > 9000")
    types = triples(line, name("supplier", "l_suppkey"), "type", F.lit("Risky")).unionByName(triples(s, name("supplier", "s_suppkey"), "type", F.lit("Trusted"))).distinct()
    q = as_quads(types.unionByName(spark.createDataFrame([("Risky", "disjointWith", "Trusted")], "s string, p string, o string")))
    return ask(spark, q, "SELECT DISTINCT ?s WHERE { ?a :disjointWith ?b . ?s :type ?a . ?s :type ?b }")


@query("R5 R7 R13", """SELECT 'orders/' || o_orderkey AS x, 'LateOrder' AS o FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE epoch(d) - epoch(o_orderdate) > 100 * 86400
UNION ALL SELECT 'orders/' || o_orderkey, 'Recent' FROM orders WHERE epoch(TIMESTAMP '1998-08-01') - epoch(o_orderdate) <= 2592000 AND o_orderdate <= TIMESTAMP '1998-08-01'""")
def spans_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over spans in seconds; the present is a parameter."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    at = lambda c: F.unix_timestamp(c.cast("timestamp")).cast("string")
    given = triples(o, name("orders", "o_orderkey"), "orderedAt", at(F.col("o_orderdate")))
    given = given.unionByName(triples(line.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("d")), name("orders", "l_orderkey"), "shippedAt", at(F.col("d"))))
    now = 901929600  # 1998-08-01
    rules = [
        Rule("late", [("?x", "orderedAt", "?a"), ("?x", "shippedAt", "?b")], [("?x", "type", "LateOrder")], f"try_cast(b AS long) - try_cast(a AS long) > {100 * 86400}"),
        Rule("recent", [("?x", "orderedAt", "?a")], [("?x", "type", "Recent")], f"{now} - try_cast(a AS long) BETWEEN 0 AND 2592000"),
    ]
    return forward_chain(given, rules).select(F.col("s").alias("x"), "o")


@query("T2 T3", """WITH i AS (SELECT DISTINCT l_suppkey AS r, o_orderkey AS k, least(o_orderdate, l_shipdate) AS s, greatest(o_orderdate, l_shipdate) AS e FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate <> l_shipdate),
n AS (SELECT *, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM i WINDOW w AS (PARTITION BY r ORDER BY s, e, k))
SELECT CASE WHEN e < s2 THEN 'before' WHEN e = s2 THEN 'meets' WHEN s = s2 AND e = e2 THEN 'equal' WHEN s = s2 AND e < e2 THEN 'starts' WHEN s = s2 THEN 'started_by' WHEN e = e2 AND s > s2 THEN 'finishes' WHEN e = e2 THEN 'finished_by' WHEN s < s2 AND e > e2 THEN 'contains' ELSE 'overlaps' END AS relation, count(*) AS n FROM n WHERE s2 IS NOT NULL GROUP BY 1""")
def relations_of_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation of each interval of a supplier to the next one."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).where("o_orderdate <> l_shipdate")
    i = j.select(F.col("l_suppkey").alias("r"), F.col("o_orderkey").alias("k"), F.least("o_orderdate", "l_shipdate").alias("s"), F.greatest("o_orderdate", "l_shipdate").alias("e")).distinct()
    w = Window.partitionBy("r").orderBy("s", "e", "k")
    n = i.withColumns({"s2": F.lead("s").over(w), "e2": F.lead("e").over(w)}).where("s2 IS NOT NULL")
    return n.select(temporal.allen(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")).alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


@query("SH13 SH14 SH22", """SELECT 'customer/' || c_custkey AS focus, 'phoneNote' AS slot FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'customer/' || c_custkey, 'reviewer' FROM customer WHERE c_custkey % 6 = 0""")
def slots_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer must fill two slots; what is missing is told one by one."""
    c, me = table(spark, sf_dir, "customer"), name("customer", "c_custkey")
    facts = triples(c, me, "type", F.lit("Customer")).unionByName(triples(c.where("c_custkey % 4 <> 0"), me, "phoneNote", F.lit("x"))).unionByName(triples(c.where("c_custkey % 6 <> 0"), me, "reviewer", F.lit("y")))
    return validate(as_quads(facts), [Shape("Claim", "Customer", [Constraint("", "required", ["phoneNote", "reviewer"])])]).select("focus", F.col("value").alias("slot"))


@query("SO5 M19 C3", """WITH a AS (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_name END AS v FROM part WHERE p_partkey % 3 <> 0)
SELECT 'part' AS category, coalesce(a.k, b.k) AS asset, CASE WHEN a.k IS NULL THEN 'add' WHEN b.k IS NULL THEN 'remove' ELSE 'replace' END AS operation FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""")
def diff_of_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.lit("part").alias("category"), F.col("p_partkey").alias("asset"), "p_name", "p_brand")
    old = part.where("asset % 5 <> 0").select("category", "asset", F.sha2("p_name", 256).alias("sha"))
    new = part.where("asset % 3 <> 0").select("category", "asset", F.sha2(F.when(F.col("asset") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_name")), 256).alias("sha"))
    return governance.semantic_diff(old, new, ["category", "asset"])


@query("C9 C12 M23", """SELECT 'c' || o_orderkey AS candidate, 3 AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'broken chain' ELSE 'skipped state' END AS fault FROM orders WHERE o_orderkey % 6 IN (0, 1, 3)""")
def faults_of_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events for every candidate, with a wrong hash or a skipped state in some."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_orderkey").alias("candidate"), "o_orderkey")
    e = governance.chained(o.select("candidate", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"))).join(o, "candidate")
    bad = (F.col("o_orderkey") % 3 == 0) & (F.col("seq") == 3)
    skipped = (F.col("o_orderkey") % 6 == 1) & (F.col("seq") == 3)
    return governance.chain_faults(e.withColumns({"prev_sha": F.when(bad, "x").otherwise(F.col("prev_sha")), "state": F.when(skipped, "promoted").otherwise(F.col("state"))}))


@query("ER5 ER7", """SELECT part AS s, arg_max(v, (trust, ts, v)) AS value, count(DISTINCT v) > 1 AS many FROM (SELECT 'part/' || l_partkey AS part, l_suppkey AS v, l_linenumber AS trust, l_shipdate AS ts FROM lineitem) GROUP BY part""")
def most_trusted_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of conflicting values that of the most trusted source, then the most recent one."""
    f = table(spark, sf_dir, "lineitem").select(name("part", "l_partkey").alias("s"), F.col("l_suppkey").alias("v"), F.col("l_linenumber").alias("trust"), F.col("l_shipdate").alias("ts"))
    return f.groupBy("s").agg(F.max_by("v", F.struct("trust", "ts", "v")).alias("value"), (F.count_distinct("v") > 1).alias("many"))


@query("V8 V9", """WITH e AS (SELECT o_custkey AS g, 1 + o_orderkey % 3 AS s, 1 + o_orderkey % 4 AS e, 1 + o_orderkey % 3 AS c FROM orders) SELECT 'goal/' || g AS goal, ['QM', 'A', 'B', 'C', 'D'][1 + max(greatest(s + e + c - 6, 0))] AS level FROM e GROUP BY g""")
def level_of_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an event, looked up in the table of 36 cells; a goal has the highest level of its events."""
    from .domain_queries import asil_table

    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(name("goal", "o_custkey").alias("goal"), (1 + k % 3).cast("int").alias("s"), (1 + k % 4).cast("int").alias("e"), (1 + k % 3).cast("int").alias("c"))
    return e.join(asil_table(spark), ["s", "e", "c"]).groupBy("goal").agg(F.max_by("level", "rank").alias("level"))


@query("J18 J20 M26", """SELECT 'unknown reference' AS fault, 'O' || o_orderkey AS id, 'C' || (o_custkey + 100000000) AS ref FROM orders WHERE o_orderkey % 11 = 0""")
def references_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id lists of a register; some name a customer that isn't there."""
    from ..sources import integrity

    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("id"), F.concat(F.lit("C"), "o_custkey", F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("; C"), F.col("o_custkey") + 100000000)).otherwise("")).alias("refs"))
    return integrity.register_faults(o, "id", "refs", table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id")))


@query("P4", """WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.5 ELSE 0 END AS a, CASE WHEN o_totalprice > 200000 THEN 0.7 ELSE 0 END AS b, CASE WHEN o_orderstatus = 'P' THEN -0.4 ELSE 0 END AS c FROM orders)
SELECT k, CAST(round(exp(a + b + c) / (1 + exp(a + b + c)), 6) AS DECIMAL(8,6)) AS p FROM f""")
def weighted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with weights for an order to need a check: a world weighs e to the sum of what holds in it, and the chance is its share of both worlds."""
    weights = {"o_orderpriority = '1-URGENT'": 1.5, "o_totalprice > 200000": 0.7, "o_orderstatus = 'P'": -0.4}
    total = F.lit(0.0)
    for body, w in weights.items():
        total = total + F.when(F.expr(body), w).otherwise(0.0)
    world = F.exp(total)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(world / (1 + world), 6).cast("decimal(8,6)").alias("p"))
