"""Property paths, closures and hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import paths
from ..plans.compile import ask
from ..registry import query
from ..sources.mapping import quads, quads_from_rows, table
from ..storage import stored


def precedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line n to line n + 1 of one order, over distinct (order, line)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    nxt = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"))
    name = lambda n: F.concat_ws("/", "l_orderkey", n)
    return lines.join(nxt, ["l_orderkey", "l_linenumber"]).select(name(F.col("l_linenumber")).alias("src"), name(F.col("l_linenumber") + 1).alias("dst"))


_LINES = "SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem"


@query("PP4 E5 E6", f"""WITH RECURSIVE l AS ({_LINES}), e AS (SELECT a.k, a.n AS a, b.n AS b FROM l a JOIN l b ON a.k = b.k AND b.n = a.n + 1),
c AS (SELECT k, a, b FROM e UNION SELECT c.k, c.a, e.b FROM c JOIN e ON c.k = e.k AND c.b = e.a)
SELECT k || '/' || a AS src, k || '/' || b AS dst FROM c""")
def path_plus_precedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.one_or_more(precedes(spark, sf_dir))


@query("PP5 PP7", "SELECT DISTINCT 'class/' || p_type AS x, 'Part' AS y FROM part UNION SELECT DISTINCT 'class/' || p_type, 'class/' || p_type FROM part")
def path_star_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of parts and all classes above them; the closure starts from the classes found."""
    return ask(spark, quads(spark, sf_dir, {"part"}), "SELECT DISTINCT ?x ?y WHERE { ?part :type ?x . ?x :subClassOf* ?y }")


@query("PP5", "SELECT DISTINCT 'class/' || p_type AS x FROM part UNION SELECT 'Part'")
def path_star_to_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All below a class, itself included; the closure starts from the constant end."""
    return ask(spark, quads(spark, sf_dir, {"part"}), "SELECT ?x WHERE { ?x :subClassOf* <Part> }")


@query("PP5 PP6", """WITH n AS (SELECT 'nation/' || n_nationkey AS x FROM nation UNION SELECT 'region/' || r_regionkey FROM region UNION SELECT n_name FROM nation UNION SELECT r_name FROM region UNION SELECT unnest(['Nation', 'Region']))
SELECT x, x AS y FROM n UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation""")
def path_no_edge_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With both ends free every node of the graph has a path of no edge to itself."""
    return ask(spark, quads(spark, sf_dir, {"nation", "region"}), "SELECT ?x ?y WHERE { ?x :isPartOf? ?y }")


@query("PP1 PP4", """SELECT 'supplier/' || s_suppkey AS s, CAST(sum(p_size) AS BIGINT) AS sizes FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey
JOIN part ON p_partkey = l_partkey WHERE p_size > 40 GROUP BY s_suppkey""")
def path_typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers at the end of a path are compared and summed as numbers."""
    out = ask(spark, quads(spark, sf_dir, {"supplier", "lineitem", "part"}), "SELECT ?s (SUM(?z) AS ?sizes) WHERE { ?s :canProvide/:size ?z FILTER(?z > 40) } GROUP BY ?s")
    return out.withColumn("sizes", F.col("sizes").cast("long"))


@query("PP6", "SELECT * FROM (VALUES ('a', 'a'), ('a', 'b'), ('b', 'b'), ('b', 'c'), ('c', 'c')) v(x, y)")
def path_zero_or_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, quads_from_rows(spark, [("a", "e", "b"), ("b", "e", "c")]), "SELECT ?x ?y WHERE { ?x :e? ?y }")


@query("PP1 PP3 J15", "SELECT 'region/' || n_regionkey AS r, 'supplier/' || s_suppkey AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def path_inverse_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, quads(spark, sf_dir, {"nation", "supplier"}), "SELECT ?r ?s WHERE { ?r ^:isPartOf/^:locatedIn ?s }")


@query("PP2", "SELECT 'supplier/' || s_suppkey AS x, 'nation/' || s_nationkey AS y FROM supplier UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation")
def path_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, quads(spark, sf_dir, {"nation", "supplier"}), "SELECT ?x ?y WHERE { ?x :locatedIn|:isPartOf ?y }")


@query("PP10 V15 J13", """WITH up AS (SELECT s_suppkey AS k, 'nation/' || s_nationkey AS n FROM supplier UNION ALL SELECT s_suppkey, 'region/' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT 'supplier/' || b.k AS s, b.n FROM up a JOIN up b ON a.n = b.n WHERE a.k = 1""")
def path_common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the way of any supplier upwards meets that of supplier 1."""
    return ask(spark, quads(spark, sf_dir, {"nation", "supplier"}), "SELECT ?s ?n WHERE { <supplier/1> (:locatedIn|:isPartOf)+ ?n . ?s (:locatedIn|:isPartOf)+ ?n . ?s :type <Supplier> }")


@query("PP8", "SELECT * FROM (VALUES ('a', 'b', 1, 'a>b'), ('a', 'c', 2, 'a>b>c'), ('a', 'd', 3, 'a>b>c>d')) v(src, dst, hops, way)")
def bounded_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e")], "src string, dst string")
    out = paths.hops(e, 3, spark.createDataFrame([("a",)], "src string"))
    return out.select("src", "dst", "hops", F.array_join("path", ">").alias("way"))


@query("PP9", """WITH e AS (SELECT DISTINCT 'supplier/' || l_suppkey AS src, 'part/' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier),
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), h1 AS (SELECT DISTINCT dst FROM b WHERE src = 'part/1'),
h2 AS (SELECT DISTINCT b.dst FROM h1 JOIN b ON b.src = h1.dst)
SELECT dst AS node, min(h) AS hops FROM (SELECT dst, 1 AS h FROM h1 UNION ALL SELECT dst, 2 FROM h2) WHERE dst <> 'part/1' GROUP BY dst""")
def khop_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops of a part, which the given SQL takes; ``khop_degree`` takes three."""
    return expand(neighbours(spark, sf_dir), "part/1", 2).select("node", "hops")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of suppliers over chosen predicates, both ways."""
    q = quads(spark, sf_dir, {"supplier", "lineitem"}).where(F.col("p").isin("canProvide", "locatedIn"))
    e = q.select(F.col("s").alias("src"), F.col("o_key").alias("dst")).where("src LIKE 'supplier/%'")
    return paths.alternative(e, paths.inverse(e))


def expand(both: DataFrame, anchor: str, most: int) -> DataFrame:
    """(node, hops, degree) of nodes within ``most`` hops; a node's degree counts its edges in
    the whole graph.  A round goes on only from nodes that are new."""
    both = stored(both.distinct(), "edges")
    seen = front = both.sparkSession.createDataFrame([(anchor, 0)], "node string, hops int")
    for k in range(1, most + 1):
        near = both.join(front, both.src == front.node).select(F.col("dst").alias("node")).distinct()
        front = stored(near.join(seen, "node", "left_anti").withColumn("hops", F.lit(k)), "front")
        seen = seen.unionByName(front)
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return seen.where(F.col("node") != anchor).join(degree, "node")


@query("PP9 A20", """WITH e AS (SELECT DISTINCT 'supplier/' || l_suppkey AS src, 'part/' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier),
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), d AS (SELECT src, count(*) AS degree FROM b GROUP BY src), h1 AS (SELECT DISTINCT dst FROM b WHERE src = 'part/1'),
h2 AS (SELECT DISTINCT b.dst FROM h1 JOIN b ON b.src = h1.dst), h3 AS (SELECT DISTINCT b.dst FROM h2 JOIN b ON b.src = h2.dst),
n AS (SELECT dst AS node, min(h) AS hops FROM (SELECT dst, 1 AS h FROM h1 UNION ALL SELECT dst, 2 FROM h2 UNION ALL SELECT dst, 3 FROM h3) WHERE dst <> 'part/1' GROUP BY dst)
SELECT node, hops, degree FROM n JOIN d ON d.src = n.node""")
def khop_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within three hops of a part over chosen predicates, both ways, and their degree."""
    return expand(neighbours(spark, sf_dir), "part/1", 3)


@query("PP11 V12", "SELECT * FROM (VALUES ('v1', true), ('v2', false), ('v3', true)) v(v, closed)")
def source_chain_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value is closed if every chain of sources ends in a measurement or a signed assumption."""
    e = spark.createDataFrame([("v1", "d1"), ("d1", "m1"), ("v2", "d2"), ("d2", "x1"), ("v2", "m1"), ("v3", "a1")], "src string, dst string")
    roots = spark.createDataFrame([("m1",), ("a1",)], "dst string")
    reach = paths.one_or_more(e)
    ends = reach.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")
    open_ = ends.join(roots, "dst", "left_anti").select(F.col("src").alias("v"), F.lit(False).alias("ok")).distinct()
    values = e.select(F.col("src").alias("v")).where("v LIKE 'v%'").distinct()
    return values.join(open_, "v", "left").select("v", F.coalesce("ok", F.lit(True)).alias("closed"))


@query("G9 TS16 E9", """SELECT 'n' || n_nationkey AS node, 'n' || min(n_nationkey) OVER (PARTITION BY n_regionkey) AS root FROM nation""")
def components_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-as links between nations of a region; each component takes its least member."""
    n = table(spark, sf_dir, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    links = n.select(F.col("n_nationkey").cast("long").alias("dst"), F.lag("n_nationkey").over(w).cast("long").alias("src")).where("src IS NOT NULL")
    found = paths.components(links)
    return found.select(F.concat(F.lit("n"), "node").alias("node"), F.concat(F.lit("n"), "root").alias("root"))


@query("G9", """WITH d AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT 'nation/' || k AS node, n AS degree FROM d""")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, quads(spark, sf_dir, {"supplier"}), "SELECT ?node (COUNT(?s) AS ?degree) WHERE { ?s :locatedIn ?node } GROUP BY ?node")
