"""Catalogs of packages: discovery, migrations, baselines, receipts of learning, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import SCHEMA_RULES, forward_chain
from ..plans.compile import ask
from ..registry import query
from ..sources.mapping import quads, table


@query("SC21 C33 M18", "SELECT * FROM (VALUES ('p1', '2', 3), ('p2', '1', 1)) v(package, version, assets)")
def discover_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of every package with the number of its assets, by name."""
    p = spark.createDataFrame([("p2", "1"), ("p1", "1"), ("p1", "2")], "package string, version string")
    a = spark.createDataFrame([("p1", "2", "x"), ("p1", "2", "y"), ("p1", "2", "z"), ("p1", "1", "x"), ("p2", "1", "x")], "package string, version string, asset string")
    new = p.groupBy("package").agg(F.max("version").alias("version"))
    return new.join(a, ["package", "version"], "left").groupBy("package", "version").agg(F.count("asset").cast("int").alias("assets")).orderBy("package")


@query("C30", "SELECT * FROM (VALUES ('old/a', 'new/a1'), ('old/a', 'new/a2'), ('old/b', 'new/b')) v(old, new)")
def migration_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All successors of a path: more than one stays more than one."""
    m = spark.createDataFrame([("old/a", "new/a1"), ("old/a", "new/a2"), ("old/b", "new/b"), ("old/c", "new/c")], "old string, new string")
    return spark.createDataFrame([("old/a",), ("old/b",), ("old/z",)], "old string").join(m, "old").select("old", "new")


@query("C13", "SELECT * FROM (VALUES ('t1', 'current'), ('t2', 'stale')) v(task, baseline)")
def stale_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("t1", "p", "d2"), ("t2", "p", "d1")], "task string, package string, digest string")
    now = spark.createDataFrame([("p", "d2")], "package string, now string")
    return t.join(now, "package").select("task", F.when(F.col("digest") == F.col("now"), "current").otherwise("stale").alias("baseline"))


@query("C14", "SELECT 'b1' AS binding, '2' AS version, 'd2' AS digest, 'd1' AS predecessor, false AS applied")
def successor_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binding that a promotion would lead to: a projection, applied by nobody here."""
    b = spark.createDataFrame([("b1", "p", "1", "d1")], "binding string, package string, version string, digest string")
    p = spark.createDataFrame([("p", "2", "d2")], "package string, new_version string, new_digest string")
    return b.join(p, "package").select("binding", F.col("new_version").alias("version"), F.col("new_digest").alias("digest"), F.col("digest").alias("predecessor"), F.lit(False).alias("applied"))


@query("C31", "SELECT * FROM (VALUES ('e1', 'candidate'), ('e2', 'no_delta')) v(engagement, learning)")
def learning_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame([("e1", 2), ("e2", 0)], "engagement string, operations int")
    return e.select("engagement", F.when(F.col("operations") > 0, "candidate").otherwise("no_delta").alias("learning"))


@query("C34", "SELECT 'src/core.py' AS path")
def source_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed paths below none of the allowed roots."""
    changed = spark.createDataFrame([("src/core.py",), ("dist/a.whl",), ("docs/x/y.md",)], "path string")
    roots = spark.createDataFrame([("dist",), ("docs/x",)], "root string")
    return changed.join(F.broadcast(roots), F.col("path").startswith(F.concat("root", F.lit("/"))), "left_anti")


@query("C6 J21", "SELECT * FROM (VALUES ('replay', 'missing'), ('telepathy', 'unexpected')) v(capability, state)")
def capability_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract compared with what is found; any difference closes the gate."""
    want = spark.createDataFrame([("query",), ("replay",)], "capability string").withColumn("w", F.lit(True))
    have = spark.createDataFrame([("query",), ("telepathy",)], "capability string").withColumn("h", F.lit(True))
    return want.join(have, "capability", "full_outer").select("capability", F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "unexpected").alias("state")).where("state IS NOT NULL")


@query("C22", "SELECT * FROM (VALUES ('c1', 'rebind'), ('c3', 'source lost')) v(chapter, action)")
def rebind_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.createDataFrame([("c1", "a.md", "1"), ("c2", "b.md", "2"), ("c3", "z.md", "3")], "chapter string, path string, sha string")
    f = spark.createDataFrame([("a.md", "9"), ("b.md", "2")], "path string, now string")
    action = F.when(F.col("now").isNull(), "source lost").when(F.col("now") != F.col("sha"), "rebind")
    return m.join(f, "path", "left").select("chapter", action.alias("action")).where("action IS NOT NULL")


@query("C17 C24", "SELECT * FROM (VALUES ('p1', true), ('p2', false)) v(package, released)")
def release_after_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released only if every regression and every release check passed."""
    c = spark.createDataFrame([("p1", "regression", True), ("p1", "release", True), ("p2", "regression", False), ("p2", "release", True)], "package string, stage string, ok boolean")
    return c.groupBy("package").agg(F.bool_and("ok").alias("released"))


@query("A21", "SELECT c_custkey AS k FROM customer ORDER BY sha256(CAST(c_custkey AS VARCHAR) || ':7'), c_custkey LIMIT 200")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 rows by a seeded hash: the sample is the feature."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return c.orderBy(F.sha2(F.concat(F.col("k").cast("string"), F.lit(":7")), 256), "k").limit(200)


@query("A19", "SELECT abs(count(DISTINCT l_partkey) - count(DISTINCT l_partkey)) = 0 AS near FROM lineitem")
def sketch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch's count of parts lies within five per cent of the exact one."""
    t = table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.01).alias("a"), F.count_distinct("l_partkey").alias("n"))
    return t.select((F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("near"))


@query("E31 E20", "SELECT 'part/' || p_partkey AS x FROM part WHERE p_size > 48")
def query_over_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over given and derived facts together: large parts are parts by inheritance."""
    part = table(spark, sf_dir, "part").where("p_size > 48").select(F.concat(F.lit("part/"), "p_partkey").alias("s"), F.lit("type").alias("p"), F.concat(F.lit("class/"), "p_type").alias("o"))
    tree = table(spark, sf_dir, "part").select(F.concat(F.lit("class/"), "p_type").alias("s"), F.lit("subClassOf").alias("p"), F.lit("Part").alias("o")).distinct()
    given = part.unionByName(tree)
    every = given.unionByName(forward_chain(given, SCHEMA_RULES[:2]).select("s", "p", "o"))
    return every.where("p = 'type' AND o = 'Part'").select(F.col("s").alias("x"))


@query("GP16 GP20", "SELECT 'nation/' || n_nationkey AS n FROM nation WHERE n_regionkey = 2")
def prefixed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, quads(spark, sf_dir, {"nation"}), "PREFIX r: <region/> SELECT ?n WHERE { ?n :isPartOf r:2 }")


@query("ST4", "SELECT 'part/new' AS s, 'needs' AS p, 'Crate' AS o")
def incremental_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over a batch of additions: only what the additions give is derived."""
    from ..operators.rules import Rule, fire

    rules = [Rule("crate", [("?x", "type", "Large")], [("?x", "needs", "Crate")])]
    base = spark.createDataFrame([("part/old", "type", "Large"), ("part/old", "needs", "Crate")], "s string, p string, o string")
    new = spark.createDataFrame([("part/new", "type", "Large")], "s string, p string, o string")
    return fire(rules[0], base.unionByName(new), new, base).select("s", "p", "o").join(base, ["s", "p", "o"], "left_anti")
