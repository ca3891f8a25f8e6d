"""Queries over whole tables for sources, scopes, lifecycles, lookups, identity and retrieval."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance, paths, retrieval
from ..registry import query
from ..sources import integrity
from ..sources.mapping import quads, table


@query("SC4", "SELECT doc_id, text FROM documents")
def lenient_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no UTF-8 are passed over: texts come back from bytes with such ones added."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    bad = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.unhex(F.lit("C3")), F.encode("t", "UTF-8"), F.unhex(F.lit("FF80")))).otherwise(F.encode("t", "UTF-8"))
    return integrity.decoded(d.select("doc_id", bad.alias("content")), "content").select("doc_id", "text")


@query("SC6 SC7", "SELECT scope, count(*) AS n FROM (SELECT unnest(CASE WHEN l.doc_id IS NULL THEN ['archive', 'all'] ELSE ['book', 'all'] END) AS scope FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id) GROUP BY scope")
def scope_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope is what is locked, all that isn't, or everything."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    lock = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("path")).distinct()
    out = None
    for name in ("book", "archive", "all"):
        part = integrity.scoped(files, lock, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SO4", "SELECT doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS sha256 FROM documents WHERE doc_id % 2 = 0 OR lang <> 'en'")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formal files with their hash and optional ones without: one row for each path, with the hash where one has it."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "lang", F.sha2("text", 256).alias("sha256"))
    formal = d.where("path % 2 = 0").select("path", "sha256")
    optional = d.where("lang <> 'en'").select("path", F.lit(None).cast("string").alias("sha256"))
    return integrity.union_by_path(formal, optional)


@query("SC10 C28", "SELECT 'unknown reference' AS fault, 'C' || c_custkey AS id, 'N' || (c_nationkey + 20) AS ref FROM customer WHERE c_nationkey + 20 > 24")
def register_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register as CSV lines with quoted cells and id lists; references to ids that the other register lacks."""
    lines = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey", F.lit(',"'), F.replace("c_name", F.lit("#"), F.lit('""')), F.lit('","N'), "c_nationkey", F.lit("; N"), F.col("c_nationkey") + 20, F.lit('"')).alias("value"))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"))
    return integrity.register_faults(integrity.csv_rows(lines, ["id", "name", "refs"]), "id", "refs", known)


@query("C10 C9 C12 C13", """WITH e AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 3 ELSE 5 END AS n, o_orderkey % 7 = 0 AS stale FROM orders)
SELECT 'c' || k AS candidate, n + 1 AS seq, CASE n WHEN 1 THEN 'proposed' WHEN 3 THEN 'regression_passed' ELSE 'promoted' END AS state FROM e WHERE NOT (stale AND n = 5)""")
def lifecycle_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's next state: a promotion only if the baseline is still the one that it was made from."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_orderkey").alias("candidate"), F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 3).otherwise(5).alias("n"), (F.pmod("o_orderkey", F.lit(7)) == 0).alias("stale"))
    events = governance.chained(o.select("candidate", F.explode(F.sequence(F.lit(1), "n")).alias("seq")))
    baselines = o.select("candidate", F.lit("v1").alias("made_from"), F.when(F.col("stale"), "v2").otherwise("v1").alias("current"))
    new = governance.advance(events, baselines)
    return new.select("candidate", "seq", "state")


@query("C11", "SELECT 'c' || o_orderkey AS candidate, CASE WHEN o_orderkey % 5 = 0 THEN 'run again' ELSE 'resume' END AS verdict FROM orders WHERE o_orderstatus = 'O'")
def resume_from_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate whose regression passed goes on from its receipt if the receipt's hashes are those of now."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("c"), "o_orderkey").alias("candidate"), "o_orderkey", F.sha2(F.col("o_totalprice").cast("string"), 256).alias("input_sha"))
    events = governance.chained(o.select("candidate", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("seq")))
    receipts = o.select("candidate", F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "other").otherwise(F.col("input_sha")).alias("receipt_sha"))
    return governance.resumable(events, receipts, o.select("candidate", "input_sha"))


@query("V21 V22", """SELECT 'n' || n_nationkey AS asked, n_name AS found FROM nation UNION ALL SELECT n_name, 'n' || n_nationkey FROM nation UNION ALL SELECT 'p' || p_partkey, p_brand FROM part""")
def term_and_proposition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by id and by name, and propositions by id to the chapter that has them."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("name"))
    known = n.select(F.col("id").alias("asked"), F.col("name").alias("found")).unionByName(n.select(F.col("name").alias("asked"), F.col("id").alias("found"))).unionByName(p.select(F.col("id").alias("asked"), F.col("name").alias("found")))
    asked = known.select("asked").distinct()
    return asked.join(known, "asked")


@query("E11", """WITH m AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
SELECT 'supplier/' || s_suppkey AS s, 'locatedIn' AS p, 'nation/' || b AS o FROM supplier JOIN m ON a = s_nationkey UNION SELECT 'nation/' || b, 'label', n_name FROM nation JOIN m ON a = n_nationkey UNION SELECT 'nation/' || b, 'isPartOf', 'region/' || n_regionkey FROM nation JOIN m ON a = n_nationkey""")
def same_as_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region are the same: each has the assertions of all, as subject and as object."""
    n = table(spark, sf_dir, "nation")
    links = n.select(F.concat(F.lit("nation/"), F.min("n_nationkey").over(_region())).alias("src"), F.concat(F.lit("nation/"), "n_nationkey").alias("dst"))
    q = quads(spark, sf_dir, {"supplier", "nation"}).where("p = 'locatedIn' OR (s LIKE 'nation/%' AND p IN ('label', 'isPartOf'))")
    return governance.propagated(q.select("s", "p", F.col("o_lex").alias("o")), links)


def _region():
    from pyspark.sql import Window

    return Window.partitionBy("n_regionkey")


@query("ER1", """WITH m AS (SELECT s_suppkey AS k, 'SUPPLIER ' || CAST(s_suppkey AS VARCHAR) AS norm FROM supplier)
SELECT k AS mention, CASE WHEN k % 3 = 2 THEN 'house' ELSE 'supplier/' || k END AS entity FROM m""")
def alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names written in other ways are put into one form, then looked up among names and aliases."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    written = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("  supplier#"), F.lpad(k.cast("string"), 9, "0"))).when(F.pmod(k, F.lit(3)) == 1, F.concat(F.lit("SUPPLIER-no. "), k)).otherwise(F.concat(F.lit("The Supplier House ("), F.pmod(k, F.lit(3)), F.lit(")")))
    mentions = s.select(k.alias("mention"), written.alias("name"))
    names = s.select(F.concat(F.lit("supplier/"), k).alias("entity"), F.col("s_name").alias("alias"))
    aliases = names.unionByName(spark.createDataFrame([("house", "the supplier house 2")], "entity string, alias string"))
    return retrieval.alias_matches(mentions, aliases).select("mention", "entity")


@query("G1 G2 A20 SK6", """WITH e AS (SELECT 'supplier/' || s_suppkey AS a, 'nation/' || s_nationkey AS b, 0.9 AS prior FROM supplier UNION ALL SELECT DISTINCT 'supplier/' || l_suppkey, 'part/' || l_partkey, 0.5 FROM lineitem),
b AS (SELECT a AS s, b AS o, prior FROM e UNION ALL SELECT b, a, prior FROM e), d AS (SELECT s, count(*) AS n FROM b GROUP BY s),
h1 AS (SELECT o AS node, max(prior) AS w FROM b WHERE s = 'part/1' GROUP BY o), h2 AS (SELECT o AS node, max(w * prior) AS w FROM h1 JOIN b ON b.s = h1.node WHERE o <> 'part/1' AND o NOT IN (SELECT node FROM h1) GROUP BY o),
f AS (SELECT *, 1 AS hops FROM h1 UNION ALL SELECT *, 2 FROM h2), r AS (SELECT node, hops, CAST(round(w * CASE WHEN node LIKE 'nation/%' THEN 1.0 ELSE 0.5 END / (1 + ln(n)), 6) AS DECIMAL(10,6)) AS score FROM f JOIN d ON d.s = node)
SELECT node, hops, score, 'part/1 reaches ' || node || ' in ' || hops AS sentence FROM r ORDER BY score DESC, node LIMIT 20""")
def expand_and_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty nodes around a part, by the prior of the edges on the way, relevance and
    a damping of hubs, as sentences."""
    q = quads(spark, sf_dir, {"supplier", "lineitem"}).where(F.col("p").isin("canProvide", "locatedIn") & F.col("s").startswith("supplier/"))
    e = q.select(F.col("s").alias("src"), F.col("o_key").alias("dst"), F.when(F.col("p") == "locatedIn", 0.9).otherwise(0.5).alias("prior"))
    relevance = F.when(F.col("node").startswith("nation/"), 1.0).otherwise(0.5)
    found = retrieval.expanded(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "prior")), "part/1", 2)
    best = found.select("node", "hops", F.round(F.col("weight") * relevance / (1 + F.log("degree")), 6).cast("decimal(10,6)").alias("score")).orderBy(F.desc("score"), "node").limit(20)
    return best.withColumn("sentence", F.concat(F.lit("part/1 reaches "), "node", F.lit(" in "), "hops"))


@query("J23", "SELECT s AS strategy, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25) AS n FROM (VALUES ('merge'), ('shuffle_hash'), ('broadcast')) v(s)")
def join_strategies_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One join by sort and merge, by hash after a shuffle, and by broadcast of the side that is small by its size here."""
    line, part = table(spark, sf_dir, "lineitem").select("l_partkey"), table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey")
    out = None
    for name in ("merge", "shuffle_hash", "broadcast"):
        side = part if name == "broadcast" else part.hint(name)  # AQE broadcasts by itself where the size allows it
        n = line.join(side, F.col("l_partkey") == F.col("p_partkey")).agg(F.count("*").alias("n")).select(F.lit(name).alias("strategy"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("UD1", "SELECT c_custkey AS k, reverse(c_name) AS name FROM customer")
def function_of_the_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised function of the user, called by name in SQL."""

    def turned(names: pd.Series) -> pd.Series:
        return names.str[::-1]

    spark.udf.register("turned", F.pandas_udf(turned, "string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr("turned(c_name)").alias("name"))


@query("PP12", "SELECT DISTINCT 'supplier/' || s_suppkey AS s, 'Region' AS o FROM supplier UNION ALL SELECT 'nation/' || n_nationkey, 'Region' FROM nation")
def inherited_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only class membership is inherited by a path; here the type of what a chain of places ends at."""
    q = quads(spark, sf_dir, {"supplier", "nation", "region"})
    edges = q.where(F.col("p").isin("locatedIn", "isPartOf")).select(F.col("s").alias("src"), F.col("o_key").alias("dst"))
    reach = paths.one_or_more(edges)
    kinds = q.where("p = 'type' AND o_key = 'Region'").select(F.col("s").alias("dst"), F.col("o_key").alias("o"))
    return reach.join(kinds, "dst").select(F.col("src").alias("s"), "o")
