"""Sources with checks, versions, chains, authorisation and receipts."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import governance
from ..registry import query
from ..sources import graphtext, integrity
from ..sources.mapping import quads, quads_from_rows, table


@query("J18 J19 J20 M26", "SELECT * FROM (VALUES ('duplicate', 'P2', NULL), ('unknown reference', 'P1', 'S9')) v(fault, id, ref)")
def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = spark.createDataFrame([("P1", "S1; S9"), ("P2", "S1|S2"), ("P2", "S2")], "id string, sources string")
    return integrity.register_faults(reg, "id", "sources", spark.createDataFrame([("S1",), ("S2",)], "id string"))


@query("C12 C9 M23", "SELECT * FROM (VALUES ('c2', 2, 'skipped state'), ('c3', 2, 'broken chain')) v(candidate, seq, fault)")
def event_chain_unbroken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("c1", 1, None, "a", "candidate"), ("c1", 2, "a", "b", "proposed"), ("c1", 3, "b", "c", "committed"), ("c2", 1, None, "d", "candidate"), ("c2", 2, "d", "e", "committed"), ("c3", 1, None, "f", "candidate"), ("c3", 2, "x", "g", "proposed")]
    return governance.chain_faults(spark.createDataFrame(rows, "candidate string, seq int, prev_sha string, sha string, state string"))


@query("SO6 C16", """SELECT * FROM (VALUES ('same rows in another order', true), ('a row more', false), ('a row twice for another', false)) v(compared, equal)""")
def oracle_multiset_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that hold the same rows as often, and two that nearly do."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.pmod("s_suppkey", F.lit(3)).alias("g"))
    first = s.orderBy("g", "s_nationkey").limit(1)
    rank = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("g"))
    cases = {
        "same rows in another order": s.repartition(3, "g").orderBy(F.desc("g")), "a row more": s.unionByName(first),
        "a row twice for another": s.withColumn("r", rank).withColumn("g", F.when((F.col("r") == 1) & (F.col("s_nationkey") == first.first()["s_nationkey"]), F.col("g") + 1).otherwise(F.col("g"))).drop("r"),
    }
    out = None
    for name, other in cases.items():
        row = governance.multiset_equal(s, other).select(F.lit(name).alias("compared"), "equal")
        out = row if out is None else out.unionByName(row)
    return out


@query("SO5 M19", "SELECT * FROM (VALUES ('shapes', 's1', 'replace'), ('rules', 'r1', 'remove'), ('rules', 'r2', 'add')) v(category, asset, operation)")
def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.createDataFrame([("shapes", "s1", "a"), ("rules", "r1", "b"), ("queries", "q1", "c")], "category string, asset string, sha string")
    new = spark.createDataFrame([("shapes", "s1", "z"), ("rules", "r2", "b"), ("queries", "q1", "c")], "category string, asset string, sha string")
    return governance.semantic_diff(old, new, ["category", "asset"])


@query("C15", "SELECT count(*) AS n, true AS same FROM nation")
def receipt_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt doesn't depend on the order of rows or on partitions."""
    n = table(spark, sf_dir, "nation")
    a, b = governance.receipt(n), governance.receipt(n.repartition(5).orderBy(F.desc("n_name")))
    return a.crossJoin(b.select(F.col("digest").alias("d2"))).select("n", (F.col("digest") == F.col("d2")).alias("same"))


@query("C7", "SELECT * FROM (VALUES ('propose'), ('run')) v(action)")
def authorised_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.createDataFrame([("run",), ("propose",), ("commit",)], "action string")
    return governance.allowed_actions(b, spark.createDataFrame([("run",), ("propose",), ("promote",)], "action string"))


@query("C1 C2 C3 M20 M21", "SELECT * FROM (VALUES ('b1', true, true, true), ('b2', false, true, true), ('b3', true, false, false)) v(id, keys_ok, digest_ok, under_root)")
def binding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact keys, a digest of 64 hexadecimal digits, and a source below its root."""
    d = "a" * 64
    rows = [("b1", f'{{"digest":"{d}","root":"urn:x","uri":"urn:x/1"}}'), ("b2", f'{{"digest":"{d}","root":"urn:x","uri":"urn:x","backend":1}}'), ("b3", '{"digest":"zz","root":"urn:x","uri":"urn:xy/1"}')]
    t = spark.createDataFrame(rows, "id string, j string")
    get = lambda k: F.get_json_object("j", f"$.{k}")
    return t.select("id", integrity.exact_keys(F.col("j"), ["digest", "root", "uri"]).alias("keys_ok"), get("digest").rlike("^[0-9a-f]{64}$").alias("digest_ok"), scalars.under_root(get("uri"), get("root")).alias("under_root"))


@query("C9", "SELECT * FROM (VALUES ('p1', true), ('p2', false)) v(package, valid_prefix)")
def lifecycle_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("p1", ["candidate", "proposed"]), ("p2", ["candidate", "committed"])], "package string, steps array<string>")
    return rows.select("package", scalars.ordered_prefix(F.col("steps"), F.array(*[F.lit(s) for s in governance.STATES])).alias("valid_prefix"))


@query("C18", "SELECT * FROM (VALUES ('license'), ('tests')) v(blocker)")
def release_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame([("a", "tests", False), ("b", "tests", False), ("a", "license", False), ("a", "privacy", True)], "package string, check string, ok boolean")
    return c.where("NOT ok").select(F.col("check").alias("blocker")).distinct().orderBy("blocker")


@query("SC3 SC7 J21 M27 C23 C38", "SELECT * FROM (VALUES ('a.md', 'changed'), ('b.md', 'missing'), ('c.md', 'unexpected')) v(path, state)")
def lock_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lock = integrity.parse_lock(spark.createDataFrame([("# lock",), ("0" * 64 + "  a.md",), ("1" * 64 + "  b.md",), ("2" * 64 + "  d.md",)], "value string"))
    files = spark.createDataFrame([("a.md", "f" * 64), ("c.md", "3" * 64), ("d.md", "2" * 64)], "path string, sha256 string")
    return integrity.check_lock(lock, files)


@query("SC3", "SELECT * FROM (VALUES ('../x', 'unsafe'), ('a', 'duplicate'), ('a', 'duplicate')) v(path, fault)")
def lock_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([("0" * 64 + "  ../x",), ("0" * 64 + "  a",), ("1" * 64 + "  a",), ("1" * 64 + "  ok",)], "value string")
    return integrity.parse_lock(lines).where("fault IS NOT NULL").select("path", "fault")


@query("SK3", "SELECT repeat('0', 64) || '  a' AS value UNION ALL SELECT repeat('1', 64) || '  b'")
def lock_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.render_lock(spark.createDataFrame([("b", "1" * 64), ("a", "0" * 64)], "path string, sha256 string"))


@query("SC9", "SELECT * FROM (VALUES (1, NULL), (2, 'duplicate key'), (3, 'constant'), (4, 'malformed')) v(id, fault)")
def strict_json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([('{"id":1}',), ('{"id":2,"id":2}',), ('{"id":3,"x":NaN}',), ('{"id":4',)], "value string")
    return integrity.strict_json(t).select(F.regexp_extract("value", r"(\d)", 1).cast("int").alias("id"), "fault")


@query("SC12 C19 UD3", "SELECT * FROM (VALUES ('x/a.txt', 3, sha256('abc')), ('x/b.txt', 0, sha256(''))) v(member, size, sha256)")
def zip_member_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("x/a.txt", "abc")
        z.writestr("x/b.txt", "")
    return integrity.zip_members(spark.createDataFrame([("w.whl", bytearray(raw.getvalue()))], "path string, content binary")).select("member", F.col("size").cast("int").alias("size"), "sha256")


@query("SC20", "SELECT doc_id, sha256(text) AS sha FROM documents")
def content_digest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.digest(F.col("text")).alias("sha"))


@query("SK1", """SELECT '{"a":2,"b":{"c":"x","d":1}}' AS j""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql("SELECT named_struct('b', named_struct('d', 1, 'c', 'x'), 'a', 2) AS v")
    return df.select(scalars.canonical_json(F.col("v"), df.schema["v"].dataType).alias("j"))


@query("SC14", """SELECT '<nation/' || n_nationkey || '> <label> "' || n_name || '" .' AS value FROM nation UNION ALL SELECT '<nation/' || n_nationkey || '> <isPartOf> <region/' || n_regionkey || '> .' FROM nation UNION ALL SELECT '<nation/' || n_nationkey || '> <type> <Nation> .' FROM nation""")
def graph_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads written as lines, read, and written again."""
    lines = graphtext.to_lines(quads(spark, sf_dir, {"nation"}))
    return graphtext.to_lines(graphtext.parse_lines(lines))


@query("U1 SC16 T6", "SELECT * FROM (VALUES ('e1', 'Idle'), ('e2', 'Running')) v(s, o)")
def graph_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads_from_rows(spark, [("e1", "status", "Running"), ("e2", "status", "Running")])
    change = quads_from_rows(spark, [("e1", "status", "Running")]).withColumn("op", F.lit("delete")).unionByName(quads_from_rows(spark, [("e1", "status", "Idle")]).withColumn("op", F.lit("insert")))
    return graphtext.patch(q, change).select("s", F.col("o_lex").alias("o"))


@query("SK6", """SELECT 'e1' AS s, 'e1 label Lathe; e1 status Idle.' AS sentence, '[{"p":"label","o":"Lathe"},{"p":"status","o":"Idle"}]' AS json""")
def subgraph_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphtext.forms(quads_from_rows(spark, [("e1", "status", "Idle"), ("e1", "label", ("Lathe", None))])).select("s", "sentence", "json")
