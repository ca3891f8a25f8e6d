"""Plans, parser, paths, rules, temporal relations, sources and streams."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphspark.operators import governance, paths, temporal
from graphspark.operators.rules import SCHEMA_RULES, Rule, forward_chain
from graphspark.operators.shapes import Constraint, Shape, validate
from graphspark.plans.algebra import QueryError
from graphspark.plans.compile import ask
from graphspark.plans.gate import check
from graphspark.plans.text import parse
from graphspark.sources import graphtext, integrity
from graphspark.sources.mapping import quads, quads_from_rows

from .conftest import DATA


@pytest.mark.parametrize("text", ["INSERT DATA { <a> :p <b> }", "SELECT ?x WHERE { ?x :p", "SELECT ?x WHERE { ?x nope:p ?y }", "DROP GRAPH <g>", "SELECT ?x WHERE { SERVICE <s> { ?x :p ?y } }"])
def test_refused(text):
    with pytest.raises(QueryError):
        parse(text)


def test_product_is_refused(spark):
    with pytest.raises(QueryError):
        ask(spark, quads_from_rows(spark, [("a", "p", "b")]), "SELECT * WHERE { ?a :p ?b . ?c :p ?d }")


def test_ungrouped_variable_is_refused(spark):
    with pytest.raises(QueryError):
        ask(spark, quads_from_rows(spark, [("a", "p", "b")]), "SELECT ?a (COUNT(?b) AS ?n) WHERE { ?a :p ?b } GROUP BY ?b")


def test_gate_limits_rows():
    verdict, _, query = check("SELECT ?s WHERE { ?s :label ?l } LIMIT 5000", {"label"})
    assert verdict == "ok" and query.limit == 1000


def test_pattern_reads_one_table_and_few_columns(spark):
    df = ask(spark, quads(spark, DATA), "SELECT ?p ?z WHERE { ?p :size ?z FILTER(?z > 40) }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "p_retailprice" not in plan and "PushedFilters: [IsNotNull(p_size)" in plan


def asked(spark, rows, text):
    return sorted((tuple(r) for r in ask(spark, quads_from_rows(spark, rows), text).collect()), key=str)


VALUES = [("a", "v", 1), ("b", "v", 2), ("c", "v", 3)]
PLACES = [("a", "kind", "T"), ("b", "kind", "T"), ("a", "has", "x1"), ("x1", "place", "p1")]
SIZES = [("a", "p", "b"), ("b", "size", 7), ("b", "size", 3), ("b", "d", ("x", "de")), ("b", "sub", "c")]


@pytest.mark.parametrize(
    ("rows", "text", "want"),
    [
        # filters of EXISTS over outer variables
        (VALUES, "SELECT ?x WHERE { ?x :v ?n FILTER NOT EXISTS { ?y :v ?m FILTER(?m > ?n) } }", [("c",)]),
        (VALUES, "SELECT ?x WHERE { ?x :v ?n FILTER EXISTS { ?y :v ?m FILTER(?m > ?n) } }", [("a",), ("b",)]),
        (VALUES, "SELECT ?x WHERE { ?x :v ?n FILTER EXISTS { ?x :v ?m FILTER(?m > ?n) } }", []),
        # a variable left unbound agrees with any value
        (PLACES, "SELECT ?s ?x WHERE { ?s :kind <T> OPTIONAL { ?s :has ?x } FILTER EXISTS { ?x :place ?p } }", [("a", "x1"), ("b", None)]),
        (PLACES, "SELECT ?s ?x WHERE { ?s :kind <T> OPTIONAL { ?s :has ?x } FILTER NOT EXISTS { ?x :place ?p } }", []),
        (PLACES, "SELECT ?s ?x WHERE { ?s :kind <T> OPTIONAL { ?s :has ?x } MINUS { ?x :place ?p } }", [("b", None)]),
        ([*PLACES, ("x2", "place", "p2")], "SELECT ?s ?x ?p WHERE { ?s :kind <T> OPTIONAL { ?s :has ?x } OPTIONAL { ?x :place ?p } }", [("a", "x1", "p1"), ("b", "x1", "p1"), ("b", "x2", "p2")]),
        # ends of paths keep number and language
        (SIZES, "SELECT ?a ?z WHERE { ?a :p/:size ?z FILTER(?z > 5) }", [("a", "7")]),
        (SIZES, "SELECT (SUM(?z) AS ?k) WHERE { ?a :p/:size ?z }", [(10,)]),
        (SIZES, 'SELECT ?z WHERE { ?a :p/:d ?z FILTER(lang(?z) = "de") }', [("x",)]),
        # paths of no edge: constants, and every node of the graph
        (SIZES, "SELECT ?x WHERE { ?x :sub* <zz> }", [("zz",)]),
        (SIZES, "SELECT ?x WHERE { <q> :sub? ?x }", [("q",)]),
        (SIZES, "SELECT ?x WHERE { ?x :sub* <c> }", [("b",), ("c",)]),
        (SIZES, "SELECT ?x ?y WHERE { ?x :sub* ?y FILTER(isIRI(?x)) }", [("a", "a"), ("b", "b"), ("b", "c"), ("c", "c")]),
        (SIZES, "SELECT ?x ?y WHERE { ?x :p ?w . ?w :sub* ?y }", [("a", "b"), ("a", "c")]),
        (SIZES, "SELECT ?y WHERE { <a> :p/:sub* ?y }", [("b",), ("c",)]),
        (SIZES, "SELECT ?x WHERE { ?x :p/:sub* <c> }", [("a",)]),
        (SIZES, "SELECT ?x WHERE { ?x (:p|:sub)+ <c> }", [("a",), ("b",)]),
        (SIZES, "SELECT ?x ?y WHERE { ?x ^(:p/:sub) ?y }", [("c", "a")]),
    ],
)
def test_worked_examples(spark, rows, text, want):
    assert asked(spark, rows, text) == want


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { ?x :v ?n FILTER(?zz > 2) }", "SELECT ?x WHERE { ?x :v ?n FILTER EXISTS { ?y :v ?m FILTER EXISTS { ?z :v ?k FILTER(?k > ?n) } } }", "SELECT ?x WHERE { GRAPH ?g { ?x :v+ ?n } }"])
def test_unknown_variables_are_refused(spark, text):
    with pytest.raises(QueryError):
        asked(spark, VALUES, text)


def test_constant_subject_reaches_the_scan(spark):
    df = ask(spark, quads(spark, DATA), "SELECT ?o WHERE { ?o :hasPart <part/1> }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(l_partkey,1)" in plan
    assert plan.index("HashAggregate") < plan.index("Filter") < plan.index("FileScan")


def test_a_seeded_closure_stays_small(spark):
    e = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(40)], "src string, dst string")
    assert paths.one_or_more(e, spark.createDataFrame([("n30",)], "src string")).count() == 10


def test_not_exists_and_minus_differ(spark):
    q = quads_from_rows(spark, [("a", "p", "b"), ("x", "q", "y")])
    assert ask(spark, q, "SELECT ?a WHERE { ?a :p ?b MINUS { ?c :q ?d } }").count() == 1
    assert ask(spark, q, "SELECT ?a WHERE { ?a :p ?b FILTER NOT EXISTS { ?c :q ?d } }").count() == 0


def test_closure_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    once = paths.one_or_more(e)
    assert once.count() == 12
    assert paths.one_or_more(once).exceptAll(once).isEmpty()


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 30) if k != 15], "src long, dst long")
    got = {r.node: r.root for r in paths.components(e).collect()}
    assert got == {k: 1 if k <= 15 else 16 for k in range(1, 31)}


@settings(max_examples=200, deadline=None)
@given(st.tuples(*[st.integers(0, 6)] * 4))
def test_thirteen_relations(p):
    s1, e1, s2, e2 = p
    if s1 >= e1 or s2 >= e2:
        return
    held = {
        "before": e1 < s2, "meets": e1 == s2, "overlaps": s1 < s2 < e1 < e2, "starts": s1 == s2 and e1 < e2, "during": s2 < s1 and e1 < e2,
        "finishes": e1 == e2 and s1 > s2, "equal": (s1, e1) == (s2, e2), "finished_by": e1 == e2 and s1 < s2, "contains": s1 < s2 and e1 > e2,
        "started_by": s1 == s2 and e1 > e2, "overlapped_by": s2 < s1 < e2 < e1, "met_by": s1 == e2, "after": s1 > e2,
    }
    assert sum(held.values()) == 1
    name = next(k for k, v in held.items() if v)
    assert (name in temporal.INTERIOR) == (s1 < e2 and e1 > s2)


def test_overlaps_against_all_pairs(spark):
    rows = [(k, k % 3, f"2026-01-{1 + k % 20:02d} 00:00:00", f"2026-01-{2 + k % 20 + k % 4:02d} 00:00:00") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, r int, start string, end string").withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})
    got = {(r.a, r.b) for r in temporal.overlapping(df, "r", 86400).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and a[3] > b[2]}
    assert got == want


def test_rules_are_idempotent(spark):
    f = spark.createDataFrame([("A", "subClassOf", "B"), ("B", "subClassOf", "C"), ("x", "type", "A")], "s string, p string, o string")
    new = forward_chain(f, SCHEMA_RULES[:2]).select("s", "p", "o")
    assert forward_chain(f.unionByName(new), SCHEMA_RULES[:2]).isEmpty()


def test_stratified_negation(spark):
    f = spark.createDataFrame([("a", "is", "m"), ("b", "is", "m"), ("b", "has", "fault")], "s string, p string, o string")
    rule = Rule("free", [("?x", "is", "m")], [("?x", "state", "free")], never=[("?x", "has", "fault")])
    assert [r.s for r in forward_chain(f, [rule]).collect()] == ["a"]


def test_no_violation(spark):
    q = quads_from_rows(spark, [("e", "type", "E"), ("e", "n", 5)])
    assert validate(q, [Shape("S", "E", [Constraint("n", "minCount", 1), Constraint("n", "datatype", "xsd:integer"), Constraint("n", "maxInclusive", 9)])]).isEmpty()


def test_lines_with_faults_fail(spark):
    with pytest.raises(Exception, match="not a statement"):
        graphtext.parse_lines(spark.createDataFrame([("nonsense",)], "value string")).collect()


def test_literals_round_trip(spark):
    q = quads_from_rows(spark, [("a", "n", ('say "hi" \\ there', None)), ("a", "l", ("x", "de")), ("a", "z", 4)])
    again = graphtext.parse_lines(graphtext.to_lines(q))
    assert again.select("s", "p", "o_key").exceptAll(q.select("s", "p", "o_key")).isEmpty() and again.count() == 3


def test_bound_content_fails_on_another_hash(spark, tmp_path):
    (tmp_path / "a.md").write_text("text")
    files = integrity.scan_files(spark, str(tmp_path), [".md"])
    lock = files.select("path", F.lit("0" * 64).alias("sha"))
    with pytest.raises(Exception, match="hash differs"):
        integrity.bound_content(files, lock).collect()
    assert integrity.bound_content(files, files.select("path", F.col("sha256").alias("sha"))).count() == 1


def test_receipt_tells_a_change(spark):
    a, b = spark.range(5), spark.range(6)
    assert governance.receipt(a).first() != governance.receipt(b).first()


def test_streaming_counts_equal_batch(spark, tmp_path):
    from graphspark.streaming.events import window_counts

    batch = spark.read.parquet(f"{DATA}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = window_counts(stream, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = window_counts(batch, "ts", ["event_type"])
    assert spark.table("counts").exceptAll(want).isEmpty() and spark.table("counts").count() == want.count()


def test_streaming_gate(spark, tmp_path):
    from graphspark.streaming.events import gate

    base = quads_from_rows(spark, [("a", "type", "E"), ("b", "type", "E"), ("a", "n", 1), ("b", "n", 2)])
    change = quads_from_rows(spark, [("a", "n", 50), ("c", "n", 3)]).withColumn("op", F.lit("insert"))
    seen = {}
    gate(lambda: base, [Shape("S", "E", [Constraint("n", "maxInclusive", 9)])], lambda df, e: seen.update(ok={r.s for r in df.collect()}), lambda df, e: seen.update(bad={r.s for r in df.collect()}))(change, 0)
    assert seen == {"ok": {"c"}, "bad": {"a"}}
