"""Named domain queries over small fixtures: lookups, ledgers, traces and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import paths
from ..plans.compile import ask
from ..registry import query
from ..sources.mapping import quads_from_rows, table

LEVELS = ["QM", "A", "B", "C", "D"]


def asil_table(spark: SparkSession) -> DataFrame:
    """The 36 cells by their rule: with severity s of 3, exposure e of 4 and control c of 3,
    the sum tells the level, QM up to 6, then A, B, C, and D at 10."""
    sum_ = F.col("s") + F.col("e") + F.col("c")
    cells = spark.range(36).select((F.floor(F.col("id") / 12) + 1).cast("int").alias("s"), (F.floor(F.col("id") / 3) % 4 + 1).cast("int").alias("e"), (F.col("id") % 3 + 1).cast("int").alias("c"))
    return cells.select("s", "e", "c", F.greatest(sum_ - 6, F.lit(0)).alias("rank"), F.array(*[F.lit(x) for x in LEVELS])[F.greatest(sum_ - 6, F.lit(0))].alias("level"))


_ASIL = "SELECT s, e, c, CASE greatest(s + e + c - 6, 0) WHEN 0 THEN 'QM' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'D' END AS level, greatest(s + e + c - 6, 0) AS rank FROM range(1, 4) a(s), range(1, 5) b(e), range(1, 4) d(c)"


@query("V8", f"SELECT level, count(*) AS cells FROM ({_ASIL}) GROUP BY level")
def asil_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asil_table(spark).groupBy("level").agg(F.count("*").alias("cells"))


@query("V9", "SELECT * FROM (VALUES ('g1', 'D'), ('g2', 'A')) v(goal, level)")
def asil_goal_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.createDataFrame([("g1", 3, 4, 3), ("g1", 1, 1, 1), ("g2", 2, 3, 2), ("g2", 1, 2, 2)], "goal string, s int, e int, c int")
    return events.join(F.broadcast(asil_table(spark)), ["s", "e", "c"]).groupBy("goal").agg(F.max_by("level", "rank").alias("level"))


@query("V32", "SELECT * FROM (VALUES ('QM', 'QM'), ('A', 'QM'), ('B', 'A'), ('C', 'B'), ('D', 'C')) v(msil, asil)")
def msil_to_asil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motorcycle class is one level stricter than what it maps to."""
    rows = spark.createDataFrame(list(enumerate(LEVELS)), "rank int, msil string")
    return rows.select("msil", F.array(*[F.lit(x) for x in LEVELS])[F.greatest(F.col("rank") - 1, F.lit(0))].alias("asil"))


@query("V13 A13", "SELECT * FROM (VALUES ('before', CAST(95.00 AS DECIMAL(5,2)), CAST(94.74 AS DECIMAL(5,2)))) v(state, spfm, lfm)")
def metric_spfm_lfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 - (single + residual) / total, and 1 - latent / (total - single - residual)."""
    led = spark.createDataFrame([("before", "e1", 400, 2, 18, 20)], "state string, element string, total int, single int, residual int, latent int")
    t = led.groupBy("state").agg(*[F.sum(c).cast("decimal(18,6)").alias(c) for c in ("total", "single", "residual", "latent")])
    spf = F.col("single") + F.col("residual")
    return t.select("state", F.round(100 * (1 - spf / F.col("total")), 2).cast("decimal(5,2)").alias("spfm"), F.round(100 * (1 - F.col("latent") / (F.col("total") - spf)), 2).cast("decimal(5,2)").alias("lfm"))


@query("V35", "SELECT * FROM (VALUES (20, 150, 50, false), (40, 210, -10, true)) v(period, used, margin, over)")
def time_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([(20,), (40,)], "period int")
    used = 3 * F.col("period") + 90
    return p.select("period", used.alias("used"), (200 - used).alias("margin"), (used > 200).alias("over"))


@query("V11", "SELECT * FROM (VALUES ('b1', 'known', 150), ('b2', 'Unknown', NULL), ('b3', 'Pending', NULL)) v(budget, state, total)")
def budget_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown part makes the sum unknown, never zero."""
    s = spark.createDataFrame([("b1", "known", 60), ("b1", "known", 90), ("b2", "known", 60), ("b2", "Unknown", None), ("b3", "Pending", None), ("b3", "known", 1)], "budget string, state string, ms int")
    g = s.groupBy("budget").agg(F.sum("ms").cast("int").alias("t"), F.bool_or(F.col("state") == "Unknown").alias("u"), F.bool_or(F.col("state") == "Pending").alias("p"))
    return g.select("budget", F.when(F.col("u"), "Unknown").when(F.col("p"), "Pending").otherwise("known").alias("state"), F.when(~F.col("u") & ~F.col("p"), F.col("t")).alias("total"))


def trace_graph(spark: SparkSession, full: bool = True, allocated: bool = True, direct: bool = True) -> DataFrame:
    rows = [("goal", "type", "SafetyGoal"), ("goal", "inScope", "yes"), ("goal", "level", "D"), ("event", "leadsTo", "goal"), ("fsr", "type", "FSR"), ("tsr", "type", "TSR"), ("ssr", "type", "SSR"), ("TSR", "subClassOf", "Requirement"), ("SSR", "subClassOf", "Requirement"), ("FSR", "subClassOf", "Requirement")]
    rows += [("fsr", "derivedFrom", "goal")] if direct else []
    rows += [("tsr", "derivedFrom", "fsr"), ("ssr", "derivedFrom", "tsr")] if full else [("ssr", "derivedFrom", "fsr")]
    rows += [("ssr", "allocatedTo", "unit")] if allocated else []
    return quads_from_rows(spark, rows)


@query("V23", "SELECT 'event' AS e, 'goal' AS g, 'fsr' AS f, 'tsr' AS t, 'ssr' AS s, 'unit' AS u")
def trace_closed_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(spark, trace_graph(spark), "SELECT ?e ?g ?f ?t ?s ?u WHERE { ?e :leadsTo ?g . ?f :derivedFrom ?g ; a <FSR> . ?t :derivedFrom ?f ; a <TSR> . ?s :derivedFrom ?t ; a <SSR> . ?s :allocatedTo ?u } ORDER BY ?e")


@query("V24 V25 V26 V31", "SELECT * FROM (VALUES ('full', 'passed', true, 1), ('skipped layer', 'passed', true, 0), ('not allocated', 'failed', true, 0), ('no direct', 'failed', false, 0)) v(state, gate, direct, traces)")
def gate_truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate, the shape and the trace on four states of one graph."""
    out = None
    for name, q in (("full", trace_graph(spark)), ("skipped layer", trace_graph(spark, full=False)), ("not allocated", trace_graph(spark, allocated=False)), ("no direct", trace_graph(spark, direct=False))):
        edge = lambda p, q=q: q.where(F.col("p") == p).select(F.col("s").alias("src"), F.col("o_key").alias("dst"))
        below = paths.one_or_more(edge("derivedFrom")).join(edge("allocatedTo").select("src"), "src", "left_semi")
        kinds = edge("type").join(edge("subClassOf").where("dst = 'Requirement'").select(F.col("src").alias("dst")), "dst", "left_semi")
        held = below.join(kinds.select("src"), "src", "left_semi").select(F.col("dst").alias("s")).distinct()
        goals = q.where("p = 'inScope'").select("s")
        failed = goals.join(held, "s", "left_anti").agg(F.count("*").alias("f"))
        direct = edge("derivedFrom").where("dst = 'goal' AND src = 'fsr'").agg((F.count("*") > 0).alias("direct"))
        traces = ask(spark, q, "SELECT ?e WHERE { ?e :leadsTo ?g . ?f :derivedFrom ?g ; a <FSR> . ?t :derivedFrom ?f ; a <TSR> . ?s :derivedFrom ?t ; a <SSR> ; :allocatedTo ?u }").agg(F.count("*").cast("int").alias("traces"))
        row = failed.crossJoin(direct).crossJoin(traces).select(F.lit(name).alias("state"), F.when(F.col("f") > 0, "failed").otherwise("passed").alias("gate"), "direct", "traces")
        out = row if out is None else out.unionByName(row)
    return out


@query("V27 V28", "SELECT * FROM (VALUES ('AEB', 2, 3), ('BMS', 2, 2), ('EPS', 6, 6)) v(item, allocated, requirements)")
def allocated_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, f"{i}-r{k}", k <= a) for i, n, a in (("AEB", 3, 2), ("BMS", 2, 2), ("EPS", 6, 6)) for k in range(1, n + 1)]
    r = spark.createDataFrame(rows, "item string, req string, allocated boolean")
    return r.groupBy("item").agg(F.count_distinct(F.when(F.col("allocated"), F.col("req"))).cast("int").alias("allocated"), F.count("*").cast("int").alias("requirements"))


@query("V29", "SELECT * FROM (VALUES ('AEB'), ('EPS')) v(item)")
def asil_d_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads_from_rows(spark, [("AEB", "owns", "g1"), ("EPS", "owns", "g2"), ("BMS", "owns", "g3"), ("g1", "level", "D"), ("g2", "level", "D"), ("g3", "level", "C")])
    return ask(spark, q, "SELECT DISTINCT ?item WHERE { ?item :owns ?g . ?g :level <D> }")


@query("V33 J3", "SELECT * FROM (VALUES ('f1', 'm1', 'v1'), ('f2', 'm2', NULL), ('f3', NULL, NULL)) v(f, m, v)")
def nested_optional_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads_from_rows(spark, [(f, "type", "Finding") for f in ("f1", "f2", "f3")] + [("f1", "measure", "m1"), ("f2", "measure", "m2"), ("m1", "verifiedBy", "v1")])
    return ask(spark, q, "SELECT ?f ?m ?v WHERE { ?f :type <Finding> OPTIONAL { ?f :measure ?m OPTIONAL { ?m :verifiedBy ?v } } }")


@query("V30", "SELECT 'r' AS row, 'done' AS a, 'open' AS b, 'open' AS c")
def status_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads_from_rows(spark, [("r", "a", "done"), ("r", "b", "open"), ("r", "c", "open")])
    return ask(spark, q, "SELECT ?row ?a ?b ?c WHERE { ?row :a ?a ; :b ?b ; :c ?c }")


@query("V14 J17 M13", "SELECT * FROM (VALUES ('chg1', 'sw', 'pass1'), ('chg1', 'sw', 'pass3')) v(change, dim, pass)")
def reopen_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame([("chg1", "sw", "1.0", "1.1")], "change string, dim string, old string, new string")
    b = spark.createDataFrame([("pass1", "sw", "1.0"), ("pass2", "sw", "1.1"), ("pass3", "sw", "1.0"), ("pass1", "hw", "A")], "pass string, dim string, value string")
    return c.join(b, "dim").where("old = value").select("change", "dim", "pass")


@query("V3 J16 ER6", "SELECT 'a1' AS x, 'a2' AS y, 'u1' AS entity")
def alias_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.createDataFrame([("a1", "u1", "plate"), ("a2", "u1", "scan"), ("a3", "u2", "plate")], "alias string, entity string, evidence string")
    return a.select(F.col("alias").alias("x"), "entity").join(a.select(F.col("alias").alias("y"), "entity"), "entity").where("x < y").select("x", "y", "entity")


@query("V4 V5", "SELECT * FROM (VALUES ('r1', 'same team'), ('r2', 'author'), ('r3', 'same line')) v(reviewer, reason)")
def reviewer_too_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads_from_rows(spark, [("d", "author", "p"), ("d", "reviewer", "r1"), ("p", "team", "t"), ("r1", "team", "t"), ("e", "reviewer", "r2"), ("e", "author", "r2"), ("g", "author", "s"), ("g", "reviewer", "r3"), ("s", "reportsTo", "r3")])
    return ask(spark, q, """SELECT ?reviewer ?reason WHERE { { ?x :author ?p . ?x :reviewer ?reviewer . ?p :team ?t . ?reviewer :team ?t BIND("same team" AS ?reason) }
        UNION { ?x :reviewer ?reviewer . ?x :author ?reviewer BIND("author" AS ?reason) } UNION { ?x :author ?p . ?x :reviewer ?reviewer . ?p :reportsTo ?reviewer BIND("same line" AS ?reason) } }""")


@query("V6 V10 V19", "SELECT * FROM (VALUES ('q1', 'why1', 'p1')) v(req, why, param)")
def affected_by_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads_from_rows(spark, [("q1", "restsOn", "why1"), ("why1", "uses", "p1"), ("q2", "restsOn", "why2"), ("why2", "uses", "p2")])
    return ask(spark, q, "SELECT ?req ?why ?param WHERE { ?req :restsOn ?why . ?why :uses ?param FILTER(?param = <p1>) }")


@query("V20 V34", "SELECT * FROM (VALUES ('1a', 'C', '++'), ('1a', 'D', '++'), ('1b', 'C', '+'), ('1b', 'D', 'o')) v(row, level, symbol)")
def method_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([("1a", "o", "+", "++", "++"), ("1b", "o", "o", "+", "o")], "row string, A string, B string, C string, D string")
    return t.unpivot(["row"], ["A", "B", "C", "D"], "level", "symbol").where("level IN ('C', 'D')").orderBy("row", "level")


@query("G7 G11", "SELECT * FROM (VALUES (1, 'ok'), (2, 'state machine'), (3, 'unknown entity'), (4, 'unknown action')) v(id, verdict)")
def action_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing check: vocabulary, entity, then the state machine."""
    p = spark.createDataFrame([(1, "setStatus", "d1", "Maintenance"), (2, "setStatus", "d2", "Running"), (3, "setStatus", "d9", "Idle"), (4, "explode", "d1", "x")], "id int, action string, target string, value string")
    e = spark.createDataFrame([("d1", "Running"), ("d2", "Fault")], "target string, state string")
    ok = spark.createDataFrame([("Running", "Maintenance"), ("Fault", "Maintenance"), ("Maintenance", "Running")], "state string, value string")
    a = spark.createDataFrame([("setStatus",)], "action string")
    j = p.join(a.withColumn("known", F.lit(True)), "action", "left").join(e, "target", "left").join(ok.withColumn("legal", F.lit(True)), ["state", "value"], "left")
    return j.select("id", F.when(F.col("known").isNull(), "unknown action").when(F.col("state").isNull(), "unknown entity").when(F.col("legal").isNull(), "state machine").otherwise("ok").alias("verdict"))


@query("ER2 ER3", """WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, CAST(round(0.3 * (1 - levenshtein(a.s_name, b.s_name) / CAST(greatest(length(a.s_name), length(b.s_name)) AS DOUBLE)) + 0.4 * CASE WHEN abs(a.s_acctbal - b.s_acctbal) < 500 THEN 1 ELSE 0 END + 0.3, 4) AS DECIMAL(6,4)) AS sim
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) SELECT a, b, sim, CASE WHEN sim >= 0.90 THEN 'merge' ELSE 'review' END AS verdict FROM p WHERE sim >= 0.70""")
def er_weighted_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one nation by 0.3 name, 0.4 balance and 0.3 place; two thresholds.  A pair
    whose balances differ by 500 or more has 0.6 at most: only pairs in one band of balances,
    or in neighbouring ones, are compared, and none that would pass is lost."""
    s = table(spark, sf_dir, "supplier").withColumn("band", F.floor(F.col("s_acctbal") / 500))
    side = lambda x, *more: s.select(F.col("s_suppkey").alias(x), F.col("s_name").alias(f"{x}n"), F.col("s_acctbal").alias(f"{x}b"), "s_nationkey", *more)
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    j = side("a", "band").join(side("b", near), ["s_nationkey", "band"]).where("a < b AND abs(ab - bb) < 500")
    name = 1 - F.levenshtein("an", "bn") / F.greatest(F.length("an"), F.length("bn"))
    j = j.select("a", "b", F.round(0.3 * name + 0.4 + 0.3, 4).cast("decimal(6,4)").alias("sim"))
    return j.where("sim >= 0.70").withColumn("verdict", F.when(F.col("sim") >= F.lit("0.90").cast("decimal(6,4)"), "merge").otherwise("review"))


@query("ER3", "SELECT CAST(0.88 AS DECIMAL(4,2)) AS sim, 'review' AS verdict")
def er_worked_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([("0.6", "1.0", "1.0")], "n string, a string, r string")
    d = lambda c: F.col(c).cast("decimal(4,2)")
    sim = (F.lit("0.3").cast("decimal(4,2)") * d("n") + F.lit("0.4").cast("decimal(4,2)") * d("a") + F.lit("0.3").cast("decimal(4,2)") * d("r")).cast("decimal(4,2)")
    return p.select(sim.alias("sim")).withColumn("verdict", F.when(F.col("sim") >= 0.90, "merge").when(F.col("sim") >= 0.70, "review").otherwise("different"))


@query("ER5 ER7", "SELECT * FROM (VALUES ('e1', 'power', '22', false), ('e1', 'stop', 'on', true)) v(s, p, value, human)")
def conflict_source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The more trusted source, then the more recent; safety-critical fields go to a person."""
    f = spark.createDataFrame([("e1", "power", "22", "plm", 3, 1), ("e1", "power", "20", "sheet", 1, 9), ("e1", "stop", "on", "plm", 3, 1), ("e1", "stop", "off", "plm", 3, 0)], "s string, p string, value string, source string, trust int, ts int")
    best = f.groupBy("s", "p").agg(F.max_by("value", F.struct("trust", "ts", "value")).alias("value"), (F.count_distinct("value") > 1).alias("many"))
    return best.select("s", "p", "value", (F.col("many") & F.col("p").isin("stop")).alias("human"))


@query("G8", "SELECT * FROM (VALUES ('lathe 1', 'e1', false), ('mill', 'e2', true)) v(mention, entity, ask_back)")
def entity_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate; a small gap to the next asks back."""
    c = spark.createDataFrame([("lathe 1", "e1", 0.9), ("lathe 1", "e2", 0.4), ("mill", "e2", 0.8), ("mill", "e3", 0.79)], "mention string, entity string, score double")
    g = c.groupBy("mention").agg(F.reverse(F.sort_array(F.collect_list(F.struct("score", "entity")))).alias("x"))
    return g.select("mention", F.col("x")[0]["entity"].alias("entity"), ((F.size("x") > 1) & (F.col("x")[0]["score"] - F.try_element_at("x", F.lit(2))["score"] < 0.05)).alias("ask_back"))


@query("M15 M16", "SELECT * FROM (VALUES ('15.5kW', CAST(15.5 AS DECIMAL(18,6))), ('15500W', CAST(15.5 AS DECIMAL(18,6))), ('n/a', NULL)) v(raw, kw)")
def unit_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("15.5kW",), ("15500W",), ("n/a",)], "raw string").select("raw", scalars.kilowatts(F.col("raw")).alias("kw"))


@query("M12", "SELECT * FROM (VALUES ('2026/3/21', DATE '2026-03-21'), ('26年3月21日', DATE '2026-03-21'), ('x', NULL)) v(raw, d)")
def date_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("2026/3/21",), ("26年3月21日",), ("x",)], "raw string").select("raw", scalars.any_date(F.col("raw")).alias("d"))
