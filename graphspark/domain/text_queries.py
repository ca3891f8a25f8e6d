"""Lexical search, grading, vectors, aggregates over text tables, events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grading
from ..registry import query
from ..sources.mapping import table

_QUERY = "the of"
_COUNT = "(length(t) - length(replace(t, '{w}', ''))) // {n}"


@query("TS1 TS2 O5", f"""SELECT doc_id, score FROM (SELECT doc_id, CAST(CASE WHEN contains(t, 'the of') THEN 31 ELSE 0 END + {_COUNT.format(w='the', n=3)} * 7 + {_COUNT.format(w='of', n=2)} * 6 AS BIGINT) AS score
FROM (SELECT doc_id, lower(text) AS t FROM documents)) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def search_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select("doc_id", T.score_text(F.col("text"), _QUERY).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


_HITS = "(length({c}) - length(replace({c}, '{w}', ''))) // {n}"
_PATH = " + ".join(f"{_HITS.format(c=c, w='en', n=2)} * 6 + {_HITS.format(c=c, w='example', n=7)} * 11 + CASE WHEN contains({c}, 'en example') THEN 35 ELSE 0 END" for c in "uv")


@query("TS3", f"SELECT page_id, score FROM (SELECT page_id, CAST(2 * ({_PATH}) AS BIGINT) AS score FROM (SELECT page_id, lower(url) AS u, replace(replace(lower(url), '_', ' '), '-', ' ') AS v FROM pages)) WHERE score > 0")
def search_score_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.score_path(F.col("url"), " En example ").alias("score")).where("score > 0")


def lines(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    out = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "line"))
    return out if first is None else out.where(F.col("n") < first)


_LINES = r"""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS n, unnest(l) AS line FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM
(SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents))"""


@query("TS4 SC5", f"""WITH l AS ({_LINES}), s AS (SELECT doc_id, n, CASE WHEN contains(t, 'the of') THEN 31 ELSE 0 END + {_COUNT.format(w='the', n=3)} * 7 + {_COUNT.format(w='of', n=2)} * 6 AS score FROM (SELECT doc_id, n, lower(line) AS t FROM l WHERE n < 200))
SELECT doc_id, n AS best FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) AS r FROM s) WHERE r = 1""")
def best_context_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of most score among the first 200, the earliest of equals."""
    scored = lines(spark, sf_dir, T.FIRST_LINES).select("doc_id", "n", T.score_text(F.col("line"), _QUERY).alias("score"))
    return scored.groupBy("doc_id").agg(F.max_by("n", F.struct("score", (-F.col("n")).alias("first"))).alias("best"))


def contexts(numbered: DataFrame) -> DataFrame:
    """Each line (doc_id, n, line) with the one before and the one after it."""
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(-1, 1)
    return numbered.select("doc_id", "n", F.array_join(F.collect_list("line").over(w), "|").alias("context"))


@query("TS5", f"""WITH l AS ({_LINES}) SELECT doc_id, n, string_agg(line, '|') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM l""")
def context_window_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(lines(spark, sf_dir))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """At most four hits of a document, none within two lines of one that is kept.  Greedy in
    the order of score and line.  A line that has four lines of more score that are more
    than two apart from one another can't be told by a window, so a document's hits are
    taken together: as arrays of (score, line), folded in the engine, no row to Python."""
    order = F.transform(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "n"))), lambda x: x["n"])
    empty = F.array().cast("array<int>")
    far = lambda kept, n: F.forall(kept, lambda m: F.abs(m - n) > T.NEAR_LINES)
    fold = F.aggregate("order", empty, lambda kept, n: F.when((F.size(kept) < T.MOST_HITS) & far(kept, n), F.array_append(kept, n)).otherwise(kept))
    kept = hits.groupBy("doc_id").agg(order.alias("order")).select(F.col("doc_id").alias("_d"), F.explode(fold).alias("_n"))
    return hits.join(kept, (F.col("doc_id") == F.col("_d")) & (F.col("n") == F.col("_n"))).drop("_d", "_n")


_SCORE = f"CASE WHEN contains(t, 'the of') THEN 31 ELSE 0 END + {_COUNT.format(w='the', n=3)} * 7 + {_COUNT.format(w='of', n=2)} * 6"


@query("TS6 TS7 UD2", f"""WITH RECURSIVE l AS ({_LINES}), s AS MATERIALIZED (SELECT doc_id, n, CAST({_SCORE} AS BIGINT) AS score FROM (SELECT doc_id, n, lower(line) AS t FROM l)),
o AS MATERIALIZED (SELECT doc_id, list(n ORDER BY score DESC, n) AS ns FROM s WHERE score > 0 GROUP BY doc_id),
r AS (SELECT doc_id, 1 AS k, ns, [ns[1]] AS kept FROM o UNION ALL SELECT doc_id, k + 1, ns, CASE WHEN len(kept) < 4 AND len(list_filter(kept, lambda m: abs(m - ns[k + 1]) <= 2)) = 0 THEN list_append(kept, ns[k + 1]) ELSE kept END FROM r WHERE k < len(ns) AND len(kept) < 4),
f AS (SELECT doc_id, kept FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1)
SELECT doc_id, n, score FROM s JOIN f USING (doc_id) WHERE list_contains(kept, n) ORDER BY score DESC, doc_id, n LIMIT 100""")
def search_dedupe_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lines(spark, sf_dir).select("doc_id", "n", T.score_text(F.col("line"), _QUERY).alias("score"))
    return dedupe_hits(scored.where("score > 0")).orderBy(F.desc("score"), "doc_id", "n").limit(100)


#: Questions of the replay, with a token, with text in quotes, and with a token twice.
_ASKED = {"q1": "Where is ththe-ing said?", "q2": 'Who writes “the and of” in which text?', "q3": "on on or"}
_REPLAY = {"q1": ["Where", "is", "ththe-ing", "said"], "q2": ["the", "and", "of"], "q3": ["on", "on", "or"]}


@query("TS8 TS9 O4 A12", "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{q}' AS q, doc_id, CAST(" + " + ".join(f"3 * ((length(text) - length(replace(text, '{w}', ''))) // {len(w)})" for w in words) + " AS BIGINT) AS score FROM documents" for q, words in _REPLAY.items()
) + ") SELECT q, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id DESC) AS r FROM s WHERE score > 0) WHERE r <= 5")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each question by its grams and tokens, ties by the larger name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    scores = F.array(*[F.struct(F.lit(k).alias("q"), T.replay_score(F.col("t"), q).alias("score")) for k, q in _ASKED.items()])
    each = docs.select("doc_id", F.explode(scores).alias("x")).select("doc_id", "x.*").where("score > 0")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("doc_id"))
    return each.withColumn("r", F.row_number().over(w)).where("r <= 5").select("q", "doc_id", "score")


def bank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document as the answer to an item of its own, in two files of which the last
    counts; golds are literals, patterns and macros by the item's kind."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    k, arr = F.pmod("doc_id", F.lit(5)), lambda *x: F.array(*map(F.lit, x))
    cat = F.when(k == 0, "trap").when(k == 1, "dry-methodcell").otherwise(F.concat(F.lit("prose-"), "lang"))
    fact = F.when(k == 0, arr("zzz")).when(k == 1, F.when(F.pmod("doc_id", F.lit(2)) == 0, arr("__PLUS__")).otherwise(arr("__OH__"))).when(k == 2, arr("the.*of", "der")).otherwise(arr("de la", "und"))
    case = F.when(k == 3, arr("que", "th.*er")).otherwise(F.array().cast("array<string>"))
    items = d.select(F.col("doc_id").alias("id"), cat.alias("cat"), F.concat(F.lit("question "), "doc_id").alias("q"), fact.alias("fact"), case.alias("case"))
    text = F.when(k == 1, F.concat(F.when(F.pmod("doc_id", F.lit(3)) == 0, "x + y ").when(F.pmod("doc_id", F.lit(3)) == 1, "x ++ y ").otherwise("x O y "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    last = d.where(F.pmod("doc_id", F.lit(7)) > 0).select(F.col("doc_id").alias("id"), F.lit("b").alias("file"), F.lit(1).alias("line"), text.alias("answer"))
    first = d.where(F.pmod("doc_id", F.lit(7)) < 6).select(F.col("doc_id").alias("id"), F.lit("a").alias("file"), F.lit(2).alias("line"), F.lit("the zzz of").alias("answer"))
    return items, first.unionByName(last)


_GRADED = """WITH d AS (SELECT doc_id AS id, doc_id % 5 AS k, lang, CASE WHEN doc_id % 7 = 0 THEN 'the zzz of' WHEN doc_id % 5 = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'x + y ' WHEN 1 THEN 'x ++ y ' ELSE 'x O y ' END || coalesce(text, '') ELSE coalesce(text, '') END AS a FROM documents),
g AS (SELECT id, k, CASE k WHEN 0 THEN 'trap' WHEN 1 THEN 'dry-methodcell' ELSE 'prose-' || lang END AS cat, a, length(a) > 0 AS answered,
    length(a) > 0 AND CASE k WHEN 0 THEN contains(a, 'zzz') WHEN 1 THEN a LIKE 'x %' AND CASE id % 2 WHEN 0 THEN id % 3 = 0 ELSE id % 3 = 2 END WHEN 2 THEN regexp_matches(a, 'the.*of') OR contains(a, 'der') ELSE contains(a, 'de la') OR contains(a, 'und') END AS fact_ok,
    length(a) > 0 AND k = 3 AND (contains(a, 'que') OR regexp_matches(a, 'th.*er')) AS case_ok FROM d)"""


@query("TS10 TS11 TS12 TS13 A8 A9 A10 SC8", _GRADED + """, s AS (SELECT cat, count(*) AS n, count(*) FILTER (WHERE answered) AS answered, count(*) FILTER (WHERE fact_ok) AS fact, CASE WHEN bool_or(k = 3) THEN count(*) FILTER (WHERE case_ok) END AS case_,
    CASE WHEN bool_or(k = 3) THEN count(*) FILTER (WHERE fact_ok AND case_ok) END AS both_ FROM g GROUP BY cat)
SELECT * FROM s UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT), CAST(sum(answered) AS BIGINT), CAST(sum(fact) AS BIGINT), CAST(coalesce(sum(case_), 0) AS BIGINT), CAST(coalesce(sum(both_), 0) AS BIGINT) FROM s""")
def grade_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, cases and both by category, with a total."""
    return grading.report(grading.graded(*bank(spark, sf_dir)))


@query("TS10 TS13", _GRADED + """ SELECT id, CASE k WHEN 0 THEN 'trap-fabricated' ELSE 'fact' END AS kind, 'question ' || id AS question, left(a, 60) AS answer FROM g WHERE answered AND NOT fact_ok""")
def grade_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.failures(grading.graded(*bank(spark, sf_dir)))


@query("TS14 A11", "SELECT * FROM (VALUES ('q1', true), ('q2', false)) v(id, passed)")
def retrieval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame([("q1", 2, ["a.md"], ["gate"]), ("q2", 1, ["b.md"], ["shape"])], "id string, min_hits int, any_path array<string>, terms array<string>")
    h = spark.createDataFrame([("q1", "a.md", "a gate opens"), ("q1", "c.md", "x"), ("q2", "a.md", "shape")], "id string, path string, line string")
    g = h.groupBy("id").agg(F.count("*").alias("n"), F.collect_set("path").alias("paths"), F.array_join(F.collect_list("line"), "\n").alias("blob"))
    return c.join(g, "id", "left").select("id", ((F.col("n") >= F.col("min_hits")) & F.arrays_overlap("any_path", "paths") & F.forall("terms", lambda t: F.contains(F.col("blob"), t))).alias("passed"))


#: Vectors in a block of queries and in a block of those searched.
ASKED, SEARCHED = 512, 8192


def nearest(vectors: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """(q, vec_id, sim): the k exact cosine neighbours, of other ids, of each row of ``asked``;
    ties by the smaller id.  Both are (vec_id, embedding).  Each block of queries meets each
    block of vectors once and leaves k rows a query there.  A null or zero vector has none."""
    usable = lambda df: df.where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull()))
    vectors, asked = usable(vectors.select("vec_id", "embedding")), usable(asked.select("vec_id", "embedding"))
    blocks, groups = (max(1, -(-df.count() // n)) for df, n in ((vectors, SEARCHED), (asked, ASKED)))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = asked.select(part(groups).alias("g"), all_of(blocks).alias("b"), "vec_id", "embedding")
    right = vectors.select(all_of(groups).alias("g"), part(blocks).alias("b"), "vec_id", "embedding")

    def best(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(asked) and len(found):
            found = found.sort_values("vec_id")
            ids, unit = found["vec_id"].to_numpy(), np.stack(found["embedding"].to_list()).astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            for q, e in zip(asked["vec_id"], asked["embedding"], strict=True):
                x = np.asarray(e, np.float64)
                sim = unit @ x / np.linalg.norm(x)
                points = (np.sign(sim) * np.floor(np.abs(sim) * 1e5 + 0.5)).astype(np.int64)
                other = np.flatnonzero(ids != q)
                # rows lie by id, so that a stable sort leaves ties to the smaller one
                if len(other) > k:
                    least = np.partition(points[other], -k)[-k]
                    other = other[points[other] >= least]
                take = other[np.argsort(-points[other], kind="stable")[:k]]
                out.append(pd.DataFrame({"q": q, "vec_id": ids[take], "points": points[take]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "vec_id": [], "points": []}, dtype=np.int64)

    kind = vectors.schema["vec_id"].dataType.simpleString()
    partial = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInPandas(best, f"q {kind}, vec_id {kind}, points long")
    w = Window.partitionBy("q").orderBy(F.desc("points"), "vec_id")
    sim = (F.col("points") / F.lit(100000)).cast("decimal(8,5)")
    return partial.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "vec_id", sim.alias("sim"))


@query("TS15", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings),
s AS (SELECT q.vec_id AS q, v.vec_id, CAST(round(list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i])) / (q.n * v.n), 5) AS DECIMAL(8,5)) AS sim FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT q, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM s) WHERE r <= 3""")
def vector_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 100, among all vectors."""
    v = table(spark, sf_dir, "embeddings")
    return nearest(v, v.where("vec_id % 100 = 0"))


@query("A8 A9 A18", "SELECT coalesce(lang, 'total') AS lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def rollup_category_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return j.rollup("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good")).select(F.coalesce("lang", F.lit("total")).alias("lang"), "n", "good")


@query("A14 A15 G10", """SELECT lang, CAST(round(sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) / CAST(greatest(sum(toxic), 1) AS DOUBLE), 6) AS DECIMAL(8,6)) AS precision_, CAST(round(sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) / CAST(greatest(sum(1 - quality), 1) AS DOUBLE), 6) AS DECIMAL(8,6)) AS recall_
FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def precision_recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    both = F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0))
    return j.groupBy("lang").agg(F.round(both / F.greatest(F.sum("toxic"), F.lit(1)), 6).cast("decimal(8,6)").alias("precision_"), F.round(both / F.greatest(F.sum(1 - F.col("quality")), F.lit(1)), 6).cast("decimal(8,6)").alias("recall_"))


@query("A17", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 1")
def most_frequent_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(1)


@query("A16 ST1 ST5", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("O6", "SELECT * FROM (VALUES ('t1', 0.9), ('t2', 0.8), ('t4', 0.1)) v(t, score)")
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest score first while the cost fits; what doesn't fit is passed over."""
    t = spark.createDataFrame([("g", "t1", 0.9, 40), ("g", "t2", 0.8, 50), ("g", "t3", 0.5, 30), ("g", "t4", 0.1, 10)], "g string, t string, score double, cost int")

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        left, taken = 100, []
        for r in rows.sort_values(["score", "t"], ascending=[False, True]).itertuples():
            if r.cost <= left:
                left -= r.cost
                taken.append(r.t)
        return rows[rows["t"].isin(taken)]

    return t.groupBy("g").applyInPandas(keep, t.schema).select("t", F.col("score").cast("decimal(2,1)").alias("score"))


@query("SC17", r"SELECT doc_id, mail FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+')) AS mail FROM documents)")
def extract_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mail address of every text, as often as it is found."""
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+)"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("mail"))


@query("M28", r"""WITH r AS (SELECT * FROM (VALUES ('mail', '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+'), ('address', '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b'), ('key', '(?i)(api[_-]?key|secret|token|password)')) v(rule, pattern)),
l AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS n, unnest(x) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\n') AS x FROM documents))
SELECT DISTINCT doc_id, n, rule FROM l, r WHERE regexp_matches(line, pattern)""")
def privacy_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by lines; the rules are few and fixed, so they stand in the projection."""
    rules = {"mail": r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+", "address": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "key": r"(?i)(api[_-]?key|secret|token|password)"}
    ln = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    found = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(r)) for r, p in rules.items()]), lambda x: x.isNotNull())
    return ln.select("doc_id", "n", F.explode(found).alias("rule")).distinct()


_PLANTED = """CASE c_custkey % 12 WHEN 0 THEN 'at /Users/u' || k || '/x' WHEN 1 THEN 'cd /home/u' || k || '/' WHEN 2 THEN 'C:' || chr(92) || 'Users' || chr(92) || 'u' || k || chr(92) || 'y' WHEN 3 THEN 'in /var/folders/' || k
WHEN 4 THEN '-----BEGIN EC PRIVATE KEY-----' WHEN 5 THEN 'key sk-' || repeat('a', 20) || k WHEN 6 THEN 'ghp_' || repeat('B', 20) || k WHEN 7 THEN 'AKIA' || repeat('7', 16) WHEN 8 THEN 'codex-clipboard-' || k
WHEN 9 THEN '/Users/<name>/ and /home/<u>/' WHEN 10 THEN 'a' || chr(10) || 'b' || chr(1) || chr(10) || chr(2) ELSE 'nothing /Users/' END"""


@query("C25 C37", f"""WITH t AS (SELECT 'f' || k AS path, k AS key, '# head' || chr(10) || {_PLANTED.replace("c_custkey", "k")} AS text FROM (SELECT c_custkey AS k FROM customer)),
r AS (SELECT * FROM (VALUES (0, 'macOS personal absolute path'), (1, 'Linux personal absolute path'), (2, 'Windows personal absolute path'), (3, 'macOS attachment cache path'), (4, 'private key material'), (5, 'OpenAI-style secret token'), (6, 'GitHub secret token'), (7, 'AWS access key'), (8, 'clipboard attachment identifier')) v(m, rule))
SELECT path, rule, 2 AS line FROM t JOIN r ON key % 12 = m UNION ALL SELECT path, 'invalid control character in text candidate', 3 FROM t WHERE key % 12 = 10""")
def privacy_content_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for every customer, with what one of the rules forbids, or nearly so, in its second line."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    return grading.content_findings(c.select(F.concat(F.lit("f"), "k").alias("path"), F.expr(f"'# head' || chr(10) || {_PLANTED}").alias("text")))


@query("C25 C37", """WITH p AS (SELECT p_partkey AS k, 'dir' || p_partkey || '/' AS d FROM part)
SELECT d || '.env.' || k AS path, 'credential/config filename' AS rule FROM p WHERE k % 6 = 0 UNION ALL SELECT d || 'x.PEM', 'secret or generated binary suffix' FROM p WHERE k % 6 = 1
UNION ALL SELECT d || 'private/.DS_Store', unnest(['OS metadata file', 'private/session/generated path component']) FROM p WHERE k % 6 = 2 UNION ALL SELECT d || 'sources/raw/a.md', 'forbidden private evidence path' FROM p WHERE k % 6 = 3""")
def privacy_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for every part, most of them forbidden in one way or two; .env.example and .key alone are not."""
    name = F.expr("CASE p_partkey % 6 WHEN 0 THEN '.env.' || p_partkey WHEN 1 THEN 'x.PEM' WHEN 2 THEN 'private/.DS_Store' WHEN 3 THEN 'sources/raw/a.md' WHEN 4 THEN '.env.example' ELSE '.key' END")
    return grading.path_findings(table(spark, sf_dir, "part").select(F.concat(F.lit("dir"), "p_partkey", F.lit("/"), name).alias("path")))


@query("O1 M29 W1", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before_ FROM conversations")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before_"))
