"""Versions, event chains, authorisation and receipts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paths import components

#: The order of states; none may be skipped.
STATES = ["candidate", "proposed", "committed", "regression_passed", "release_complete", "promoted"]


def semantic_diff(old: DataFrame, new: DataFrame, keys: list[str], sha: str = "sha") -> DataFrame:
    """add, remove or replace for every key whose content differs."""
    a, b = old.select(*keys, F.col(sha).alias("_old")), new.select(*keys, F.col(sha).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "remove").when(F.col("_old") != F.col("_new"), "replace")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("operation")).where("operation IS NOT NULL")


def chained(steps: DataFrame) -> DataFrame:
    """Events with hashes for (candidate, seq), seq from 1 on: each has the hash of the one before."""
    state = F.element_at(F.array(*map(F.lit, STATES)), F.col("seq"))
    sha = lambda n: F.sha2(F.concat_ws("/", "candidate", n), 256)
    return steps.select("candidate", "seq", F.when(F.col("seq") > 1, sha(F.col("seq") - 1)).alias("prev_sha"), sha(F.col("seq")).alias("sha"), state.alias("state"))


def advance(events: DataFrame, baselines: DataFrame) -> DataFrame:
    """The next event of every candidate with an unbroken chain that isn't at the last state.
    Commits and promotions need a baseline (candidate, made_from, current) that is still the
    one the candidate was made from; a candidate without one waits."""
    sound = events.join(chain_faults(events).select("candidate").distinct(), "candidate", "left_anti")
    last = sound.groupBy("candidate").agg(F.max_by(F.struct("seq", "sha"), "seq").alias("x")).select("candidate", (F.col("x.seq") + 1).alias("seq"), F.col("x.sha").alias("prev_sha"))
    new = last.where(F.col("seq") <= len(STATES)).withColumn("state", F.element_at(F.array(*map(F.lit, STATES)), F.col("seq")))
    fresh = baselines.where("made_from = current").select("candidate").distinct().withColumn("_fresh", F.lit(True))
    checked = new.join(fresh, "candidate", "left").where(~F.col("state").isin("committed", "promoted") | F.col("_fresh"))
    return checked.select("candidate", "seq", "prev_sha", F.sha2(F.concat_ws("/", "candidate", "seq"), 256).alias("sha"), "state")


def resumable(events: DataFrame, receipts: DataFrame, inputs: DataFrame) -> DataFrame:
    """(candidate, verdict) for candidates whose last state is regression_passed: resume where
    the receipt (candidate, receipt_sha) binds the input (candidate, input_sha) of now."""
    last = events.groupBy("candidate").agg(F.max_by("state", "seq").alias("state")).where("state = 'regression_passed'")
    j = last.join(inputs, "candidate").join(receipts, "candidate", "left")
    return j.select("candidate", F.when(F.col("receipt_sha") == F.col("input_sha"), "resume").otherwise("run again").alias("verdict"))


def propagated(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Facts (s, p, o) with every s and o replaced by every node that links (src, dst) make the
    same, itself included."""
    groups = components(links)
    members = groups.select("root", F.col("node").alias("twin"))

    def widened(rows: DataFrame, column: str) -> DataFrame:
        j = rows.join(groups.select(F.col("node").alias(column), "root"), column, "left").join(members, "root", "left")
        return j.withColumn(column, F.coalesce("twin", column)).drop("root", "twin")

    return widened(widened(facts, "s"), "o").select("s", "p", "o").distinct()


def chain_faults(events: DataFrame) -> DataFrame:
    """seq and fault of events (candidate, seq, prev_sha, sha, state) whose chain is broken or
    whose state isn't the one after that before it."""
    w = Window.partitionBy("candidate").orderBy("seq")
    order = F.create_map(*[x for k, s in enumerate(STATES) for x in (F.lit(s), F.lit(k))])
    e = events.withColumns({"_sha": F.lag("sha").over(w), "_n": order[F.col("state")], "_before": F.lag(order[F.col("state")]).over(w)})
    fault = F.when(F.coalesce("_sha", F.lit("")) != F.coalesce("prev_sha", F.lit("")), "broken chain").when(F.col("_n") != F.coalesce("_before", F.lit(-1)) + 1, "skipped state")
    return e.select("candidate", "seq", fault.alias("fault")).where("fault IS NOT NULL")


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two results hold the same rows, as often."""
    left = a.exceptAll(b).limit(1).agg(F.count("*").alias("x"))
    right = b.exceptAll(a).limit(1).agg(F.count("*").alias("y"))
    return left.crossJoin(right).select(((F.col("x") == 0) & (F.col("y") == 0)).alias("equal"))


def receipt(df: DataFrame) -> DataFrame:
    """Rows and a digest of a result that doesn't depend on the order of its rows: the sum of
    row hashes, each counted as often as its row."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def allowed_actions(binding: DataFrame, task: DataFrame) -> DataFrame:
    """Actions that are both bound and asked for."""
    return binding.select("action").distinct().join(task.select("action").distinct(), "action", "left_semi")
