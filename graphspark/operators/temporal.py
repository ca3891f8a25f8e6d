"""Intervals, half open: overlap joins in time buckets, and the thirteen relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: In the order in which the classifier tests them; exactly one holds for proper intervals.
RELATIONS = ["before", "meets", "overlaps", "starts", "during", "finishes", "equal", "finished_by", "contains", "started_by", "overlapped_by", "met_by", "after"]
INTERIOR = RELATIONS[2:11]


def allen(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (
        F.when(e1 < s2, "before").when(e1 == s2, "meets").when(s1 > e2, "after").when(s1 == e2, "met_by")
        .when((s1 == s2) & (e1 == e2), "equal").when(s1 == s2, F.when(e1 < e2, "starts").otherwise("started_by"))
        .when(e1 == e2, F.when(s1 > s2, "finishes").otherwise("finished_by"))
        .when((s1 < s2) & (e1 > e2), "contains").when((s1 > s2) & (e1 < e2), "during")
        .when(s1 < s2, "overlaps").otherwise("overlapped_by")
    )


def overlapping(intervals: DataFrame, resource: str | None, seconds: int = 30 * 86400) -> DataFrame:
    """Pairs (a, b), a < b by id, whose interiors meet, of one resource where it is named.
    intervals: id, start, end and the resource.  Rows are dealt to time buckets, so that a
    pair is met in a bucket, and kept in the first that both reach; without a resource the
    bucket is the equality of the join."""
    s, e = F.unix_timestamp("start"), F.unix_timestamp("end")
    first, last = F.floor(s / seconds), F.floor(F.greatest(e - 1, s) / seconds)
    rows = intervals.withColumn("_first", first).withColumn("_bucket", F.explode(F.sequence(first, last)))
    keys = [*([resource] if resource else []), "_bucket"]
    a = rows.select(*keys, F.col("id").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.col("_first").alias("a_first"))
    b = rows.select(*keys, F.col("id").alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("_first").alias("b_first"))
    both = a.join(b, keys).where("a < b AND a_start < b_end AND a_end > b_start AND _bucket = greatest(a_first, b_first)")
    return both.drop("_bucket", "a_first", "b_first")


def overlap_count(intervals: DataFrame, resource: str | None = None, seconds: int = 30 * 86400) -> DataFrame:
    """How many pairs have a_start < b_end and a_end > b_start: one row, or one for each
    resource where a column is named.  intervals: start and end, none before its start; a
    row without one of them meets nothing.  No pair is made: all pairs less those in which
    one ends by the start of the other, from running counts of ends over the distinct
    times, within time buckets and then over the buckets."""
    one, big, keys = F.lit(1).cast("long"), "decimal(19,0)", [resource] if resource else []
    none = F.lit(0).cast("long")
    empty = F.when(F.col("start") == F.col("end"), one).otherwise(none)
    at = lambda t, s, e, p: F.struct(F.col(t).alias("t"), s.alias("starts"), e.alias("ends"), p.alias("empty"))
    ends = intervals.where("start IS NOT NULL AND end IS NOT NULL").select(*keys, F.inline(F.array(at("start", one, none, empty), at("end", none, one, none))))
    times = ends.groupBy(*keys, "t").agg(*[F.sum(c).alias(c) for c in ("starts", "ends", "empty")]).withColumn("_bucket", F.floor(F.unix_timestamp("t") / seconds))
    # one row a bucket: their number grows with the span of time, not with the rows
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = times.groupBy(*keys, "_bucket").agg(F.sum("ends").alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), none).alias("_before"))
    so_far = F.sum("ends").over(Window.partitionBy(*keys, "_bucket").orderBy("t")) + F.col("_before")
    counted = times.join(before, [*keys, "_bucket"]).withColumn("ended", so_far)
    d = lambda c: F.col(c).cast(big)
    # an empty interval ends by its own start; two at one time do so either way round
    total = counted.groupBy(*keys).agg(F.sum("starts").alias("n"), F.sum(d("starts") * d("ended")).alias("apart"), F.sum("empty").alias("self"), F.sum(d("empty") * (d("empty") - 1)).alias("both"))
    pairs = (d("n") * (d("n") - 1) + F.col("both")) / 2 - F.col("apart") + F.col("self")
    return total.select(*keys, F.coalesce(pairs, F.lit(0)).cast("decimal(38,0)").alias("pairs"))


def as_of(facts: DataFrame, at: DataFrame, key: str, when: str, value: str) -> DataFrame:
    """For each (key, at) the latest value not after it.  One union and one window; no pairs."""
    both = facts.select(key, F.col(when).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_ask")).unionByName(at.select(key, F.col("at").alias("_t"), F.lit(None).cast(facts.schema[value].dataType).alias("_v"), F.lit(1).alias("_ask")))
    w = Window.partitionBy(key).orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("_v", ignorenulls=True).over(w)).where("_ask = 1").select(key, F.col("_t").alias("at"), "value")
