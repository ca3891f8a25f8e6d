"""Neighbourhoods that are scored and cut, and names that are matched by their plain form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def plain_name(name: Column) -> Column:
    """Lower case, words of letters and digits, without leading noughts and the word no."""
    words = F.regexp_extract_all(F.lower(name), F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    kept = F.filter(F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), F.regexp_replace(w, "^0+(?=.)", "")).otherwise(w)), lambda w: w != "no")
    return F.array_join(kept, " ")


def alias_matches(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention, name, entity) for mentions (mention, name) whose plain form is that of one of
    the aliases (entity, alias); of several entities with one form the least stands."""
    known = aliases.select("entity", plain_name(F.col("alias")).alias("_form")).groupBy("_form").agg(F.min("entity").alias("entity"))
    return mentions.withColumn("_form", plain_name(F.col("name"))).join(known, "_form").drop("_form")


def expanded(edges: DataFrame, anchor: str, most: int) -> DataFrame:
    """(node, hops, weight, degree) of nodes within ``most`` hops of the anchor over directed
    edges (src, dst, prior): the weight is the best product of priors on a shortest way."""
    edges = stored(edges.groupBy("src", "dst").agg(F.max("prior").alias("prior")), "edges")
    seen = front = edges.sparkSession.createDataFrame([(anchor, 0, 1.0)], "node string, hops int, weight double")
    for k in range(1, most + 1):
        near = edges.join(front, edges.src == front.node).groupBy("dst").agg(F.max(F.col("weight") * F.col("prior")).alias("weight"))
        new = near.select(F.col("dst").alias("node"), F.lit(k).alias("hops"), "weight").join(seen.select("node"), "node", "left_anti")
        front = stored(new, "front")
        seen = seen.unionByName(front)
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return seen.where(F.col("node") != anchor).join(degree, "node")
