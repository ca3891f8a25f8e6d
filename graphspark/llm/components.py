"""Connected components of an edge table, without collecting edges or components.

Large-star and small-star steps in turn: each node's larger neighbours, then its smaller
ones, are linked to the least node in reach.  Every round is written to the shared folder,
so lineage stays short; only a count and a checksum of each round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: A node's edges meet its least neighbour in so many tasks, as a hub may have very many.
SALTS = 8


def _star(edges: DataFrame) -> DataFrame:
    """(u, v) rows to (u, v, m) with m the least of u's neighbours and u."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it is connected with) for every node of
    ``edges`` (columns u and v, both long); nodes without edges aren't listed."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(now, "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        now = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stored(now.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = new
