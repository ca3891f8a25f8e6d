"""Property paths over edge tables (src, dst).

Sequences and alternatives keep duplicates; closures are sets.  A closure is a semi-naive
loop: each round joins only the newest pairs with the edges and drops pairs that are known.
Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: After so many rounds the pairs found are written as one table, so that plans stay short.
COMPACT = 16


def inverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def sequence(first: DataFrame, second: DataFrame) -> DataFrame:
    mid = first.select("src", F.col("dst").alias("mid"))
    return mid.join(second.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")


def alternative(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct()


def identity(edges: DataFrame) -> DataFrame:
    return nodes(edges).select("src", F.col("src").alias("dst"))


def one_or_more(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Pairs joined by one or more edges; with ``seeds`` (src) only from those.  Rounds go on
    until one finds no new pair, which it must, as pairs are finite."""
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    delta = edges if seeds is None else stored(edges.join(seeds.select("src").distinct(), "src", "left_semi"), "delta")
    seen, rounds = delta, 0
    while not delta.isEmpty():
        delta = stored(sequence(delta, edges).distinct().join(seen, ["src", "dst"], "left_anti"), "delta")
        seen, rounds = seen.unionByName(delta), rounds + 1
        if rounds % COMPACT == 0:
            seen = stored(seen, "pairs")
    return seen


def zero_or_more(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """The same, and each seed (else each node of the edges) with itself."""
    same = identity(edges) if seeds is None else seeds.select("src", F.col("src").alias("dst"))
    return one_or_more(edges, seeds).unionByName(same).distinct()


def zero_or_one(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    edges = edges.select("src", "dst")
    if seeds is None:
        return edges.unionByName(identity(edges)).distinct()
    return edges.join(seeds.select("src").distinct(), "src", "left_semi").unionByName(seeds.select("src", F.col("src").alias("dst"))).distinct()


def hops(edges: DataFrame, most: int, seeds: DataFrame) -> DataFrame:
    """(src, dst, hops, path) of simple paths of 1 to ``most`` edges from the seeds."""
    step = edges.select("src", "dst").distinct()
    front = step.join(seeds.select("src").distinct(), "src", "left_semi").select("src", "dst", F.lit(1).alias("hops"), F.array("src", "dst").alias("path"))
    out = front
    for k in range(2, most + 1):
        nxt = step.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        front = front.join(nxt, "dst").where(~F.array_contains("path", F.col("next")))
        front = front.select("src", F.col("next").alias("dst"), F.lit(k).alias("hops"), F.array_append("path", F.col("next")).alias("path"))
        out = out.unionByName(front)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges with the least node that it is connected with.
    Labels only ever fall, so the rounds end."""
    both = stored(edges.select("src", "dst").unionByName(inverse(edges)).where("src <> dst").distinct(), "edges")
    label = nodes(both).select(F.col("src").alias("node"), F.col("src").alias("root"))
    while True:
        near = both.join(label, both.dst == label.node).groupBy("src").agg(F.min("root").alias("near"))
        step = label.join(near, label.node == near.src, "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"))
        # a root's own root shortens long chains
        up = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = stored(step.join(up, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        if new.exceptAll(label).isEmpty():
            return new
        label = new
