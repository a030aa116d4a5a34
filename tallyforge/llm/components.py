"""Connected components by alternating large-star and small-star steps.

Each step is a map-side-combined minimum for each node and a join back on the node, whose hot
keys adaptive execution can split; no task gathers a node's neighbours. Edges are written to the
shared folder after each round, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialise

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (two columns, any names): the component's least node.

    Self-loops and repeated edges do no harm; edges with a null end are left out.
    """
    u, v = edges.columns
    now = materialise(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges", small=True)
    before = None
    for _ in range(MOST_ROUNDS):
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not count or before == (count, total):
            break
        before = (count, total)
        now = materialise(_small_star(_large_star(now)), "edges", small=True)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component")).distinct()
