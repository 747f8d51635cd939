"""Connected components of an edge table, by alternating stars.

Large star: every node links its larger neighbours to its smallest one.  Small
star: every node links its smaller neighbours, and itself, to the smallest one.
Repeated until nothing changes, every node hangs on the smallest id of its
component.  Minima are partial aggregates and are checkpointed before they are
joined back, so both sides of that join are plain exchanges, whose hot keys
adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed

#: Rounds needed are about the logarithm of the longest path; more than this means a bug.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = checkpointed(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = checkpointed(down.groupBy("a").agg(F.min("b").alias("low")))
    moved = down.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest id reachable.

    Self-edges are ignored, repeated edges count once; without edges there are no rows.
    """
    edges = checkpointed(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct())
    state = None
    for _ in range(MOST_ROUNDS):
        edges = checkpointed(_small_star(checkpointed(_large_star(edges))))
        # count, and an order-free checksum, tell whether the stars changed
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("b", "a").cast("long"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components didn't settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
