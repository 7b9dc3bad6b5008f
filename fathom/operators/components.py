"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is two aggregations with a map-side combine and joins that adaptive execution can split, so a node with
very many edges does not land in one task. A graph of long paths takes a number of rounds logarithmic in its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.storage import Workspace

MAX_ROUNDS = 60


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node points to one smaller node at most, and no node both points and is pointed to."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def connected_components(edges: DataFrame, work: Workspace, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node that it reaches.

    Self-loops, repeated edges and either orientation are allowed; edges with a null end are ignored. Nodes without
    edges are not returned. No edges: an empty result.
    """
    pairs = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"), F.col(left).alias("l"), F.col(right).alias("r"))
    now = work.table(pairs.where("l <> r").select("a", "b").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _is_star_forest(now):
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        now = work.table(small.distinct(), "edges")
    else:
        raise RuntimeError(f"no convergence after {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())
