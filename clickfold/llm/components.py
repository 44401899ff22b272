"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickfold.llm.scratch import Scratch


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Stored, so that Spark can split the join where one node has very many edges.
    least = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")), name)
    joined = both.join(least, "u").filter(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge points down (u > v) after a large star.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )


def component_roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has an edge, for ``edges`` of two long columns.

    The root is the smallest node of the component. A round is two joins on the node, and
    a chain of n nodes takes about log n rounds. Each round's edges are written, and the
    table of the round before is deleted; only a count and a hash sum reach the driver.
    """
    u, v = edges.columns
    down = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    current = scratch.put(down.filter("u != v").distinct(), "edges-0")
    mark, turn = None, 0
    while True:
        seen = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if (seen.n, seen.h) == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark, turn = (seen.n, seen.h), turn + 1
        large = _large_star(current, scratch, f"least-{turn}")
        current = scratch.put(_small_star(large).filter("u != v").distinct(), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        scratch.drop(f"least-{turn}")
