"""Connected components by alternating large and small stars, entirely as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.session import stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node that an edge (a, b) touches; component is its smallest node.

    Each round writes its edges to the shared folder, so a lost executor costs one round at most
    and plans stay short. Hubs are met with partial aggregates and with joins that the adaptive
    planner can split. Edges with a null end and loops are ignored. Raises if it has not settled
    after max_rounds, which a path of 2**30 nodes would not reach.
    """
    now = stage(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    if not mark[0]:
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        rows = 2 * mark[0]  # what each of the round's tables has at most
        both = now.union(now.select("v", "u"))
        # Aggregates are read anew before they are joined, so that the planner can split a hub.
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", rows=rows)
        large = (
            both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        )
        large = stage(large, "large", rows=rows)
        small_least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least", rows=rows)
        small = large.join(small_least.hint("merge"), "u")
        now = stage(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct(),
            "edges",
            rows=rows,
        )
        after = _mark(now)
        if after == mark:
            nodes = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            roots = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
            return nodes.union(roots)
        mark = after
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of an edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
