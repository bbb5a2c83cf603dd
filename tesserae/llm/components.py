"""Connected components of an edge table by alternating large and small stars, nothing of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import split_join, stored

#: Edges to a task, about.
EDGES = 200_000


def _stars(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    # few edges are handled by few tasks, however many partitions a shuffle makes
    tasks = max(1, -(-total // EDGES))
    least = stored(least.select("a", F.least("a", "m").alias("m"), "n").coalesce(tasks))
    # large star: every larger neighbour moves to the least of the neighbourhood
    large = split_join(both.where(F.col("b") > F.col("a")), least, ["a"], "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    # small star: the node and its smaller neighbours move to the least of these (here b < a holds for every edge)
    large = stored(large.coalesce(tasks))
    low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).coalesce(tasks))
    small = split_join(large, low, ["a"], "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (a, b: bigint): component is the smallest node that can be reached.

    Self loops, repeated edges and either direction are allowed; rows with a null end are left out. No edges: no rows.
    A hub's edges stay where they are: only what its neighbourhood moves to is sent to them. Edges are rewritten until every
    node points at its component's least node. Each round is written to the shared folder as a table: checkpoints carry
    on what is known of their columns, more with each round.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == seen:
            break
        seen, now = state, stored(_stars(now, state[0]))
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
