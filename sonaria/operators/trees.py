"""Ancestry in tables of (node, parent): chains are followed by doubling, in rounds that grow with the
logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.sources.shared import written

#: Rounds after which a chain that has not ended is a cycle: chains are shorter than 2**40.
MOST_ROUNDS = 40


def highest(nodes: DataFrame, node: str, parent: str, marked: Column) -> DataFrame:
    """node, top: the highest of a node and its ancestors that is ``marked``; null where none is."""
    step = written(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.when(marked, F.col(node)).alias("top")), "highest")
    while step.where("up is not null").limit(1).count():
        above = step.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("top").alias("upper"))
        step = written(step.join(above, "up", "left").select("node", F.col("next").alias("up"), F.coalesce("upper", "top").alias("top")), "highest")
    return step.select("node", "top")


def roots_and_depths(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, root, depth: the ancestor without a parent in the table, and the number of steps to it.

    A parent that is not in the table counts as none. A node on a cycle, or below one, has a null root
    and depth. Repeated rows of a node count once; of different parents the smallest counts.
    """
    own = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"))
    known = own.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    step = own.join(known, "up", "left").select("node", F.when(F.col("there"), F.col("up")).alias("up"))
    # up: the ancestor ``depth`` steps above; done where it has no parent
    step = written(step.select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done")), "ancestry")
    open_ = None
    for _ in range(MOST_ROUNDS):
        left = step.where(~F.col("done")).count()
        if not left or left == open_:  # nobody arrived: what is left goes round
            break
        open_ = left
        above = step.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("arrived"))
        moved = step.join(above, "up")
        step = written(moved.select("node", F.when(F.col("done"), F.col("up")).otherwise(F.col("next")).alias("up"), F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("depth"), (F.col("done") | F.col("arrived")).alias("done")), "ancestry")
    return step.select("node", F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))
