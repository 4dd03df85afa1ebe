"""Roots of a parent-pointer forest by repeated doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def find_roots(parents: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, root`` from ``node, parent`` (a root is its own parent).

    Every round replaces the parent by the parent's parent, so a chain of length
    n takes log2(n) rounds.  Each round is checkpointed to the shared folder.
    """
    current = cut_lineage(parents.select(node, parent))
    while True:
        up = current.select(F.col(node).alias(parent), F.col(parent).alias("_up"))
        moved = cut_lineage(current.join(up, parent).select(node, F.col("_up").alias(parent), (F.col("_up") != F.col(parent)).alias("_moved")))
        changed = moved.filter("_moved").limit(1).count()
        current = moved.drop("_moved")
        if not changed:
            return current.withColumnRenamed(parent, "root")
