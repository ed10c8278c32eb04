"""Connected components by label propagation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .small import checkpointed


def connected_components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 100, keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """``node, component`` (the least node it is linked to) of ``nodes(node)`` and ``edges(a, b)``.

    Labels jump along labels as well, so rounds grow with the logarithm of a chain's length. Each round ends in
    ``keep``, which cuts the lineage: a checkpoint, unless the graph is small.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = keep(both)
    labels = nodes.select("node", F.col("node").alias("component"))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("other"))
        step = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("other", "component")).alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("further"))
        step = keep(step.join(jump, "next", "left").select("node", "component", F.least("next", F.coalesce("further", "next")).alias("next")))
        changed = step.where("next <> component").limit(1).count()
        labels = step.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
