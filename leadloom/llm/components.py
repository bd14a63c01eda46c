"""Connected components of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import Staged


def components(links: DataFrame, staged: Staged) -> DataFrame:
    """``node`` and ``component`` (least node reachable) of all nodes of ``links`` (a, b).

    Each round a node takes the least label among its neighbours and itself, then
    the label of its label.  Both steps are joins and pre-aggregated minima, so a
    node with very many links is no hot spot.  Labels are written between rounds.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).where("node <> other")
    edges, _ = staged.write(both.distinct())
    least = edges.groupBy("node").agg(F.min("other").alias("least"))
    labels, path = staged.write(least.select("node", F.least("node", "least").alias("component")))
    total = _total(labels)
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "component"), "other").select("node", "component")
        spread = near.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        spread, middle = staged.write(spread)
        up = spread.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        jumped = spread.join(up, "component", "left").select("node", F.coalesce("upper", "component").alias("component"))
        labels, after = staged.write(jumped)
        staged.drop(middle)
        staged.drop(path)
        path, before, total = after, total, _total(labels)
        if total == before:
            return labels


def _total(labels: DataFrame):
    """Labels only fall, so they are final when their sum is."""
    return labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
