"""Connected components of an edge table by repeated contraction; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.scratch import Scratch


def _distinct(pairs: DataFrame) -> DataFrame:
    return (pairs.filter(F.col("u") != F.col("v"))
            .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long, not null). Returns (id, component) for every node of an edge between two nodes:
    component is the smallest id that is reachable.

    Each round hooks every node of the contracted graph to its smallest neighbour, follows the hooks to their
    roots and contracts; a node that has a smaller neighbour is gone in the next round. A node with very many
    edges only meets partial minima and joins that can be split. An empty table gives an empty table.
    """
    with Scratch(edges.sparkSession) as tables:
        links = tables.written(_distinct(edges))
        labels: DataFrame | None = None
        while not links.isEmpty():
            both = links.select(F.col("u").alias("id"), F.col("v").alias("to")).unionAll(
                links.select(F.col("v").alias("id"), F.col("u").alias("to")))
            hook = tables.written(both.groupBy("id").agg(F.least("id", F.min("to")).alias("up")))
            while True:  # pointer jumping; up <= id, so there are no circles
                jumped = tables.written(hook.join(hook.select(F.col("id").alias("up"), F.col("up").alias("root")), "up").select(
                    "id", F.col("root").alias("up"), (F.col("root") != F.col("up")).alias("moved")))
                hook, moved = jumped.drop("moved"), jumped.filter("moved")
                if moved.isEmpty():
                    break
            up = hook.select(F.col("id").alias("component"), F.col("up").alias("_up"))
            labels = hook.select("id", F.col("up").alias("component")) if labels is None else tables.written(
                labels.join(up, "component", "left").select("id", F.coalesce("_up", "component").alias("component")))
            left = links.join(hook.select(F.col("id").alias("u"), F.col("up").alias("a")), "u")
            links = tables.written(_distinct(left.join(hook.select(F.col("id").alias("v"), F.col("up").alias("b")), "v").select(
                F.col("a").alias("u"), F.col("b").alias("v"))))
        if labels is None:
            labels = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
        return tables.written(labels, stays=True)
