"""Fixpoints over links, by joins with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.context import checkpoint


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of connected components: every node takes the least label of its neighbours
    and then its label's label, until nothing changes; labels are checkpointed each round. A
    node that many others link to is combined before the shuffle. Self-links don't matter."""
    both = checkpoint(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    label = checkpoint(nodes.select("node", F.col("node").alias("root")))
    for _ in range(rounds):
        least = both.join(label, both.v == label.node).groupBy("u").agg(F.min("root").alias("_m"))
        step = label.join(least, label.node == least.u, "left").select("node", F.col("root").alias("_old"), F.least("root", F.coalesce("_m", "root")).alias("root"))
        up = label.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = checkpoint(step.join(up, step.root == up._n, "left").select("node", "_old", F.least("root", F.coalesce("_r", "root")).alias("root")))
        changed = new.where("root <> _old").limit(1).count()
        label = new.drop("_old")
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def reachable(links: DataFrame, start: DataFrame, keys: list[str], rounds: int = 100) -> DataFrame:
    """(keys..., node) that can be reached: a link (keys..., node, via) is taken once ``via`` is a
    start (keys..., node) or was itself reached. Cycles end, as no node is taken twice."""
    links = checkpoint(links.select(*keys, "node", "via").distinct())
    front = start.select(*keys, "node").distinct()
    done = None
    for _ in range(rounds):
        step = links.join(front.withColumnRenamed("node", "via"), [*keys, "via"], "left_semi").select(*keys, "node").distinct()
        if done is not None:
            step = step.join(done, [*keys, "node"], "left_anti")
        front = checkpoint(step)
        if front.isEmpty():
            break
        done = front if done is None else checkpoint(done.unionByName(front))
    return done if done is not None else links.select(*keys, "node").limit(0)
