"""Connected components by label hooking and pointer jumping; nothing but counters reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readweave.llm.tables import stash, unstash


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a long, b long) to (node, component): the smallest node reachable. Repeated edges and loops are harmless.

    Each round takes the smallest label of the neighbours, hooks it on the old label's node too, and jumps to the
    label's label, so the number of rounds follows the logarithm of a component's diameter. Labels only fall; a round
    without a change ends the loop. Labels are written to the shared folder each round.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{name}-edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), f"{name}-0")
    rounds = 0
    while True:
        rounds += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        seen = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("component", "low").alias("low"))
        hook = seen.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("hooked"))
        down = seen.join(hook, seen["node"] == hook["root"], "left").select("node", F.col("component").alias("old"), F.least("low", F.coalesce("hooked", "low")).alias("low"))
        down = stash(down, f"{name}-down")
        up = down.select(F.col("node").alias("up"), F.col("low").alias("jumped"))
        new = down.join(up, down["low"] == up["up"], "left").select("node", F.least("low", F.coalesce("jumped", "low")).alias("component"), "old")
        new = stash(new, f"{name}-{rounds}")
        changed = new.where("component <> old").limit(1).count()
        unstash(labels, down)
        labels = new
        if not changed:
            unstash(both)
            return labels.select("node", "component")
