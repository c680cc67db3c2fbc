"""Connected components of a graph given as a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintdex.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) for each node that ``links`` (a, b: long) names.

    Each round every node takes the smallest label around it and then that label's own label, so a chain's length
    halves; the rounds end when none changes.  Labels are written each round, which cuts the lineage.
    """
    both = scratch.keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u != v").distinct(), f"{name}-links")
    labels = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        after = step.join(jump, step.label == jump["at"], "left").select("node", "was", F.least("label", "beyond").alias("label"))
        written = scratch.keep(after, f"{name}-next")
        changed = not written.where("label < was").isEmpty()
        labels = written.select("node", "label")
        if not changed:
            scratch.drop(f"{name}-links", name)
            return labels
