"""Connected components of a table of links, as rounds of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component) for every vertex of ``links`` (a, b): the smallest vertex it reaches.

    Each round hooks every vertex's root to the smallest neighbouring root and
    then follows each root's root, so long chains shrink by half or more.
    Labels are written every round; only a count of changes comes back.
    Neighbours are combined before the shuffle, so a vertex with many links
    costs one row a task.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("component")),
                    "label")
    for _ in range(max_rounds):
        # The smallest label that a vertex or a neighbour has ...
        near = (both.join(label.withColumnRenamed("v", "b"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near")))
        hooked = label.join(near, "v").select("v", "component", F.least("component", "near").alias("low"))
        # ... is offered to the root of the vertex, and every vertex takes its root's best offer.
        offers = hooked.groupBy("component").agg(F.min("low").alias("best"))
        up = hooked.join(offers, "component").select("v", F.col("component").alias("old"),
                                                     F.least("low", "best").alias("mid"))
        up = written(up, "label")
        root = up.select(F.col("v").alias("mid"), F.col("mid").alias("root"))
        new = written(up.join(root, "mid", "left").select(
            "v", "old", F.least("mid", F.coalesce("root", "mid")).alias("component")), "label")
        label = new.select("v", "component")
        if not new.where("component <> old").limit(1).count():
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
