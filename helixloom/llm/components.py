"""Connected components of links between integer nodes, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm._shared import written


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of the links (a, b).

    Every root hooks onto the smallest root it is linked with, hooks are shortened to
    trees of depth one, and the links between what remains are contracted. Each step at
    least halves the roots of a component that still have links, and the tables shrink.
    """
    edges = written(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct(), "links")
    nodes = edges.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while edges.head(1):
        hooks = edges.groupBy("hi").agg(F.min("lo").alias("lo"))
        while True:
            hooks = written(hooks, "hooks")
            up = hooks.select(F.col("hi").alias("mid"), F.col("lo").alias("top"))
            if not hooks.join(up, hooks["lo"] == up["mid"], "left_semi").head(1):
                break
            hooks = hooks.join(up, hooks["lo"] == up["mid"], "left").select("hi", F.coalesce("top", "lo").alias("lo"))
        of = hooks.select(F.col("hi").alias("old"), F.col("lo").alias("new"))
        labels = written(labels.join(of, labels["component"] == of["old"], "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
        for side in ("hi", "lo"):
            other = "lo" if side == "hi" else "hi"
            edges = edges.join(of, edges[side] == of["old"], "left").select(F.coalesce("new", side).alias(side), other)
        edges = written(edges.filter("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "links")
    return labels
