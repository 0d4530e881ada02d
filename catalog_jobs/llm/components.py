"""Connected components of a graph as DataFrame joins, by contraction: every vertex hooks to its least neighbour, hooks are shortened, edges relabelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_jobs.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (v, root): the least vertex of its component for every vertex that has an edge to another.

    Loops and repeated edges don't matter. Each round at least halves the vertices that still have edges; nothing but counts
    reaches the driver, and a vertex with very many edges is a key of joins and partial minima only.
    """
    left = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        # a parent is never larger than its child, so that hooks have no cycles
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("root")), "hooks")
        if hooks.isEmpty():
            return labels if labels is not None else hooks
        while True:
            up = hooks.select(F.col("v").alias("root"), F.col("root").alias("upper"))
            hooks = written(hooks.join(up, "root").select("v", F.col("upper").alias("root"), (F.col("root") != F.col("upper")).alias("moved")), "hooks")
            if hooks.filter("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        hooks = hooks.drop("moved")
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("v").alias("root"), F.col("root").alias("upper"))
            labels = written(labels.join(step, "root", "left").select("v", F.coalesce("upper", "root").alias("root")), "labels")
        for end in ("a", "b"):
            left = left.join(hooks.select(F.col("v").alias(end), "root"), end).drop(end).withColumnRenamed("root", end)
        left = written(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
