"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """Rows (node, component) for every node of the edges (a, b): component is the smallest node
    reachable. Each round takes the smallest label among neighbours and then follows labels to
    their own labels, so chains shrink by half and stars end at once. Each round is a written table;
    only a count of changed labels reaches the driver.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder, "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), folder, "cc-0")
    n = 0
    while True:
        n += 1
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = written(labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")), folder, f"cc-{n}a")
        parent = step.select(F.col("node").alias("up"), F.col("component").alias("higher"))
        after = written(step.join(parent, step.component == parent.up).select("node", F.col("higher").alias("component"), "was"), folder, f"cc-{n}b")
        changed = after.filter("component <> was").limit(1).count()
        removed(spark, f"{folder}/cc-{n}a")
        removed(spark, f"{folder}/cc-0" if n == 1 else f"{folder}/cc-{n - 1}b")
        labels = after.drop("was")
        if not changed:
            removed(spark, f"{folder}/cc-edges")
            return labels
