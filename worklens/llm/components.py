"""Connected components of an edge table, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklens.llm.common import Scratch


SALTS = 16


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) edges -> (node, component), the component's smallest node; nodes without edges are not listed.

    Every round points each node at the smallest node that it or a neighbour
    points at, then follows pointers twice as far; the rounds grow with the
    logarithm of the longest path. Each round is written to shared storage, so
    a lost executor costs that round at most, and replaces the one before.
    Nothing is collected but one count a round.
    """
    scratch = Scratch(edges.sparkSession)
    both = edges.filter("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y"))
    links = scratch.stage(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), f"{name}-links")
    labels = scratch.stage(links.groupBy("x").agg(F.min("y").alias("m")).select(
        F.col("x").alias("node"), F.least("x", "m").alias("component")), f"{name}-labels")
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    while True:
        near = (
            links.join(labels, links["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, labels["node"] == near["x"]).select(
            "node", F.least("component", "near").alias("target"), F.col("component").alias("before"))
        # What a node's old label has learned goes to all that point at it.
        # (salted: in the end all of a large component share one label).
        learned = lower.groupBy("before").agg(F.min("target").alias("learned")).withColumn("salt", F.explode(salts))
        hooked = lower.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(learned, ["before", "salt"]).select("node", "before", F.least("target", "learned").alias("target"))
        onward = hooked.select(F.col("node").alias("target"), F.col("target").alias("onward"))
        after = scratch.stage(
            hooked.join(onward, "target", "left")
            .select("node", F.coalesce(F.least("target", "onward"), "target").alias("component"),
                    (F.coalesce(F.least("target", "onward"), F.col("target")) < F.col("before")).alias("moved")),
            f"{name}-labels")
        scratch.drop(labels)
        labels = after
        if not after.filter("moved").limit(1).count():
            scratch.drop(links)
            return after.select("node", "component")
