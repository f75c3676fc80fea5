"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liveops.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b); the component is its least node.

    Each round a node follows its neighbour of least hash, and that one's, unless its own hash is
    less; links are rewritten to the nodes arrived at, and those inside one node go. On a path
    only a third of the nodes have the least hash around, so a path shrinks as fast as a star, and
    all rounds together handle about as many links as the first. Only whether links are left
    reaches the driver.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = written(links.where("a <> b").select(*pair).distinct())
    label, salt = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(salt), c), F.col(c))  # noqa: B023, E731
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
        step = written(near.select(
            "node", F.when(F.col("near") < rank("node"), F.col("near.b")).otherwise(F.col("node")).alias("to")
        ))
        far = step.select(F.col("node").alias("to"), F.col("to").alias("root"))
        jump = written(step.join(far, "to").select("node", "root"))
        of = {c: jump.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"}
        moved = edges.join(of["a"], "a").join(of["b"], "b").where("root_a <> root_b")
        edges = written(moved.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).select(*pair).distinct())
        if salt:
            onward = jump.select(F.col("node").alias("root"), F.col("root").alias("next"))
            label = label.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            label = written(label)
        else:
            label = jump
        salt += 1
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.join(least, "root").select("node", "component")
