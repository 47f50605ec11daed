"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b); a component is named by its least node.

    A round hangs each node's greater neighbours on the least of its neighbourhood, and then what is below a node on the least of that. Links grow
    no more, and the rounds needed go with the logarithm of a component's longest path, not with its length.
    """
    both = links.select("a", "b").where("a <> b")
    edges = materialize(both.select(F.greatest("a", "b").alias("up"), F.least("a", "b").alias("down")).distinct())
    sign = None
    while True:
        around = edges.select(F.col("up").alias("x"), F.col("down").alias("y")).unionByName(edges.select(F.col("down").alias("x"), F.col("up").alias("y")))
        root = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("root"))
        hung = around.join(root, "x").where("y > x").select(F.col("y").alias("up"), F.col("root").alias("down"))
        hung = materialize(hung.where("up <> down").distinct())
        root = hung.groupBy("up").agg(F.min("down").alias("root"))
        pairs = F.array(F.struct(F.col("down").alias("up"), F.col("root").alias("down")), F.struct("up", F.col("root").alias("down")))
        edges = materialize(hung.join(root, "up").select(F.explode(pairs).alias("e")).select("e.*").where("up <> down").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("up", "down").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    heads = edges.select(F.col("down").alias("node"), F.col("down").alias("component")).distinct()
    return edges.select(F.col("up").alias("node"), F.col("down").alias("component")).unionByName(heads)
