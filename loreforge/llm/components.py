"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the
    edges a, b (longs). Each round takes the least root among the neighbours and
    then the root's root, so a path halves per round and a star ends in two.
    Rounds are written to the shared folder; only a count of changes is read."""
    both = written(edges.selectExpr("a as src", "b as dst").unionByName(edges.selectExpr("b as src", "a as dst")).filter("src <> dst").distinct(), "links")
    roots = written(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("root").alias("m")).withColumnRenamed("src", "node")
        low = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        # the root of the root, as known before this round
        over = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        nxt = written(low.join(over, "root").select("node", "old", F.least("root", "up").alias("root")), "roots")
        if not nxt.filter("old <> root").limit(1).count():
            return nxt.select("node", "root")
        roots = nxt.select("node", "root")
