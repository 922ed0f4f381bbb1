"""Connected components of an edge table, by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.shared import shared_dir


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """a, b (long) -> node, root: the least node that each node reaches. Nodes without an edge aren't in it.

    Defined results: edges with a null end, from a node to itself and repeated ones count for nothing; an empty table
    gives an empty result.

    In a round, each node hooks onto its least neighbour, and follows the hooks to their end by doubling; edges
    are renamed by what their ends came to, and those within one node go. Fewer than half of the nodes are left each time, so
    later rounds have little to move. Each is checkpointed in the shared folder. Hubs are summed map-side; their
    joins are ones that adaptive execution can split.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))

    def plain(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct().checkpoint()

    live = plain(edges)
    roots = live.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    for number in range(rounds):
        if live.isEmpty():
            return roots
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        hooks = ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("up")).checkpoint()
        jumps = hooks.select("node", F.col("up").alias("root"))
        while True:  # to the end of each chain of hooks, twice as far each time
            far = jumps.select(F.col("node").alias("root"), F.col("root").alias("far"))
            ahead = jumps.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")).checkpoint()
            jumps = ahead.select("node", "root")
            if ahead.filter("moved").isEmpty():
                break
        to = lambda c, name: jumps.select(F.col("node").alias(c), F.col("root").alias(name))  # noqa: B023, E731
        roots = jumps if not number else roots.join(to("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root")).checkpoint()
        live = plain(live.join(to("a", "x"), "a").join(to("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
