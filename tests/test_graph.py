"""Ranks of small graphs."""

from tapeloom.operators import graph


def test_ranks_that_differ_by_rounding_alone_are_equal(spark):
    nodes = spark.range(4).withColumnRenamed("id", "k")
    # all nodes stand alike; a weight of one tie is off by its last digits, as sums in another order are
    ties = [(a, b, 1 / 3 + (1e-14 if (a, b) == (0, 1) else 0.0)) for a in range(4) for b in range(4) if a != b]
    e = spark.createDataFrame(ties, "src long, dst long, w double")
    assert {r["rank"] for r in graph.small_rank(nodes, e).collect()} == {0.0}
    star = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0)], "src long, dst long, w double")
    assert {r.k: r["rank"] for r in graph.small_rank(nodes, star).collect()} == {0: 32.0, 1: 0.0, 2: 0.0, 3: 0.0}
