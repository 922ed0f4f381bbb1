"""Graphs: ties of symbols through their industry, nearest neighbours and page rank; explicit edges for small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hubs(dims: DataFrame) -> DataFrame:
    """An industry as a hub: each symbol's number of peers and its weight to each of them, which sum to 1 (null without a peer).

    All ties of one industry weigh the same, so a row for each symbol says what a row for each pair would.
    """
    sizes = dims.groupBy("industry").agg((F.count("*") - 1).alias("peers"))
    return dims.select("symbol", "industry").join(sizes, "industry").select("symbol", "industry", "peers", F.try_divide(F.lit(1.0), F.col("peers")).alias("w"))


def nearest_of_hubs(dims: DataFrame, k: int = 5) -> DataFrame:
    """The k heaviest ties of each symbol (the least ids, as an industry's ties weigh the same), kept where both ends keep them.

    They are among an industry's k + 1 least ids, so each symbol meets that many and no more.
    """
    h = hubs(dims)
    first = dims.withColumn("place", F.row_number().over(Window.partitionBy("industry").orderBy("symbol"))).filter(F.col("place") <= k + 1).select("industry", F.col("symbol").alias("dst"))
    met = h.join(first, "industry").filter("symbol != dst").select(F.col("symbol").alias("src"), "dst", "w")
    own = met.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).filter(F.col("place") <= k).drop("place")
    return own.join(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def hub_rank(dims: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """A fixed number of rounds over the ties of hubs; mass of symbols without a tie stays out, as the reference semantics have it.

    A symbol gets what its peers' ranks sum to, through the hub: a round needs the industry's sum and the symbol's own rank,
    so all rounds are one expression over an industry's size, and the ties are never laid out.
    """
    n = max(dims.count(), 1)
    groups = dims.groupBy("industry").agg(F.count("*").cast("double").alias("m"))
    base, m = (1 - damping) / n, F.col("m")

    def step(s, _):
        gets = F.when(m > 1, damping * (s.total - s.own) / (m - 1)).otherwise(0.0)
        return F.struct((m * base + F.when(m > 1, damping * s.total).otherwise(0.0)).alias("total"), (base + gets).alias("own"))

    ranks = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct((m / n).alias("total"), F.lit(1.0 / n).alias("own")), step, lambda s: s.own)
    return dims.join(groups.select("industry", ranks.alias("rank")), "industry").select("symbol", "rank")


def weighted(kinds: dict[float, DataFrame]) -> DataFrame:
    """Edges of several kinds (weight -> src, dst): the heaviest tie holds, and a node's weights are brought to a sum of 1."""
    out = None
    for weight, pairs in kinds.items():
        one = pairs.select("src", "dst", F.lit(weight).alias("w"))
        out = one if out is None else out.unionByName(one)
    e = out.groupBy("src", "dst").agg(F.max("w").alias("w"))
    return e.join(e.groupBy("src").agg(F.sum("w").alias("total")), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w"))


#: Nodes of a graph that fits in a row.
SMALL = 1000
#: Ranks closer than this share of the highest differ by rounding alone, and count as equal.
EVEN = 1e-12


def small_rank(nodes: DataFrame, e: DataFrame, rounds: int = 20, damping: float = 0.85, scale: float = 32.0) -> DataFrame:
    """Page rank of a small dimension's graph (k), scaled to 0..scale: its nodes are one array, and all rounds are one expression, without a join a round."""
    if nodes.count() > SMALL:
        raise ValueError("this form keeps a whole graph in one row; hub_rank has no such limit")
    into = e.groupBy(F.col("dst").alias("k")).agg(F.array_sort(F.collect_list(F.struct("src", "w"))).alias("into"))
    ks = nodes.join(into, "k", "left").select(F.struct("k", F.coalesce("into", F.array().cast("array<struct<src:bigint,w:double>>")).alias("into")).alias("n"))
    row = ks.agg(F.array_sort(F.collect_list("n")).alias("ns"))
    n = F.size("ns")
    row = row.withColumn("place", F.map_from_arrays("ns.k", F.transform("ns", lambda x, i: i)))
    row = row.withColumn("ns", F.transform("ns", lambda x: F.struct(x.k.alias("k"), F.transform(x["into"], lambda y: F.struct(F.element_at("place", y.src.cast("long")).alias("at"), y.w.alias("w"))).alias("into"))))
    step = lambda ranks, _: F.transform("ns", lambda x: (1 - damping) / n + damping * F.aggregate(x["into"], F.lit(0.0), lambda s, y: s + y.w * F.get(ranks, y["at"])))
    ranks = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform("ns", lambda x: F.lit(1.0) / n), step)
    out = row.select("ns", ranks.alias("ranks")).select(F.explode(F.arrays_zip(F.col("ns.k").alias("k"), F.col("ranks").alias("rank"))).alias("r"), F.array_min("ranks").alias("lo"), F.array_max("ranks").alias("hi"))
    spread = F.col("hi") - F.col("lo")
    return out.select("r.k", (F.when(spread > EVEN * F.col("hi"), (F.col("r.rank") - F.col("lo")) / spread).otherwise(0.0) * scale).alias("rank"))


def neighbourhoods(nodes: DataFrame, e: DataFrame, own: DataFrame) -> DataFrame:
    """A node's feature (k, f), the weighted mean of its neighbours', and that of theirs, side by side."""

    def around(f: DataFrame) -> DataFrame:
        got = e.join(f, F.col("dst") == F.col("k")).groupBy("src").agg(F.sum(F.col("w") * F.col("f")).alias("f"))
        return nodes.join(got, F.col("k") == F.col("src"), "left").select("k", F.coalesce("f", F.lit(0.0)).alias("f"))

    near = around(own)
    far = around(near)
    named = lambda f, name: f.select("k", F.col("f").alias(name))
    return nodes.join(named(own, "own"), "k", "left").join(named(near, "near"), "k").join(named(far, "far"), "k").select("k", F.coalesce("own", F.lit(0.0)).alias("own"), "near", "far")
