"""Resharding by a minimum-cost flow.

A layout is a folder of Parquet files by shard and block; a block is a bounded run of one shard's documents. To bring the
shards to new capacities, a flow is solved from old shards to new ones: a byte that stays costs nothing, one that moves costs 1 (or what
a matrix of costs says), so that the flow moves the fewest bytes. The flow is then laid over each shard's blocks: most of them stay or
move as a whole, and the one where two amounts meet is split by document. Only files of blocks that move or are split are written;
they are complete before the old ones are removed, and all others are left as they are.

Documents come to their first shard by a hash of the text, which keeps equal texts together and is uneven where there are many copies;
within a shard they are dealt to blocks by id and text, and rows of which there are very many equal ones by their number. So no block grows
with a group of copies.

To the driver come a row for each block, at most about MAX_BLOCKS, and the flow of at most MAX_SHARDS shards.

Law `bytes`: a document's size is the bytes of its text and 8 more; shards are near equal in size. A shard ends within about
half a document of its capacity for each amount that it gives or takes, and a document is never split: one above the average is
its shard's capacity, and the other shards share the rest.

Defined results: a null text has size 8 and the check sum of an empty one; rows without an id are dealt by their text; repeated
rows are rows of their own; an empty table gives an empty result. `lay_out` keeps all columns but takes the names in `LAYOUT`
for itself; the query ignores columns other than id and text.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.shared import Workspace, discard

SHARDS = 24
BLOCK_ROWS = 500
MAX_BLOCKS = 65_536
MAX_SHARDS = 1024
SEED = 20250301
OVERHEAD = 8
NEAR = 0.01
ROUNDS = 4
LAYOUT = ("layout_shard", "layout_block", "layout_bytes")


class Block(NamedTuple):
    shard: int
    name: str
    bytes: int
    largest: int


class Piece(NamedTuple):
    """What of a block, by bytes from its begin, goes to a shard."""

    shard: int
    name: str
    begin: int
    end: int
    to: int


def stored_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def transfers(sizes: Sequence[int], capacities: Sequence[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Bytes from each old shard to each new one, of least total cost: successive shortest paths with potentials.

    The sums of sizes and capacities are the same. Without a matrix of costs, staying costs 0 and moving 1.
    """
    left, room = np.array(sizes, np.int64), np.array(capacities, np.int64)
    if left.sum() != room.sum():
        raise ValueError("capacities have to hold the sizes exactly")
    n, m = len(left), len(room)
    price = (np.arange(n)[:, None] != np.arange(m)).astype(float) if cost is None else np.asarray(cost, float)
    flow = np.zeros((n, m), np.int64)
    up, down = np.zeros(n), np.zeros(m)  # potentials keep the reduced costs at 0 or more
    while left.any():
        far = np.concatenate([np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)])
        before, done = np.full(n + m, -1), np.zeros(n + m, bool)
        while True:
            node = int(np.argmin(np.where(done, np.inf, far)))
            done[node] = True
            if node >= n and room[node - n] > 0:
                break
            if node < n:
                ahead, to = far[node] + np.maximum(price[node] + up[node] - down, 0), slice(n, n + m)
            else:
                ahead = np.where(flow[:, node - n] > 0, far[node] + np.maximum(down[node - n] - up - price[:, node - n], 0), np.inf)
                to = slice(0, n)
            better = ahead < far[to]
            far[to][better] = ahead[better]
            before[to][better] = node
        reach = np.minimum(far, far[node])
        up += reach[:n]
        down += reach[n:]
        path, at = [node], node
        while before[at] >= 0:
            at = int(before[at])
            path.append(at)
        path.reverse()
        steps = [(a, b - n, 1) if a < n else (b, a - n, -1) for a, b in zip(path, path[1:], strict=False)]
        amount = min(int(left[path[0]]), int(room[node - n]), *(int(flow[i, j]) for i, j, sign in steps if sign < 0))
        for i, j, sign in steps:
            flow[i, j] += sign * amount
        left[path[0]] -= amount
        room[node - n] -= amount
    return flow


def capacities_for(sizes: Sequence[int], weights: Sequence[float], least: Sequence[int]) -> list[int]:
    """The whole of the sizes shared by weight, but for shards that have to hold more than their share: these get the least they need."""
    total, weight = int(sum(sizes)), np.asarray(weights, float)
    need = np.resize(np.concatenate([np.asarray(least, np.int64), np.zeros(max(0, len(weight) - len(least)), np.int64)]), len(weight))
    fixed = np.zeros(len(weight), bool)
    while True:
        rest = total - int(need[fixed].sum())
        share = np.where(fixed, need, rest * weight / max(weight[~fixed].sum(), 1e-300))
        more = ~fixed & (need > share)
        if not more.any() or (fixed | more).all():
            break
        fixed |= more
    out = np.floor(share).astype(np.int64)
    order = np.argsort(-(share - out), kind="stable")
    out[order[: total - int(out.sum())]] += 1
    return out.tolist()


def pieces_of(blocks: Sequence[Block], flow: np.ndarray) -> list[Piece]:
    """The flow laid over the blocks: what stays comes first in a shard, and then what goes to each other one."""
    out: list[Piece] = []
    by_shard: dict[int, list[Block]] = {}
    for b in sorted(blocks, key=lambda b: (b.shard, b.name)):
        by_shard.setdefault(b.shard, []).append(b)
    for shard, own in by_shard.items():
        stays = int(flow[shard, shard]) if shard < flow.shape[1] else 0
        amounts = [(shard, stays)] + [(int(to), int(flow[shard, to])) for to in np.flatnonzero(flow[shard]) if to != shard]
        ends = np.cumsum([a for _, a in amounts])
        at, first = 0, 0
        for b in own:
            until = at + b.bytes
            while first < len(ends) - 1 and ends[first] <= at:
                first += 1
            here, begin, k = [], at, first
            while begin < until:
                end = until if k == len(ends) - 1 else min(until, int(ends[k]))
                if end > begin:
                    here.append(Piece(shard, b.name, begin - at, end - at, amounts[k][0]))
                begin, k = max(begin, end), k + 1
            out += here
            at = until
    return out


def lay_out(documents: DataFrame, folder: str, space: Workspace, shards: int = SHARDS, block_rows: int = BLOCK_ROWS) -> None:
    """Write documents (with a column text) to a folder of shards by hash of the text, and of blocks."""
    spark = documents.sparkSession
    whole = F.xxhash64(F.coalesce("text", F.lit("")), F.lit(SEED))
    identity = [F.col(c) for c in ("doc_id",) if c in documents.columns]
    marked = documents.withColumns({"layout_shard": F.pmod(whole, F.lit(shards)).cast("int"), "layout_key": F.xxhash64(*identity, whole, F.lit(SEED + 1)), "layout_bytes": stored_bytes(F.col("text"))})
    keys = space.keep(marked.groupBy("layout_shard", "layout_key").agg(F.count("*").alias("n")), "layout-keys")
    rows = {r.layout_shard: r.n for r in keys.groupBy("layout_shard").agg(F.sum("n").alias("n")).collect()}
    total = sum(rows.values())
    parts = [(s, max(1, min(-(-n // block_rows), MAX_BLOCKS * n // max(total, 1)))) for s, n in rows.items()]
    # keys of more rows than a block: at most MAX_BLOCKS of them, by the threshold
    many = keys.filter(F.col("n") > max(block_rows, total // MAX_BLOCKS)).select("layout_key", F.lit(True).alias("layout_many"))
    number = F.when(F.col("layout_many"), F.monotonically_increasing_id()).otherwise(0)
    dealt = (
        marked.join(F.broadcast(many), "layout_key", "left")
        .join(F.broadcast(spark.createDataFrame(parts, "layout_shard int, layout_parts int")), "layout_shard")
        .withColumn("layout_block", F.concat_ws("-", "layout_shard", F.pmod(F.xxhash64("layout_key", number), F.col("layout_parts"))))
    )
    columns = [c for c in documents.columns if c not in LAYOUT]
    dealt.select(*columns, "layout_bytes", "layout_shard", "layout_block").repartition("layout_shard", "layout_block").write.partitionBy("layout_shard", "layout_block").parquet(folder)


def opened(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def layout_schema(documents: DataFrame) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name not in LAYOUT]
    return ", ".join([*fields, "layout_bytes long", "layout_shard int", "layout_block string"])


def measured(layout: DataFrame) -> list[Block]:
    """The blocks with their bytes: one aggregation over a column of numbers."""
    rows = layout.groupBy("layout_shard", "layout_block").agg(F.sum("layout_bytes").alias("bytes"), F.max("layout_bytes").alias("largest")).collect()
    return [Block(r.layout_shard, r.layout_block, r.bytes, r.largest) for r in rows]


def rewrite(spark: SparkSession, folder: str, schema: str, pieces: Sequence[Piece]) -> int:
    """Write the blocks that move, whole or in parts, to their new shards, and then remove the old ones; the number of them."""
    by_block: dict[tuple[int, str], list[Piece]] = {}
    for p in pieces:
        by_block.setdefault((p.shard, p.name), []).append(p)
    whole = [(*key, own[0].to) for key, own in by_block.items() if len(own) == 1 and own[0].to != key[0]]
    split = [p for own in by_block.values() if len(own) > 1 for p in own]
    if not whole and not split:
        return 0
    layout = opened(spark, folder, schema)
    keys = ["layout_shard", "layout_block"]
    moved = layout.join(F.broadcast(spark.createDataFrame(whole, "layout_shard int, layout_block string, layout_to int")), keys)
    # in a split block the large documents come first, so that small ones are where amounts meet; a document goes with its middle
    parts = spark.createDataFrame([(p.shard, p.name, p.begin, p.end, p.to) for p in split], "layout_shard int, layout_block string, layout_begin long, layout_end long, layout_to int")
    least = Window.partitionBy(*keys)
    own = layout.join(F.broadcast(parts.select(*keys).distinct()), keys, "left_semi")
    order = least.orderBy(F.desc("layout_bytes"), F.xxhash64("text"), *(["doc_id"] if "doc_id" in layout.columns else []))
    middle = 2 * F.sum("layout_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("layout_bytes")
    own = own.withColumn("layout_middle", middle).join(F.broadcast(parts), keys).filter("layout_middle >= 2 * layout_begin AND layout_middle < 2 * layout_end")
    columns = [c for c in layout.columns if c not in keys]
    as_moved = lambda frame, name: frame.select(*columns, F.col("layout_to").alias("layout_shard"), name.alias("layout_block"))
    new = as_moved(moved, F.col("layout_block")).unionByName(as_moved(own, F.concat("layout_block", F.lit("."))))
    new.write.mode("append").partitionBy(*keys).parquet(folder)
    gone = [key[:2] for key in whole] + sorted({(p.shard, p.name) for p in split})
    for shard, name in gone:
        discard(spark, f"{folder}/layout_shard={shard}/layout_block={name}")
    return len(gone)


def reshard(spark: SparkSession, folder: str, schema: str, weights: Sequence[float], cost: np.ndarray | None = None) -> tuple[int, int]:
    """Bring the layout in a folder to shards of capacities by weight; bytes moved by the flows, and blocks rewritten.

    A document at the end of an amount goes as a whole, so what is left of it is solved again, until each shard is within `NEAR` of its
    capacity; with few and long documents that may not come, and it ends after `ROUNDS`.
    """
    if len(weights) > MAX_SHARDS:
        raise ValueError(f"more than {MAX_SHARDS} shards")
    moved = rewritten = 0
    for _ in range(ROUNDS):
        blocks = measured(opened(spark, folder, schema))
        count = max([len(weights), *(b.shard + 1 for b in blocks)])
        sizes, least = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for b in blocks:
            sizes[b.shard] += b.bytes
            least[b.shard] = max(least[b.shard], b.largest)
        want = np.zeros(count, np.int64)
        want[: len(weights)] = capacities_for(sizes, weights, least[: len(weights)])
        if (np.abs(sizes - want) <= NEAR * want).all():
            break
        flow = transfers(sizes, want, cost)
        moved += int(flow.sum() - np.trace(flow))
        rewritten += rewrite(spark, folder, schema, pieces_of(blocks, flow))
    return moved, rewritten


def reshard_query(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Each document's shard and slot after the shards by hash are levelled, read back from the files."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Workspace(spark) as space:
        folder, schema = space.path("shards"), layout_schema(docs)
        lay_out(docs, folder, space, shards)
        reshard(spark, folder, schema, [1.0] * shards)
        stored = opened(spark, folder, schema)
        rows = stored.select("doc_id", stored_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.col("layout_shard").alias("shard"), F.col("layout_block").alias("block"))
        begin, before = [], dict.fromkeys(range(shards), 0)
        for r in sorted(stored.groupBy("layout_shard", "layout_block").agg(F.count("*").alias("n")).collect()):
            begin.append((r.layout_shard, r.layout_block, before[r.layout_shard]))
            before[r.layout_shard] += r.n
        begins = F.broadcast(spark.createDataFrame(begin, "shard int, block string, first long"))
        order = Window.partitionBy("shard", "block").orderBy("text_crc32", "doc_id", "size")
        placed = rows.withColumn("place", F.row_number().over(order)).join(begins, ["shard", "block"])
        out = placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
        return space.result(out, "reshard-result")
