"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts cannot be divided. Differencing keeps partial partitions, each with a size for every shard;
it takes the two of largest spread, adds the largest part of one to the smallest of the other and so on, and puts the
sum back, until one is left. One run of that needs all items in one place, so it runs in levels: items are dealt into
blocks of bounded size, each block differences its items into parcels, the parcels are the items of the next level,
and when few enough are left one last run deals them into the shards. An item far above the mean ends as a parcel
almost alone, so the last run still sees it and balances it; and parcels come in three sizes, each a tenth of the one
before, so that the last run has small ones to even out the rest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import bucket_of, ranked, stored

#: Items of one differencing run at most (in the mean of the hashed blocks), and items per parcel; but a level leaves
#: half a block of parcels at least.
BLOCK = 16_384
REDUCE = 64
#: Shares of a block's items that go into parcels of each size.
TIERS = (0.9, 0.09, 0.01)


def difference(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part 0..parts-1 of each item. Ties go by item order, so the result depends on the input alone."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if parts == 1:
        return np.zeros(n, dtype=np.int64)
    # A node is a partial partition: its part sizes in falling order, less the smallest, which moves no spread.
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    held: dict[int, np.ndarray] = {}
    children: dict[int, tuple[int, int, np.ndarray]] = {}

    def vector(node: int) -> np.ndarray:
        if node >= n:
            return held.pop(node)
        v = np.zeros(parts, dtype=np.int64)
        v[0] = sizes[node]
        return v

    for new in range(n, 2 * n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = vector(a) + vector(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        held[new] = total
        children[new] = (a, b, order.astype(np.int32))
        heapq.heappush(heap, (-int(total[0]), new))
    part = np.zeros(n, dtype=np.int64)
    todo = [(2 * n - 2, np.arange(parts, dtype=np.int32))]
    while todo:
        node, at = todo.pop()  # at[k]: the part that the node's k-th largest sum lies in
        if node < n:
            part[node] = at[0]
            continue
        a, b, order = children.pop(node)
        slot = np.empty(parts, dtype=np.int32)
        slot[order] = at
        todo.append((a, slot))
        todo.append((b, slot[::-1]))
    return part


def tiered(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The parcel of each item: the items are dealt into TIERS by their place, and each tier is differenced by itself."""
    n, own = len(sizes), max(1, parts // len(TIERS))
    tier = np.searchsorted(np.cumsum(TIERS)[:-1], (np.arange(n) * 0.6180339887498949) % 1.0, "right")
    part = np.zeros(n, dtype=np.int64)
    for t in range(len(TIERS)):
        at = np.flatnonzero(tier == t)
        part[at] = difference(sizes[at], min(own, max(1, len(at)))) + t * own
    return part


def _block(split):
    def run(key, table):
        table = table.sort_by([("size", "descending"), ("item", "ascending")])
        part = split(table.column("size").to_numpy())
        return pa.table({"item": table.column("item"), "size": table.column("size"), "block": table.column("block"), "part": pa.array(part)})

    return run


_OUT = "item string, size long, block long, part long"


def deal(items: DataFrame, shards: int, block: int = BLOCK, reduce: int = REDUCE) -> DataFrame:
    """``item`` (string, distinct), ``size`` (long) to ``item``, ``shard``."""
    items = stored(items.select("item", "size"), "items")
    levels: list[DataFrame] = []
    n = items.count()
    while n > block:
        blocks = -(-n // block)
        dealt = items.withColumn("block", bucket_of(blocks, "item").cast("long"))
        parts = -(-max(n // reduce, block // 2) // blocks)
        dealt = stored(dealt.groupBy("block").applyInArrow(_block(lambda sizes, parts=parts: tiered(sizes, parts)), _OUT), "level")
        dealt = dealt.withColumn("parcel", F.concat_ws(":", F.lit(len(levels)), "block", "part"))
        levels.append(dealt.select("item", "parcel"))
        items = stored(dealt.groupBy("parcel").agg(F.sum("size").alias("size")).select(F.col("parcel").alias("item"), "size"), "items")
        n = items.count()
    last = items.withColumn("block", F.lit(0).cast("long"))  # at most `block` items, whatever the input
    out = last.groupBy("block").applyInArrow(_block(lambda sizes: difference(sizes, shards)), _OUT).select("item", F.col("part").cast("int").alias("shard"))
    for level in reversed(levels):
        out = level.join(out.select(F.col("item").alias("parcel"), "shard"), "parcel").select("item", "shard")
    return out


def shard_by_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, row_bytes: int = 16, block: int = BLOCK, reduce: int = REDUCE) -> DataFrame:
    """Per row: ``key``, ``size``, ``text_crc32``, ``shard``, ``slot``. Rows of equal text share a shard.

    size: UTF-8 bytes of the text and ``row_bytes``; a null text counts as an empty one, and groups with it. Repeated
    rows each get a slot. Slots are gapless from 0 in each shard. An empty table gives an empty result; a null key is
    a row like others. Other columns are ignored, whatever their names. A group's rows are counted where they are
    (partial sums), and a group of any size costs one row in what follows; Spark splits its rows in the join back.
    """
    text_c = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), (F.octet_length(text_c) + row_bytes).cast("long").alias("size"), F.crc32(text_c.cast("binary")).alias("text_crc32"), F.md5(text_c.cast("binary")).alias("item"))
    rows = stored(rows, "sizes")
    groups = rows.groupBy("item").agg(F.sum("size").alias("size"))
    dealt = rows.join(deal(groups, shards, block, reduce), "item").select("key", "size", "text_crc32", "shard")
    out = ranked(dealt, "shard", ["key", "text_crc32", "size"], "slot")
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")
