"""Connected components of a graph of long ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import sent, stored

#: Smallest neighbours (some 30 bytes each) that may be sent to every task.
BROADCAST_ROWS = 500_000


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v; long) to (id, component): the smallest id that can be reached. Ids without an edge have no row.

    Each round is two joins on ids and writes its edges to the shared folder; rounds grow with the logarithm of the
    longest path. The smallest neighbours of all ids are a table of their own: few are sent to the edges, many are
    joined by a shuffle in which Spark splits a hub's edges.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = stored(edges, "edges")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sent(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "low", BROADCAST_ROWS)
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large")
        low = sent(large.groupBy("u").agg(F.min("v").alias("m")), "low", BROADCAST_ROWS)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
