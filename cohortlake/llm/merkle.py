"""Merkle manifest of a dataset by cogrouped subtree exchange.

Leaves of a source stand in the order of their key; every three nodes in a row have one parent. A superblock is the
subtree over 3^6 = 729 leaves in a row. Upwards, each superblock is reduced to its top node, and the top nodes are
the leaves of the next round, so a source of any size is never in one task; the sources' own roots are the leaves of one
more tree. Downwards, the nodes of each superblock and what its top node needs from outside (the siblings on the way to
the root) are cogrouped: one function finishes the local reduction, joins local and outer siblings to each node's proof,
and at the leaves folds the proofs.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import places, stored

ARITY = 3
#: Levels of a superblock, of 729 leaves; its task holds them and their proofs (some 2 KB each) at a time.
LEVELS = 6
HEX = 64  # characters of a digest

_NODES = "g long, n long, at long, hash string"
_OUTER = "g long, at long, pos array<int>, sibs array<string>, subroot string, root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each `-` if null, else its UTF-8 bytes' number, `:`, and its text."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def reduce_levels(hashes: list[str], n: int, depth: int = LEVELS) -> list[list[str]]:
    """The levels of a superblock from its leaves to its top. In a tree of ``n`` nodes that fills several superblocks all
    of them have ``depth`` steps, however few nodes the last one has; else the steps end at one node."""
    levels = [hashes]
    while len(levels) <= depth if n > ARITY**depth else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[str]], i: int) -> tuple[list[int], list[str]]:
    """For leaf ``i``, level by level: its place in its run, and the run's other digests end to end."""
    pos, sibs = [], []
    for level in levels[:-1]:
        low = i - i % ARITY
        pos.append(i - low)
        sibs.append("".join(level[low:i] + level[i + 1 : low + ARITY]))
        i //= ARITY
    return pos, sibs


def fold(leaf: str, pos, sibs) -> str:
    """The root that a leaf and its siblings give."""
    for p, s in zip(pos, sibs, strict=True):
        leaf = digest(s[: HEX * p] + leaf + s[HEX * p :])
    return leaf


def _up(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of superblocks to their top nodes."""
    block = ARITY**depth

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        g, n, at = (int(pdf[c].iloc[0]) for c in ("g", "n", "at"))
        return pd.DataFrame({"g": [g], "n": [-(-n // block)], "at": [at // block], "hash": [reduce_levels(pdf["hash"].tolist(), n, depth)[-1][0]]})

    nodes = nodes.select("g", "n", "at", "hash", F.floor(F.col("at") / block).alias("block"))
    return stored(nodes.groupBy("g", "block").applyInPandas(run, _NODES), "nodes")


def _tops(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """``nodes`` and the top nodes of each round, until every tree has one."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(_up(out[-1], depth))
    return out


def _exchange(nodes: DataFrame, outer: DataFrame, depth: int, finish, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Cogroups the superblocks of ``nodes`` with the outer proofs of their top nodes."""

    def run(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own, top = own.sort_values("at"), above.iloc[0]
        levels = reduce_levels(own["hash"].tolist(), int(own["n"].iloc[0]), depth)
        outside = list(top["pos"]), list(top["sibs"])
        paths = [tuple(a + b for a, b in zip(siblings(levels, i), outside, strict=True)) for i in range(len(own))]
        return finish(own, paths, top)

    own = nodes.select("g", "n", "at", "hash", *extra, F.floor(F.col("at") / ARITY**depth).alias("block"))
    return own.groupBy("g", "block").cogroup(outer.withColumnRenamed("at", "block").groupBy("g", "block")).applyInPandas(run, schema)


def _inner(own: pd.DataFrame, paths: list, top: pd.Series) -> pd.DataFrame:
    """Outer proofs for the superblocks below."""
    return pd.DataFrame({"g": own["g"].to_numpy(), "at": own["at"].to_numpy(), "pos": [p for p, _ in paths], "sibs": [s for _, s in paths], "subroot": top["subroot"], "root": top["root"]})


def _leaves(own: pd.DataFrame, paths: list, top: pd.Series) -> pd.DataFrame:
    """Proofs, and what they give from the leaves shown."""
    out = own[["key", "at"]].assign(leaf=own["hash"], shown=own["shown"], subroot=top["subroot"], root=top["root"])
    return out.assign(pos=[p for p, _ in paths], sibs=[s for _, s in paths], folded_root=[fold(x, *path) for x, path in zip(own["shown"], paths, strict=True)])


def manifest(df: DataFrame, fields: dict[str, Column], shown: dict[str, Column] | None = None, key: str = "doc_id", by: str = "source", depth: int = LEVELS) -> DataFrame:
    """Per row: ``key``, its place ``at`` among the leaves of its ``by``, ``leaf``, ``shown`` (the leaf to be proved),
    ``subroot``, ``root``, the proof (``pos``: place in the run, ``sibs``: the run's others end to end, level by level),
    and ``folded_root``, what the proof gives from ``shown``.

    ``fields`` are hashed in their order; ``shown`` holds those that are to be proved instead, where they differ. Any
    field may be null. A null ``by`` is a source like others, before them; a null key comes before others, rows of equal
    keys stand by their leaves, and equal rows are a leaf each. Texts may be empty or of any length: they are hashed
    where they are read, and only digests are shuffled. Other columns are ignored, whatever their names; an empty table
    gives an empty result. ``depth``: levels of a superblock, of 3^depth leaves; the result is the same.
    """
    rows = df.select(F.col(by).alias("by"), F.col(key).alias("key"), leaf_of(list(fields.values())).alias("hash"), leaf_of(list((fields | (shown or {})).values())).alias("shown"))
    leaves = stored(places(rows, "by", ["key", "hash"]).drop("by"), "leaves")
    inside = _tops(leaves, depth)
    tops = inside[-1].select(F.col("g").alias("source"), "hash", F.lit(0).alias("all"))
    sources = stored(places(tops, "all", ["source"]).drop("all"), "sources")
    above = _tops(sources, depth)
    outer = above[-1].filter("n = 1").select(F.lit(0).cast("long").alias("g"), "at", F.array().cast("array<int>").alias("pos"), F.array().cast("array<string>").alias("sibs"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    if len(above) > 1:
        for nodes in reversed(above[1:-1]):
            outer = _exchange(nodes, outer, depth, _inner, _OUTER)
        outer = stored(_exchange(sources, outer, depth, _inner, _OUTER), "outer")
    outer = sources.select("source", "at", "hash").join(outer.select("at", "pos", "sibs", "root"), "at")
    outer = outer.select(F.col("source").alias("g"), F.lit(0).cast("long").alias("at"), "pos", "sibs", F.col("hash").alias("subroot"), "root")
    for nodes in reversed(inside[1:-1]):
        outer = stored(_exchange(nodes, outer, depth, _inner, _OUTER), "outer")
    kind = df.schema[key].dataType.simpleString()
    out = _exchange(leaves, outer, depth, _leaves, f"key {kind}, at long, leaf string, shown string, subroot string, root string, pos array<int>, sibs array<string>, folded_root string", ("key", "shown"))
    return out.withColumnRenamed("key", key)
