"""Entropy and mutual information of two columns, for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, value: str, grp: str) -> DataFrame:
    n = df.groupBy(grp, value).agg(F.count(F.lit(1)).alias("n"))
    return n.select(grp, value, (F.col("n") / F.sum("n").over(Window.partitionBy(grp))).alias("p"))


def entropy(df: DataFrame, value: str, grp: str) -> DataFrame:
    """-sum p log2 p."""
    return distribution(df, value, grp).groupBy(grp).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def _digitized(df: DataFrame, x: str, grp: str) -> DataFrame:
    """``bx``: 1 .. nb of nb = n / 10 equal bins between the group's ends, the largest value alone in nb + 1."""
    ends = df.groupBy(grp).agg(F.min(x).alias("__a"), F.max(x).alias("__b"), F.floor(F.count(x) / 10).alias("__nb"))
    rows = df.join(ends, grp)
    nb = F.greatest(F.col("__nb"), F.lit(1))
    bin_ = F.when(F.col(x) >= F.col("__b"), nb + 1).otherwise(F.floor((F.col(x) - F.col("__a")) / (F.col("__b") - F.col("__a")) * nb) + 1)
    return rows.withColumn("bx", bin_.cast("long")).drop("__a", "__b", "__nb")


def conditional_entropy(df: DataFrame, x: str, y: str, grp: str) -> DataFrame:
    """H(y | x) in bits."""
    rows = _digitized(df, x, grp).groupBy(grp, "bx", y).agg(F.count(F.lit(1)).alias("n"))
    px = F.sum("n").over(Window.partitionBy(grp, "bx"))
    all_ = F.sum("n").over(Window.partitionBy(grp))
    rows = rows.withColumns({"px": px / all_, "pxy": F.col("n") / all_})
    return rows.groupBy(grp).agg(F.sum(F.col("pxy") * F.log2(F.col("px") / F.col("pxy"))).alias("conditional_entropy"))


def mutual_information(df: DataFrame, x: str, y: str, grp: str) -> DataFrame:
    """H(y) - H(y | x) in bits."""
    both = entropy(df, y, grp).join(conditional_entropy(df, x, y, grp), grp)
    return both.select(grp, (F.col("entropy") - F.col("conditional_entropy")).alias("mutual_information"))


def mutual_information_hist2d(df: DataFrame, x: str, y: str, grp: str, bins: int = 10) -> DataFrame:
    """In nats, from equal-width bins of both columns between the group's ends, the last closed."""
    ends = df.groupBy(grp).agg(*[f(c).alias(n) for c, n0, n1 in ((x, "xa", "xb"), (y, "ya", "yb")) for f, n in ((F.min, n0), (F.max, n1))])
    rows = df.join(ends, grp)
    cut = lambda c, a, b: F.when(F.col(a) == F.col(b), F.lit(0)).otherwise(F.least(F.floor((F.col(c) - F.col(a)) / (F.col(b) - F.col(a)) * bins), F.lit(bins - 1)))
    n = rows.select(grp, cut(x, "xa", "xb").alias("bx"), cut(y, "ya", "yb").alias("by")).groupBy(grp, "bx", "by").agg(F.count(F.lit(1)).alias("n"))
    s = lambda *p: F.sum("n").over(Window.partitionBy(grp, *p))
    n = n.withColumns({"nx": s("bx"), "ny": s("by"), "nn": s()})
    return n.groupBy(grp).agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")))).alias("mutual_information"))
