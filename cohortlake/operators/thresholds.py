"""Histograms, robust limits and thresholds, for many groups at once. Tables: (grp, feature_id, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.sizes import small
from cohortlake.operators.tables import stored

BINS, PASSES = 1000, 10


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    per = F.lit(float(bins)) / (high - low)
    raw = (value * per - low * per).cast("long")  # towards 0
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int")


def value_histogram(values: DataFrame, low: float, high: float, bins: int, mask: str | None = None) -> DataFrame:
    """(grp, bin, n): equal bins from ``low`` to ``high``; what lies outside counts in the end bins."""
    rows = values.filter(F.col(mask) > 0.5) if mask else values
    return rows.withColumn("bin", _bin(F.col("value"), F.lit(float(low)), F.lit(float(high)), bins)).groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))


def robust_limits(values: DataFrame, mask: Column | None = None) -> DataFrame:
    """(grp, t2, t98): the 2 % and 98 % limits, by a histogram that is zoomed in while it is too coarse.

    One pass is one partial aggregate of the values to at most BINS rows a group; groups that are done drop out.
    A group without values has no row; one of equal values has (min, max).
    """
    values = (values.filter(mask) if mask is not None else values).select("grp", F.col("value").cast("double").alias("value")).filter("value is not null and not isnan(value)")
    state = values.groupBy("grp").agg(F.min("value").alias("all_lo"), F.max("value").alias("all_hi"), F.count(F.lit(1)).alias("n"))
    state = state.withColumns({"lo": F.col("all_lo"), "hi": F.col("all_hi"), "bottom": F.lit(0), "top": F.lit(0)})
    done = None
    for jump in range(1, PASSES + 1):
        if jump > 1:
            low = F.greatest(F.col("bottom") - 1, F.lit(0))
            high = F.least(F.col("top") + 1, F.lit(BINS - 1))
            width = F.col("hi") - F.col("lo")
            state = state.withColumns({"new_lo": F.col("lo") + low / F.lit(float(BINS)) * width, "new_hi": F.col("lo") + (high + 1) / F.lit(float(BINS)) * width})
            reset = F.lit(jump == PASSES) | (F.col("new_lo") == F.col("new_hi"))
            state = state.withColumn("lo", F.when(reset, F.col("all_lo")).otherwise(F.col("new_lo"))).withColumn("hi", F.when(reset, F.col("all_hi")).otherwise(F.col("new_hi"))).drop("new_lo", "new_hi")
        flat = state.filter("lo = hi").select("grp", F.col("all_lo").alias("t2"), F.col("all_hi").alias("t98"))
        state = state.filter("lo <> hi").select("grp", "all_lo", "all_hi", "n", "lo", "hi")
        hist = values.join(small(state), "grp").withColumn("bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), BINS)).groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in ("all_lo", "all_hi", "n", "lo", "hi")])
        ends = F.lit(0)
        if jump == PASSES:
            both = Window.partitionBy("grp")
            ends = F.sum(F.when(F.col("bin").isin(0, BINS - 1), F.col("c")).otherwise(0)).over(both)
            hist = hist.withColumn("need", (F.col("n") - ends) / 50.0).filter(~F.col("bin").isin(0, BINS - 1))
        else:
            hist = hist.withColumn("need", F.col("n") / 50.0)
        up = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy("grp").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("below", F.sum("c").over(up)).withColumn("above", F.sum("c").over(down))
        found = hist.groupBy("grp").agg(
            F.coalesce(F.min(F.when(F.col("below") >= F.col("need"), F.col("bin"))), F.lit(BINS - 1)).alias("bottom"),
            F.coalesce(F.max(F.when(F.col("above") >= F.col("need"), F.col("bin"))), F.lit(0)).alias("top"),
            *[F.first(x).alias(x) for x in ("all_lo", "all_hi", "n", "lo", "hi")],
        )
        step = (F.col("hi") - F.col("lo")) / F.lit(float(BINS))
        found = found.withColumn("t2", F.col("lo") + F.col("bottom") * step).withColumn("t98", F.col("lo") + (F.col("top") + 1) * step)
        found = stored(found, "limits")  # one row for each group
        more = (F.col("t98") - F.col("t2")) < (F.col("hi") - F.col("lo")) / 10.0
        stop = found.filter(~more) if jump < PASSES else found
        done = flat.union(stop.select("grp", "t2", "t98")) if done is None else done.union(flat).union(stop.select("grp", "t2", "t98"))
        state = found.filter(more)
        if jump < PASSES and state.isEmpty():
            break
    return done


def robust_min(values: DataFrame, mask: Column | None = None) -> DataFrame:
    return robust_limits(values, mask).select("grp", F.col("t2").alias("value"))


def robust_max(values: DataFrame, mask: Column | None = None) -> DataFrame:
    return robust_limits(values, mask).select("grp", F.col("t98").alias("value"))


def robust_range_threshold(values: DataFrame, thr: float) -> DataFrame:
    """Values under t2 + thr % of (t98 - t2) become 0; limits over values above 0."""
    limits = robust_limits(values, F.col("value") > 0)
    low = F.col("t2") + F.lit(thr / 100.0) * (F.col("t98") - F.col("t2"))
    return values.join(limits, "grp", "left").withColumn("value", F.when(F.col("value") >= low, F.col("value")).otherwise(0.0)).drop("t2", "t98")


def rank_threshold(values: DataFrame, thr: float) -> DataFrame:
    """The floor(n thr / 100) - 1 smallest values of a group become 0; equal values go by feature_id.

    Ranks come from ranges of the value, so one group of any size is spread over tasks.
    """
    n = values.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    limit = F.greatest(F.floor(F.col("n") * thr / 100.0) - 1, F.lit(0))
    ranked = _group_ranks(values)
    return ranked.join(F.broadcast(n) if n.limit(100_001).count() <= 100_000 else n, "grp").withColumn("value", F.when(F.col("rank") <= limit, F.lit(0.0)).otherwise(F.col("value"))).drop("rank", "n")


def _group_ranks(values: DataFrame, ranges: int = 64) -> DataFrame:
    """``rank`` 1, 2, ... within grp by (value, feature_id): ranked within ranges of the value, whose ends are the
    group's approximate quantiles, after the counts of the ranges before. Equal values share a range."""
    ends = values.groupBy("grp").agg(F.percentile_approx("value", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000).alias("__ends"))
    parts = values.join(small(ends, 100_000), "grp").withColumn("__p", F.size(F.filter("__ends", lambda e: e < F.col("value")))).drop("__ends")
    inside = F.row_number().over(Window.partitionBy("grp", "__p").orderBy("value", "feature_id"))
    counts = parts.groupBy("grp", "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("grp").orderBy("__p")) - F.col("__c")
    counts = counts.select("grp", "__p", before.alias("__before"))
    return parts.withColumn("__in", inside).join(counts, ["grp", "__p"]).withColumn("rank", F.col("__in") + F.col("__before")).drop("__p", "__in", "__before")


def percentile_threshold(values: DataFrame, thr: float) -> DataFrame:
    """Values under the group's percentile (linear interpolation), and NaN, become 0.

    The percentile lies between two neighbours by rank, and is their value to the last bit where they are equal. Ranks
    come from ranges of the value, so one group of any size is spread over tasks.
    """
    clean = values.filter("value is not null and not isnan(value)")
    n = clean.groupBy("grp").agg((F.lit(thr / 100.0) * (F.count(F.lit(1)) - 1)).alias("__at"))
    near = _group_ranks(clean.select("grp", "value", "feature_id")).join(n, "grp").withColumn("__off", F.col("rank") - 1 - F.col("__at")).filter("__off > -1 and __off < 1")
    low, high = F.max(F.when(F.col("__off") <= 0, F.col("value"))), F.min(F.when(F.col("__off") >= 0, F.col("value")))
    share = F.max("__at") - F.floor(F.max("__at"))
    cut = near.groupBy("grp").agg(F.when(share == 0, low).otherwise(low + (high - low) * share).alias("__cut"))
    return values.join(cut, "grp", "left").withColumn("value", F.when((F.col("value") >= F.col("__cut")) & ~F.isnan("value"), F.col("value")).otherwise(0.0)).drop("__cut")


def apply_threshold(values: DataFrame, method: str, thr: float) -> DataFrame:
    """``method``: robust, rank or percentile; '' or none leaves the values."""
    known = {"robust": robust_range_threshold, "rank": rank_threshold, "percentile": percentile_threshold}
    return values if method in ("", "none", None) else known[method](values, thr)
