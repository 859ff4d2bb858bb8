"""Feature statistics and selection over long tables: features (sample_id, feature_id, value), labels (sample_id, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.operators.aggregates import Mergeable, aggregate, distance
from cohortlake.operators.sizes import small
from cohortlake.operators.tables import places, stored
from cohortlake.operators.thresholds import apply_threshold


def sample_stats(features: DataFrame, key: str = "sample_id") -> DataFrame:
    """Max, min, mean, population variance, median, excess kurtosis and skewness (both biased) of each sample."""
    v = F.col("value")
    return features.groupBy(key).agg(F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.median(v).alias("median"), F.kurtosis(v).alias("kurtosis"), F.skewness(v).alias("skewness"))


def hist3d(points: DataFrame, bins: int, complete: bool = True) -> DataFrame:
    """Points (sample_id, x, y, z) to (sample_id, bx, by, bz, n): bins between the sample's own ends, the last closed."""
    axes = ("x", "y", "z")
    ends = points.groupBy("sample_id").agg(*[F.min(a).alias(f"{a}0") for a in axes], *[F.max(a).alias(f"{a}1") for a in axes])
    rows = points.join(ends, "sample_id")
    for a in axes:
        low = F.when(F.col(f"{a}0") == F.col(f"{a}1"), F.col(f"{a}0") - 0.5).otherwise(F.col(f"{a}0"))
        high = F.when(F.col(f"{a}0") == F.col(f"{a}1"), F.col(f"{a}1") + 0.5).otherwise(F.col(f"{a}1"))
        rows = rows.withColumn(f"b{a}", F.least(F.floor((F.col(a) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int"))
    found = rows.groupBy("sample_id", "bx", "by", "bz").agg(F.count(F.lit(1)).alias("n"))
    if not complete:
        return found
    grid = ends.select("sample_id")
    for a in axes:
        grid = grid.withColumn(f"b{a}", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(found, ["sample_id", "bx", "by", "bz"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def moments(features: DataFrame, labels: DataFrame, by: tuple[str, ...] = ("feature_id", "y")) -> DataFrame:
    """n, mean and M2 (n times the population variance) of each feature and class, in one pass."""
    rows = features.join(labels, "sample_id")
    return rows.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))


def merged(m: DataFrame, by: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """Moments of several classes or folds as one."""
    w = Window.partitionBy(*by)
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    return m.withColumn("__g", grand).groupBy(*by).agg(F.sum("n").alias("n"), F.first("__g").alias("mean"), F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("__g"), 2)).alias("m2"))


def train_moments(by_fold: DataFrame, by: tuple[str, ...] = ("feature_id", "y")) -> DataFrame:
    """Moments of all rows outside each fold, from the moments of the folds: each feature's rows are read once."""
    folds = by_fold.select(F.col("fold").alias("test_fold")).distinct()
    others = by_fold.crossJoin(small(folds, 100_000)).filter("fold <> test_fold").drop("fold").withColumnRenamed("test_fold", "fold")
    return merged(others, ("fold", *by))


def pearson_features(m: DataFrame, by: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """(*by, measure): correlation of value and y, from moments by class; NaN is 0. ``by`` may hold a fold too."""
    w = Window.partitionBy(*by)
    n = F.sum("n").over(w)
    gx, gy = F.sum(F.col("n") * F.col("mean")).over(w) / n, F.sum(F.col("n") * F.col("y")).over(w) / n
    rows = m.withColumns({"gx": gx, "gy": gy})
    dx, dy = F.col("mean") - F.col("gx"), F.col("y") - F.col("gy")
    s = rows.groupBy(*by).agg(F.sum(F.col("n") * dx * dy).alias("xy"), F.sum(F.col("m2") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("n") * dy * dy).alias("yy"))
    return s.select(*by, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0).alias("measure"))


def _pairs(m: DataFrame, by: tuple[str, ...]) -> DataFrame:
    s = m.select(*by, "y", "n", "mean", (F.col("m2") / F.col("n")).alias("v"))
    a = s.select(*by, *[F.col(c).alias(f"{c}_a") for c in ("y", "n", "mean", "v")])
    b = s.select(*by, *[F.col(c).alias(f"{c}_b") for c in ("y", "n", "mean", "v")])
    return a.join(b, list(by)).filter("y_a < y_b")


def bhattacharyya_features(m: DataFrame, by: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """Largest Bhattacharyya distance over the pairs of classes, 0 at least; what is not finite is 0."""
    va, vb = F.col("v_a"), F.col("v_b")
    d = F.when((va > 0) & (vb > 0), 0.25 * F.pow(F.col("mean_a") - F.col("mean_b"), 2) / (va + vb) + 0.5 * F.log((va + vb) / (2 * F.sqrt(va) * F.sqrt(vb)))).otherwise(0.0)
    return _pairs(m, by).groupBy(*by).agg(F.greatest(F.max(d), F.lit(0.0)).alias("measure"))


def welch_features(m: DataFrame, variant: str = "reference", by: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """Largest signed t over the pairs of classes, 0 at least.

    ``variant``: "reference" divides by sqrt(var_a^2 / n_a + var_b^2 / n_b), "standard" by sqrt(var_a / n_a + var_b / n_b).
    """
    p = 2 if variant == "reference" else 1
    e = F.sqrt(F.pow("v_a", F.lit(p)) / F.col("n_a") + F.pow("v_b", F.lit(p)) / F.col("n_b"))
    t = F.when(e > 0, (F.col("mean_a") - F.col("mean_b")) / e).otherwise(0.0)
    return _pairs(m, by).groupBy(*by).agg(F.greatest(F.max(t), F.lit(0.0)).alias("measure"))


def measure_features(m: DataFrame, method: str, by: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """(*by, measure) from moments (*by, y, n, mean, m2). ``method``: pearson (absolute), bhattacharyya or welcht."""
    if method == "pearson":
        return pearson_features(m, by).withColumn("measure", F.abs("measure"))
    return {"bhattacharyya": bhattacharyya_features, "welcht": welch_features}[method](m, by=by)


def distance_features(features: DataFrame, labels: DataFrame, measure) -> DataFrame:
    """(feature_id, measure): a distance between a feature's values and y; NaN is 0.

    ``measure`` is the name of a distance of ``aggregates.distance``; or a ``Mergeable`` over rows (value, y), whose first
    element counts: in both no task has a whole feature. Or any callable(values, y), values by sample_id: it gets one whole
    feature at a time in a task, and again the first element counts.
    """
    rows = features.join(labels, "sample_id").select("feature_id", "sample_id", "value", F.col("y").cast("double").alias("y"))
    clean = lambda c: F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c).alias("measure")
    if isinstance(measure, str):
        return rows.groupBy("feature_id").agg(distance(measure, F.col("value"), F.col("y")).alias("m")).select("feature_id", clean(F.col("m")))
    if isinstance(measure, Mergeable):
        return aggregate(rows, ["feature_id"], ["value", "y"], measure).select("feature_id", clean(F.element_at("value", 1)))
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = float(np.ravel(measure(pdf["value"].to_numpy(), pdf["y"].to_numpy()))[0])
        return pd.DataFrame({"feature_id": pdf["feature_id"].iloc[:1], "measure": [0.0 if np.isnan(d) else d]})

    return rows.groupBy("feature_id").applyInPandas(lambda p: run(p.sort_values("sample_id")), f"feature_id {features.schema['feature_id'].dataType.simpleString()}, measure double")


def feature_selection(features: DataFrame, labels: DataFrame, method: str, thr_method: str = "", thr: float = 95.0, measure=None) -> DataFrame:
    """(feature_id, measure) after the threshold. A measure that is 0 everywhere stays as it is.

    ``method``: pearson (absolute), bhattacharyya, welcht, '' (all features measure 1), or "distance" (by ``measure``, see
    ``distance_features``).
    """
    if method == "distance":
        out = distance_features(features, labels, measure)
    elif method == "":
        out = features.select("feature_id").distinct().withColumn("measure", F.lit(1.0))
    else:
        out = measure_features(moments(features, labels), method)
    if not thr_method:
        return out
    rows = out.select(F.lit(0).alias("grp"), "feature_id", F.col("measure").alias("value"))
    cut = apply_threshold(rows, thr_method, thr).select("feature_id", F.col("value").alias("measure"))
    some = out.agg(F.max(F.abs("measure")).alias("m")).first()["m"]
    return cut if some else out


def create_feature_sets(features: DataFrame, method: str, bins: int | None = None) -> DataFrame:
    """'stats', 'hist3d' (with bins; columns x, y, z) or 'none' of the masked features."""
    if method == "stats":
        return sample_stats(features)
    if method == "hist3d":
        if bins is None:
            raise ValueError("hist3d needs bins")
        return hist3d(features, bins)
    return features


# scaling, folds, labels


def standardize(features: DataFrame, train: DataFrame | None = None, by: str = "feature_id") -> DataFrame:
    """(x - mean) / std of the population, fitted on ``train`` (else on all); a std of 0 counts as 1."""
    s = (features if train is None else train).groupBy(by).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    return features.join(s, by).withColumn("value", (F.col("value") - F.col("__m")) / F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s"))).drop("__m", "__s")


def minmax_scale(features: DataFrame, by: str = "feature_id") -> DataFrame:
    s = features.groupBy(by).agg(F.min("value").alias("__a"), F.max("value").alias("__b"))
    width = F.col("__b") - F.col("__a")
    return features.join(s, by).withColumn("value", F.when(width == 0, 0.0).otherwise((F.col("value") - F.col("__a")) / width)).drop("__a", "__b")


def encode_labels(samples: DataFrame, column: str = "score", into: str = "y") -> DataFrame:
    """0 .. n-1 in sorted order of the distinct labels, joined back; null has no code."""
    codes = places(samples.select(column).filter(F.col(column).isNotNull()).distinct(), None, [column], at=into).select(column, F.col(into).cast("int").alias(into))
    return samples.join(small(codes), column, "left")


def assign_folds(samples: DataFrame, k: int, kind: str = "stratified") -> DataFrame:
    """``fold``: 'stratified' (place in the class, modulo k), 'plain' (k blocks by sample_id, the first ones larger by one
    where they are not equal) or 'loo'. Classes and tables of any size: places come from ranges."""
    ranked = places(samples, "y" if kind == "stratified" else None, ["sample_id"], "__at", "__n", "__g")
    at, n = F.col("__at"), F.col("__n")
    if kind == "stratified":
        fold = at % k
    elif kind == "loo":
        fold = at
    else:
        size, larger = F.floor(n / k), n % k
        wide = larger * (size + 1)
        fold = F.when(at < wide, F.floor(at / (size + 1))).otherwise(larger + F.floor((at - wide) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("__at", "__n", "__g")


def spread(items: DataFrame, num: int, order: str) -> DataFrame:
    """``num`` equally spaced rows: those at ceil(i n / num)."""
    ranked = places(items, None, [order], "pos", "__n", "__g")
    # the i of which a place is ceil(i n / num) is the last at or before pos num / n
    i = F.floor(F.col("pos") * num / F.col("__n"))
    return ranked.filter(F.ceil(i * F.col("__n") / F.lit(num)) == F.col("pos")).drop("__n", "__g").withColumn("pos", F.col("pos").cast("int"))


def takespread(items: DataFrame, num: int, order: str) -> list:
    """The values of ``order`` of ``num`` equally spaced rows, in order: ``num`` of them come to the driver."""
    return [r[0] for r in spread(items, num, order).orderBy("pos").select(order).collect()]


def makespread(items: DataFrame, num: int, order: str) -> DataFrame:
    """``items`` with ``chosen``: whether a row is one of ``num`` equally spaced ones."""
    picked = spread(items, num, order).select(F.col(order).alias("__o"), F.lit(True).alias("__c"))
    return items.join(small(picked), F.col(order) == F.col("__o"), "left").withColumn("chosen", F.coalesce("__c", F.lit(False))).drop("__o", "__c")


def fill_grid(table: DataFrame, index: list[str], value: str, fill: float | None = 0.0, how: str = "constant") -> DataFrame:
    """All combinations of each index's range (integers) or values, with ``fill``, or filled forward ('ffill') or backward
    ('bfill') along the last index."""
    grid = None
    for c in index:
        kind = table.schema[c].dataType.simpleString()
        axis = table.agg(F.min(c).alias("a"), F.max(c).alias("b")).select(F.explode(F.sequence("a", "b")).alias(c)) if kind in ("int", "bigint", "date") else table.select(c).distinct()
        grid = axis if grid is None else grid.crossJoin(small(axis, 1_000_000))
    out = grid.join(table.select(*index, value), index, "left")
    if how == "constant":
        return out.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))
    return _carried(out, index, value, how == "ffill")


def _carried(rows: DataFrame, index: list[str], value: str, forward: bool) -> DataFrame:
    """Nulls become the nearest value before (or behind) along the last index, among rows of equal other indexes.

    Rows are dealt by ranges of the whole index and filled within their range; what reaches over from other ranges is one
    value for each of them, so a line of any length is no single task.
    """
    own, last = index[:-1], F.col(index[-1])
    rows = stored(rows.repartitionByRange(*index).withColumn("__r", F.spark_partition_id()), "grid")
    line = last.asc() if forward else last.desc()
    inside = Window.partitionBy(*own, "__r").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    has = F.col(value).isNotNull()
    ends = rows.groupBy(*own, "__r").agg((F.max_by if forward else F.min_by)(F.when(has, F.col(value)), F.when(has, last)).alias("__end"))
    order = F.col("__r").asc() if forward else F.col("__r").desc()
    before = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(own)], F.col("__r").alias("__rr"), F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    same = F.col("__r") == F.col("__rr")
    for i, c in enumerate(own):
        same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    filled = rows.withColumn("__in", F.last(value, ignorenulls=True).over(inside)).join(ends, same)
    return filled.withColumn(value, F.coalesce("__in", "__carry")).drop("__r", "__rr", "__in", "__carry", *[f"__k{i}" for i in range(len(own))])


def dense_blocks(filled: DataFrame, first: str, rest: list[str], value: str) -> DataFrame:
    """One dense array for each value of ``first``, in the order of ``rest``; NaN and null are 0."""
    v = F.coalesce(F.when(F.isnan(F.col(value)), 0.0).otherwise(F.col(value)), F.lit(0.0))
    cells = filled.groupBy(first).agg(F.array_sort(F.collect_list(F.struct(*rest, v.alias("v")))).alias("cells"))
    return cells.select(first, F.transform("cells", lambda c: c["v"]).alias("block"))


def stack_volumes(tables: list[DataFrame], axis: str, sizes: list[dict[str, int]]) -> DataFrame:
    """Cell tables (i, j, k, value) end to end along ``axis``; other axes take the largest size, short ones get 0."""
    out, at, axes = None, 0, ["i", "j", "k"]
    for t, s in zip(tables, sizes, strict=True):
        moved = t.withColumn(axis, F.col(axis) + at).select(*axes, "value")
        out = moved if out is None else out.unionByName(moved)
        at += s[axis]
    grid = None
    for a in axes:
        n = at if a == axis else max(s[a] for s in sizes)
        r = out.sparkSession.range(n).select(F.col("id").cast("int").alias(a))
        grid = r if grid is None else grid.crossJoin(small(r))
    return grid.join(out, axes, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
