"""Fold metrics, summaries, votes and dissimilarity of experiments: predictions (config_id, fold, sample_id, y_true, y_pred)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cohortlake.operators.sizes import small
from cohortlake.operators.tables import stored


def _counts(p: DataFrame, by: tuple[str, ...]) -> DataFrame:
    n = lambda t, q: F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == q), 1).otherwise(0)).alias({(1, 1): "tp", (0, 1): "fp", (0, 0): "tn", (1, 0): "fn"}[t, q])
    return p.groupBy(*by).agg(n(1, 1), n(0, 1), n(0, 0), n(1, 0))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def fold_metrics(predictions: DataFrame, by: tuple[str, ...] = ("config_id", "fold")) -> DataFrame:
    """acc, sens, spec, prec, f1 (0 where undefined) and auc of hard predictions (null where a fold has one class)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    sens, spec, prec = _ratio(tp, tp + fn), _ratio(tn, tn + fp), _ratio(tp, tp + fp)
    return _counts(predictions, by).select(
        *by, _ratio(tp + tn, tp + fp + tn + fn).alias("acc"), sens.alias("sens"), spec.alias("spec"), prec.alias("prec"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), F.when((tp + fn > 0) & (tn + fp > 0), (sens + spec) / 2).alias("auc"),
    )


def svm_metrics(predictions: DataFrame, by: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """From sign(score) against labels -1 and 1: accuracy, precision, recall, specificity in %, Brier on 0/1."""
    p = predictions.withColumn("y_pred", F.when(F.col("score") > 0, 1).otherwise(0)).withColumn("y_true", F.when(F.col("label") > 0, 1).otherwise(0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return _counts(p, by).select(*by, (100 * _ratio(tp + tn, n)).alias("accuracy"), (100 * _ratio(tp, tp + fp)).alias("precision"), (100 * _ratio(tp, tp + fn)).alias("recall"), (100 * _ratio(tn, tn + fp)).alias("specificity"), _ratio(fp + fn, n).alias("brier"))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables with its margins that are no likelier than it."""
    n, r, s = a + b + c + d, a + b, a + c
    lf = math.lgamma
    log = lambda x: lf(r + 1) - lf(x + 1) - lf(r - x + 1) + lf(n - r + 1) - lf(s - x + 1) - lf(n - r - s + x + 1) - lf(n + 1) + lf(s + 1) + lf(n - s + 1)
    at = log(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, r + s - n), min(r, s) + 1) if (p := log(x)) <= at + 1e-7))


def fold_significance(predictions: DataFrame, by: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """Mean over the folds of Fisher's exact p; odds ratio of all folds together, null where it is not finite."""

    @pandas_udf("double")
    def p(tp: pd.Series, fp: pd.Series, fn: pd.Series, tn: pd.Series) -> pd.Series:
        return pd.Series([fisher_exact(*map(int, x)) for x in zip(tp, fp, fn, tn, strict=True)], dtype=float)

    rows = _counts(predictions, (*by, "fold")).withColumn("p", p("tp", "fp", "fn", "tn"))
    bad = F.sum("fp") * F.sum("fn")
    return rows.groupBy(*by).agg(F.avg("p").alias("p"), F.when(bad > 0, F.sum("tp") * F.sum("tn") / bad).alias("odds_ratio"))


def metric_curves(metrics: DataFrame, by: tuple[str, ...] = ("dataset", "presel", "cl", "thr")) -> DataFrame:
    names = ["acc", "sens", "spec", "prec", "f1", "auc"]
    return metrics.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in names for f, n in ((F.avg, "mean"), (F.var_pop, "var"))])


def summary_table(metrics: DataFrame) -> DataFrame:
    """(dataset, cl, presel, text): over thresholds the largest mean and the largest variance of accuracy, '%.2f (%.2f)'."""
    each = metrics.groupBy("dataset", "cl", "presel", "thr").agg(F.avg("acc").alias("m"), F.var_pop("acc").alias("v"))
    return each.groupBy("dataset", "cl", "presel").agg(F.max("m").alias("m"), F.max("v").alias("v")).select("dataset", "cl", "presel", F.format_string("%.2f (%.2f)", "m", "v").alias("text"))


def localization_votes(selections: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """selections (config_id, fold, feature_id, weight): share of a configuration's folds that chose each feature."""
    folds = selections.groupBy("config_id").agg(F.count_distinct("fold").alias("n"))
    chosen = selections.filter("weight > 0").groupBy("config_id", "feature_id").agg(F.count_distinct("fold").alias("c"))
    out = chosen.join(folds, "config_id").select("config_id", "feature_id", (F.col("c") / F.col("n")).alias("vote"))
    return out if index is None else out.join(index, "feature_id")


def rogers_tanimoto_matrix(selections: DataFrame, n: int) -> DataFrame:
    """(a, b, value) for every pair of configurations: 2 R / (n + R), R the features only one of them chose, of n in all.

    Features that the same configurations chose count together, so pairs come from each distinct choice once.
    """
    chosen = selections.filter("weight > 0").groupBy("feature_id").agg(F.array_sort(F.collect_set("config_id")).alias("who"))
    choices = chosen.groupBy("who").agg(F.count(F.lit(1)).alias("c"))
    both = choices.select("who", "c", F.posexplode("who").alias("i", "a")).select("a", "c", F.explode(F.slice("who", F.col("i") + 1, F.size("who"))).alias("b")).groupBy("a", "b").agg(F.sum("c").alias("t"))
    both = stored(both, "shared")  # a row for each pair of configurations
    size = both.filter("a = b").select(F.col("a").alias("config_id"), F.col("t").alias("s"))
    sa, sb = size.select(F.col("config_id").alias("a"), F.col("s").alias("sa")), size.select(F.col("config_id").alias("b"), F.col("s").alias("sb"))
    rows = sa.crossJoin(small(sb, 10_000)).filter("a <= b").join(both, ["a", "b"], "left")
    r = F.col("sa") + F.col("sb") - 2 * F.coalesce("t", F.lit(0))
    half = rows.select("a", "b", (2 * r / (n + r)).alias("value"))
    return half.union(half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
