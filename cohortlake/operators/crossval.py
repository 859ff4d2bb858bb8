"""Cross-validation of all folds from one scan: features (sample_id, feature_id, value), labels (sample_id, y, fold).

The moments of each fold, feature and class are gathered once. Those of a fold's training rows are the moments of the
other folds merged, and they give its scaling and its preselection, so no fold reads the features for itself. The samples
go into one table, a row for each fold and sample with that fold's scaled and chosen features, weight and role, which all
fits read; fits of different folds run side by side.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from cohortlake.operators.features import measure_features, merged, moments, train_moments
from cohortlake.operators.sizes import small
from cohortlake.operators.tables import new_path, stored
from cohortlake.operators.thresholds import apply_threshold

INNER_FOLDS = 3
#: Rows of the training table in a task while a solver passes over it.
TASK_ROWS = 1000


@dataclass(frozen=True)
class Preselection:
    """What goes before the classifier: a measure of each feature on the training rows, and a threshold of it."""

    method: str = ""
    thr_method: str = ""
    thr: float = 95.0


@dataclass(frozen=True)
class CrossValidation:
    """``predictions`` (fold, sample_id, y_true, y_pred, probabilities by class or null), ``selected`` (fold, feature_id,
    measure), ``fits`` (fold, params as JSON, score of the inner folds, n_features), ``importances`` (fold, feature_id,
    importance: of the trees, or the weight that is largest over the classes; none for other classifiers)."""

    predictions: DataFrame
    selected: DataFrame
    fits: DataFrame
    importances: DataFrame


def fold_measures(features: DataFrame, labels: DataFrame, presel: Preselection = Preselection(), scale: bool = True) -> DataFrame:
    """(fold, feature_id, center, width, measure) of every fold's training rows, from one scan of the features.

    A value is scaled to (value - center) / width; a width of 0 counts as 1. The measure is that of the scaled values,
    after the threshold; one that is 0 for all features of a fold stays 0, and the fold has no feature then.
    """
    both = ("fold", "feature_id")
    m = stored(train_moments(moments(features, labels, ("fold", "feature_id", "y"))), "moments")
    whole = merged(m, both)
    width = F.sqrt(F.col("m2") / F.col("n"))
    stats = whole.select(*both, F.col("mean").alias("center"), F.when(width > 0, width).otherwise(1.0).alias("width"))
    if not scale:
        stats = stats.select(*both, F.lit(0.0).alias("center"), F.lit(1.0).alias("width"))
    if not presel.method:
        return stats.withColumn("measure", F.lit(1.0))
    scaled = m.join(stats, list(both)).select(*both, "y", "n", ((F.col("mean") - F.col("center")) / F.col("width")).alias("mean"), (F.col("m2") / F.col("width") / F.col("width")).alias("m2"))
    found = stored(measure_features(scaled, presel.method, both), "measures")
    cut = apply_threshold(found.select(F.col("fold").alias("grp"), "feature_id", F.col("measure").alias("value")), presel.thr_method, presel.thr)
    return stats.join(cut.select(F.col("grp").alias("fold"), "feature_id", F.col("value").alias("measure")), list(both))


def training_table(features: DataFrame, labels: DataFrame, measures: DataFrame) -> DataFrame:
    """(fold, sample_id, y, is_test, weight, features): every sample once for each fold that has features.

    ``features`` are a fold's own, in the order of feature_id; ``weight`` is balanced over the classes of its training rows.
    """
    chosen = small(measures.filter("measure > 0").select("fold", "feature_id", "center", "width"))
    rows = features.join(chosen, "feature_id").select("fold", "sample_id", "feature_id", ((F.col("value") - F.col("center")) / F.col("width")).alias("value"))
    vectors = rows.groupBy("fold", "sample_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("p"))
    vectors = vectors.select("fold", "sample_id", array_to_vector(F.transform("p", lambda p: p["value"].cast("double"))).alias("features"))
    own = labels.select("sample_id", F.col("y").cast("double").alias("y"), F.col("fold").alias("own_fold"))
    counts = own.groupBy("own_fold", "y").agg(F.count(F.lit(1)).alias("c"))
    folds = counts.select(F.col("own_fold").alias("fold")).distinct()
    train = small(folds).join(counts, F.col("fold") != F.col("own_fold")).groupBy("fold", "y").agg(F.sum("c").alias("c"))
    totals = train.groupBy("fold").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("classes"))
    weights = train.join(totals, "fold").select("fold", "y", (F.col("total") / (F.col("classes") * F.col("c"))).alias("weight"))
    out = vectors.join(own, "sample_id").withColumn("is_test", F.col("fold") == F.col("own_fold")).join(small(weights), ["fold", "y"], "left")
    return out.select("fold", "sample_id", "y", "is_test", F.when(F.col("is_test"), 1.0).otherwise(F.col("weight")).alias("weight"), "features")


def inner_folds(rows: DataFrame, *by):
    """The (training, test) rows of each inner fold, dealt by the values of ``by``."""
    fold = F.pmod(F.xxhash64(*by), F.lit(INNER_FOLDS))
    return [(rows.filter(fold != i), rows.filter(fold == i)) for i in range(INNER_FOLDS)]


def accuracy(predicted: DataFrame) -> float:
    return predicted.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] or 0.0


def grid_search(estimator, grid: list, rows: DataFrame) -> tuple[int, float | None]:
    """The number of the first candidate of best mean accuracy over the inner folds, and that; None where there is no choice.

    Estimators that fit many candidates in the same passes do so (``fitMultiple``).
    """
    if len(grid) < 2:
        return 0, None
    scores = np.zeros(len(grid))
    for own, rest in inner_folds(rows, "sample_id"):
        for i, model in estimator.fitMultiple(own, grid):
            scores[i] += accuracy(model.transform(rest)) / INNER_FOLDS
    best = int(np.argmax(np.round(scores, 12)))
    return best, float(scores[best])


def importances_of(model) -> np.ndarray | None:
    model = model.stages[-1] if hasattr(model, "stages") else model
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficients"):
        w = np.atleast_2d(model.coefficients if isinstance(model.coefficients, np.ndarray) else model.coefficients.toArray())
        return w[np.abs(w).argmax(0), np.arange(w.shape[1])]
    return None


def cross_validate(features: DataFrame, labels: DataFrame, name: str, presel: Preselection = Preselection(), scale: bool = True, grid: list[dict] | None = None, selectors: list | None = None, seed: int = 0, parallelism: int = 4) -> CrossValidation:
    """Fits the classifier ``name`` on the other folds, once for each fold, and predicts the fold's samples.

    ``grid``: parameters by name, instead of the classifier's own grid. Each fold's best parameters come from
    ``INNER_FOLDS`` folds of its training rows. ``selectors``: stages that go between preselection and classifier. At most
    ``parallelism`` folds are fitted at a time. A fold without a feature above 0 has no predictions; its fit has 0
    features. Nothing of the features comes to the driver but what the fitted models hold.
    """
    from cohortlake.operators.learning import build_pipeline, classifier

    spark = features.sparkSession
    measures = stored(fold_measures(features, labels, presel, scale), "fold_measures")
    table = stored(training_table(features, labels, measures), "training", ("fold",))
    counts = {r["fold"]: r["n"] for r in measures.filter("measure > 0").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    per_fold = {r["fold"]: r for r in labels.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, path = sum(r["n"] for r in per_fold.values()), new_path(spark, "predictions")
    classes = sorted(r["y"] for r in labels.select("y").distinct().collect())
    parts = max(1, total // TASK_ROWS)

    def fit(fold) -> tuple:
        rows = table.filter(F.col("fold") == fold)
        rows = (rows.coalesce(parts) if rows.rdd.getNumPartitions() > parts else rows).persist()
        try:
            train = rows.filter("not is_test")
            estimator, maps = classifier(name, counts[fold], len(classes), seed, grid)
            best, score = grid_search(estimator, maps, train)
            whole = build_pipeline(selectors, estimator) if selectors else estimator
            model = whole.fit(train, maps[best])
            got = model.transform(rows.filter("is_test"))
            probability = vector_to_array("probability") if "probability" in got.columns else F.lit(None).cast("array<double>")
            got = got.select(F.col("fold").cast("int").alias("fold"), "sample_id", F.col("y").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), probability.alias("probabilities"))
            got.write.mode("overwrite").parquet(f"{path}/{fold}")
            imp = None if selectors else importances_of(model)
            return got.schema, fold, json.dumps({p.name: v for p, v in maps[best].items()}, sort_keys=True), score, None if imp is None else imp.tolist()
        finally:
            rows.unpersist()

    with ThreadPoolExecutor(parallelism) as pool:
        run = inheritable_thread_target(spark)(fit)
        done = [f.result() for f in [pool.submit(run, fold) for fold in sorted(counts)]]
    fits = [(int(f), params, score, counts[f]) for _, f, params, score, _ in done] + [(int(f), None, None, 0) for f in sorted(set(per_fold) - set(counts))]
    fits = spark.createDataFrame(fits, "fold int, params string, score double, n_features long")
    kind = features.schema["feature_id"].dataType.simpleString()
    ids = measures.filter("measure > 0").groupBy("fold").agg(F.array_sort(F.collect_list("feature_id")).alias("ids"))
    vectors = spark.createDataFrame([(int(f), imp) for _, f, _, _, imp in done if imp is not None], "fold int, importance array<double>")
    zipped = ids.join(vectors, "fold").select(F.col("fold").cast("int").alias("fold"), F.explode(F.arrays_zip("ids", "importance")).alias("x"))
    importances = zipped.select("fold", F.col("x.ids").cast(kind).alias("feature_id"), F.col("x.importance").alias("importance"))
    schema = done[0][0] if done else "fold int, sample_id long, y_true int, y_pred int, probabilities array<double>"
    predictions = spark.read.schema(schema).parquet(*[f"{path}/{f}" for _, f, *_ in done]) if done else spark.createDataFrame([], schema)
    return CrossValidation(predictions, measures.select(F.col("fold").cast("int").alias("fold"), "feature_id", "measure"), fits, importances)
