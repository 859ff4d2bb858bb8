"""Supervised experiments on pyspark.ml: sample rows (sample_id, y DOUBLE, features VECTOR, fold)."""

import itertools

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import PCA, UnivariateFeatureSelector, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.crossval import CrossValidation, Preselection, accuracy, cross_validate, inner_folds  # noqa: F401
from cohortlake.operators.estimators import FisherLDA, GaussianClasses, MixedPerceptron, RandomizedPCA, SGDClassifier
from cohortlake.operators.extratrees import ExtraTreesSelector
from cohortlake.operators.experiments import ResultsTable, run_experiments  # noqa: F401


def _steps(dims: int, first: int, last: int, width: int) -> list[int]:
    """first, first + width, ... below last; of few features every second number."""
    return list(range(first, dims, 2)) if dims < 10 else list(range(first, last, width))


def classifier_grid(name: str, dims: int, rows: int = 1000) -> list[dict]:
    """All candidates of a classifier's own grid, as parameters by name. ``rows``: of the training set, for 'linsvm'."""
    powers = lambda low, high: [10.0**i for i in range(low, high + 1)]
    axes = {
        "cart": {"impurity": ["gini", "entropy"], "maxDepth": [30, 10, 20]},  # 30 is the deepest there is
        "rf": {"numTrees": [3, 5, 10, 30, 50, 100], "featureSubsetStrategy": [*map(str, _steps(dims, 1, 30, 4)), "all", "auto", "sqrt", "log2"]},
        "gmm": {"nComponents": [2, 3, 4, 5], "covarianceType": ["spherical", "tied", "diag"]},
        "linsvm": {"regParam": [1 / (c * rows) for c in powers(-3, 3)]},
        "sgd": {"loss": ["hinge", "modified_huber", "log"], "penalty": ["l1", "l2", "elasticnet"], "alpha": powers(-6, -1)},
        "percep": {"penalty": ["none", "l2", "l1", "elasticnet"], "alpha": powers(-3, 3)},
    }[name]
    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]


def classifier(name: str, dims: int = 0, classes: int = 2, seed: int = 0, grid: list[dict] | None = None, rows: int = 1000):
    """The estimator and its candidates as parameter maps. Labels y, features features, weights weight.

    ``grid``: the candidates as parameters by name; without one those of ``classifier_grid``.
    """
    common = {"labelCol": "y", "featuresCol": "features"}
    known = {
        "cart": lambda: DecisionTreeClassifier(weightCol="weight", seed=seed, maxDepth=30, **common),
        "rf": lambda: RandomForestClassifier(weightCol="weight", seed=seed, maxDepth=30, **common),
        "gmm": lambda: GaussianClasses(seed=seed, **common),
        "linsvm": lambda: LinearSVC(weightCol="weight", maxIter=20, **common),
        "sgd": lambda: SGDClassifier(weightCol="weight", seed=seed, **common),
        "percep": lambda: MixedPerceptron(weightCol="weight", seed=seed, **common),
    }
    if name not in known:
        raise ValueError(f"no classifier {name}")
    e = known[name]()
    candidates = classifier_grid(name, dims, rows) if grid is None else grid
    return e, [{e.getParam(k): v for k, v in c.items()} for c in candidates] or [{}]


def selector_grid(name: str, dims: int) -> list[dict]:
    """All candidates of a selector's own grid, as parameters by name of its stage, or of its function."""
    some, comps = _steps(dims, 2, 20, 4), _steps(dims, 1, 30, 4)
    axes = {
        "rfe": {"c": [0.1, 1.0, 10.0], "k": some},
        "rfecv": {"c": [0.1, 1.0, 10.0]},
        "univariate": {"selectionThreshold": [0.01, 0.03, 0.05, 0.1]},
        "fpr": {"selectionThreshold": [0.01, 0.03, 0.05, 0.1]},
        "fdr": {"selectionThreshold": [0.01, 0.03, 0.05, 0.1]},
        "extratrees": {"trees": [1, 3, 5, 10, 30, 50], "tried": ["auto", *map(str, some)]},
        "pca": {"k": comps},
        "rpca": {"k": comps, "power": [3, 4, 5], "whiten": [True, False]},
        "lda": {"nComponents": comps},
        "anova": {"selectionThreshold": comps},
    }[name]
    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]


def feature_selector(name: str, features: str = "features", out: str = "selected", k: int = 10, seed: int = 0):
    """An unfitted selector stage, or for 'rfe' and 'rfecv' a callable(df) -> VectorSlicer."""
    modes = {"univariate": ("percentile", 0.05), "fpr": ("fpr", 0.05), "fdr": ("fdr", 0.05), "anova": ("numTopFeatures", k)}
    if name in modes:
        mode, at = modes[name]
        return UnivariateFeatureSelector(featuresCol=features, outputCol=out, labelCol="y", selectionMode=mode).setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(at)
    if name == "pca":
        return PCA(k=k, inputCol=features, outputCol=out)
    if name == "rpca":
        return RandomizedPCA(k=k, featuresCol=features, outputCol=out, seed=seed)
    if name == "extratrees":
        return ExtraTreesSelector(k=k, featuresCol=features, outputCol=out, seed=seed)
    if name == "rfe":
        return lambda df: rfe(df, k, features, out)
    if name == "rfecv":
        return lambda df: rfecv(df, features, out)
    if name == "lda":
        return FisherLDA(featuresCol=features, outputCol=out)
    raise ValueError(f"no selector {name}")


def _eliminations(df: DataFrame, least: int, features: str, step: float):
    """Sets of features from all down to ``least``, each with the SVM fit on it: a share ``step`` of all, those of least
    squared weight, goes each time."""
    dims = len(df.select(features).first()[0])
    keep = list(range(dims))
    while True:
        part = VectorSlicer(inputCol=features, outputCol="__part", indices=keep)
        model = LinearSVC(labelCol="y", featuresCol="__part", maxIter=5, regParam=0.1).fit(part.transform(df))
        yield keep, part, model
        if len(keep) <= least:
            return
        drop = min(len(keep) - least, max(1, int(step * dims)))
        gone = set(np.argsort(model.coefficients.toArray() ** 2, kind="stable")[:drop].tolist())
        keep = [f for i, f in enumerate(keep) if i not in gone]


def rfe(df: DataFrame, k: int, features: str = "features", out: str = "selected", step: float = 0.05) -> VectorSlicer:
    """Drops a twentieth of all features, those of least squared SVM weight, until ``k`` are left."""
    *_, (keep, _, _) = _eliminations(df, k, features, step)
    return VectorSlicer(inputCol=features, outputCol=out, indices=keep)


def rfecv(df: DataFrame, features: str = "features", out: str = "selected", step: float = 0.05) -> VectorSlicer:
    """``rfe`` down to the number of features of best mean accuracy over the inner folds; of equal ones the smallest."""
    scores: dict[int, list[float]] = {}
    df = df.persist()
    for own, rest in inner_folds(df, vector_to_array(features)):
        for keep, part, model in _eliminations(own, 1, features, step):
            scores.setdefault(len(keep), []).append(accuracy(model.transform(part.transform(rest))))
    best = rfe(df, min(scores, key=lambda n: (-np.mean(scores[n]), n)), features, out, step)
    df.unpersist()
    return best


def fisher_lda(df: DataFrame, features: str = "features") -> np.ndarray:
    """Discriminant weights (d x classes - 1) from the class moments."""
    return FisherLDA(featuresCol=features).fit(df).axes


def build_pipeline(selectors: list, estimator) -> Pipeline:
    """Union of up to two selectors (stages writing sel0, sel1), then the classifier."""
    if not selectors:
        return Pipeline(stages=[estimator])
    union = VectorAssembler(inputCols=[s.getOutputCol() for s in selectors], outputCol="union")
    return Pipeline(stages=[*selectors, union, estimator.copy({estimator.featuresCol: "union"})])


def load_matrix(samples: DataFrame, voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """samples (sample_id, path, score) and voxels (volume_id = path, i, j, k, value) to (sample_id, y, feature_id, value)."""
    from cohortlake.operators.features import encode_labels
    from cohortlake.operators.voxels import apply_mask

    inside = apply_mask(voxels, mask).select(F.col("volume_id").alias("path"), F.concat_ws(",", "i", "j", "k").alias("feature_id"), "value")
    return encode_labels(samples).join(inside, "path").select("sample_id", "y", "feature_id", "value")


def to_vectors(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample_id, y, features) of long integer features; every sample has every feature."""
    whole = features.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("p"))
    return whole.join(labels, "sample_id").select("sample_id", F.col("y").cast("double").alias("y"), array_to_vector(F.transform("p", lambda p: p["value"].cast("double"))).alias("features"))
