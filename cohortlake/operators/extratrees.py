"""Extremely randomised trees as a selector of features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.estimators import _arrays, _Fitted, summed


def draws(seed: int, tree: int, node: int, dims: int, tried: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that a node tries, and where between its least and largest value each threshold is (0 to 1).

    They depend on the node's number alone: 1 at the root, 2 i and 2 i + 1 below i.
    """
    rng = np.random.default_rng([seed, tree, node])
    return rng.choice(dims, tried, replace=False), rng.random(tried)


def gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(-1, keepdims=True)
    return 1 - ((counts / np.maximum(n, 1)) ** 2).sum(-1)


class ExtraTreesSelector(Estimator, HasFeaturesCol, HasLabelCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """The ``k`` features of largest importance in ``trees`` extremely randomised trees; without k those of at least the mean.

    Each node tries ``tried`` features ('auto': the root of all), each at one threshold drawn between its least and its
    largest value in the node, and takes the split of the largest gain in Gini's measure (the first of equal ones); there is
    no search for thresholds. Trees see all rows. A node ends that is pure, at ``maxDepth``, or where no tried feature
    varies. All trees grow one level in two passes: ranges of the tried features, then class counts on both sides.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", outputCol="selected", k=None, trees=50, tried="auto", maxDepth=8, seed=0):
        super().__init__()
        self.k = Param(self, "k", "features to keep", TypeConverters.toInt)
        self.trees = Param(self, "trees", "trees", TypeConverters.toInt)
        self.tried = Param(self, "tried", "features that a node tries, or auto", TypeConverters.toString)
        self.maxDepth = Param(self, "maxDepth", "levels at most", TypeConverters.toInt)
        self._setDefault(labelCol="y", outputCol="selected", trees=50, tried="auto", maxDepth=8, seed=0)
        self._set(**{k_: v for k_, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).persist()
        try:
            score = self._importances(rows)
        finally:
            rows.unpersist()
        if self.isDefined("k"):
            keep = np.sort(np.argsort(-score, kind="stable")[: self.getOrDefault("k")])
        else:
            keep = np.flatnonzero(score >= score.mean())
        return ExtraTreesModel(indices=keep.astype(float), importances=score)._like(self)

    def _importances(self, rows: DataFrame) -> np.ndarray:
        stats = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").collect()
        ys, total = np.array([r["y"] for r in stats]), sum(r["n"] for r in stats)
        dims, trees, depth, seed = len(rows.first()["x"]), self.getOrDefault("trees"), self.getOrDefault("maxDepth"), self.getSeed()
        tried = self.getOrDefault("tried")
        tried = min(dims, max(1, int(dims**0.5) if tried == "auto" else int(tried)))
        feature = np.full((trees, 1 << (depth + 1)), -1)
        threshold = np.zeros(feature.shape)
        score = np.zeros((trees, dims))
        active = [(t, 1) for t in range(trees)] if len(ys) > 1 else []
        for level in range(depth):
            if not active:
                break
            drawn = [draws(seed, t, node, dims, tried) for t, node in active]
            feats, share = np.array([f for f, _ in drawn]), np.array([u for _, u in drawn])
            cell = np.full(feature.shape, -1)
            cell[tuple(np.array(active).T)] = np.arange(len(active))
            place = _router(feature.copy(), threshold.copy(), cell, level, dims)
            low, high = _ranges(rows, place, feats)
            cut = low + share * (high - low)

            def sides(b, place=place, feats=feats, cut=cut):
                x, at, row = place(b)
                y = np.searchsorted(ys, b.column(1).to_numpy())[row]
                right = x[row[:, None], feats[at]] > cut[at]
                flat = ((at[:, None] * tried + np.arange(tried)) * 2 + right) * len(ys) + y[:, None]
                return np.bincount(flat.ravel(), minlength=cut.size * 2 * len(ys)).astype(float)

            counts = summed(rows, sides, cut.size * 2 * len(ys)).reshape(len(active), tried, 2, len(ys))
            n = counts.sum(3)
            whole = gini(counts[:, 0].sum(1))
            gain = whole[:, None] - (n * gini(counts)).sum(2) / np.maximum(n.sum(2), 1)
            gain[high <= low] = -1
            best, later = np.round(gain, 12).argmax(1), []  # equal but for rounding: the first
            for i, (t, node) in enumerate(active):
                j = best[i]
                if gain[i, j] < 0:
                    continue
                feature[t, node], threshold[t, node] = feats[i, j], cut[i, j]
                score[t, feats[i, j]] += n[i, j].sum() / total * gain[i, j]
                later += [(t, 2 * node + s) for s in (0, 1) if (counts[i, j, s] > 0).sum() > 1]
            active = later
        sums = score.sum(1, keepdims=True)
        return np.where(sums > 0, score / np.where(sums > 0, sums, 1), 0).mean(0)


def _router(feature: np.ndarray, threshold: np.ndarray, cell: np.ndarray, level: int, dims: int):
    """A function of a batch: its matrix, and of each (tree, row) that is in an open node the node's cell and the row."""

    def place(b):
        x = _arrays(b, dims)
        tree = np.arange(len(feature))[:, None]
        node = np.ones((len(feature), len(x)), int)
        for _ in range(level):
            f = feature[tree, node]
            right = x[np.arange(len(x))[None], np.maximum(f, 0)] > threshold[tree, node]
            node = np.where(f >= 0, 2 * node + right, node)
        at = cell[tree, node]
        some = np.nonzero(at >= 0)
        return x, at[some], some[1]

    return place


def _ranges(rows: DataFrame, place, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each tried feature in each open node."""

    def run(batches):
        low, high = np.full(feats.shape, np.inf), np.full(feats.shape, -np.inf)
        for b in batches:
            if b.num_rows:
                x, at, row = place(b)
                v = x[row[:, None], feats[at]]
                np.minimum.at(low, at, v)
                np.maximum.at(high, at, v)
        seen = np.flatnonzero(low.ravel() <= high.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(low.ravel()[seen]), pa.array(high.ravel()[seen])], names=["at", "low", "high"])

    got = rows.mapInArrow(run, "at long, low double, high double").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    low, high = np.zeros(feats.size), np.zeros(feats.size)
    at = got.column("at").to_numpy()
    low[at], high[at] = got.column("low").to_numpy(), got.column("high").to_numpy()
    return low.reshape(feats.shape), high.reshape(feats.shape)


class ExtraTreesModel(_Fitted, HasOutputCol):
    @property
    def indices(self) -> list[int]:
        return self.numbers["indices"].astype(int).tolist()

    @property
    def featureImportances(self) -> np.ndarray:
        return self.numbers["importances"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return VectorSlicer(inputCol=self.getFeaturesCol(), outputCol=self.getOutputCol(), indices=self.indices).transform(dataset)
