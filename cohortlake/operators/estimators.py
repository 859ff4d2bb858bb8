"""Estimators for pyspark.ml pipelines that it has not: mixtures for each class, linear models by stochastic sub-gradients
and by mixed perceptrons, Fisher's discriminants, randomised components, extremely randomised trees' importances.

All are fitted by passes over the rows in which each task hands on sums; what the driver holds is a model's numbers.
``fitMultiple`` fits all candidates of a grid in the same passes. Fitted numbers are a parameter of the model (JSON), so
models are saved and loaded like any other of pyspark.ml.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasProbabilityCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _arrays(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def summed(df: DataFrame, step, size: int) -> np.ndarray:
    """The sum over all rows of ``step(batch) -> vector of size``: a task hands on one vector, Spark adds cell by cell."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += step(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["at", "s"])

    out = np.zeros(size)
    got = df.mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    out[got.column("at").to_numpy()] = got.column("s").to_numpy()
    return out


def _stack(x: pd.Series) -> np.ndarray:
    return np.stack(x.map(np.asarray).to_list())


class _Fitted(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """A model whose numbers are in ``state``."""

    def __init__(self, **arrays):
        super().__init__()
        self.state = Param(self, "state", "fitted numbers as JSON", TypeConverters.toString)
        if arrays:
            self._set(state=json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in arrays.items()}))

    @property
    def numbers(self) -> dict:
        return {k: np.array(v, dtype=float) for k, v in json.loads(self.getOrDefault("state")).items()}

    def _like(self, parent: Params):
        """Takes the columns' names from the estimator."""
        for p in self.params:
            if p.name != "state" and parent.hasParam(p.name) and parent.isDefined(p.name):
                self._set(**{p.name: parent.getOrDefault(p.name)})
        return self


class _Classifies(_Fitted, HasPredictionCol, HasProbabilityCol):
    """Adds the prediction and a probability of each class (none of a model that has none)."""

    def _scores(self, x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray | None]:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        m, scores = self.numbers, self._scores
        if scores(np.zeros((1, self._dims(m))), m)[1] is None:
            best = pandas_udf(lambda x: pd.Series(scores(_stack(x), m)[0].astype(float)), "double")
            return dataset.withColumn(self.getPredictionCol(), best(vector_to_array(self.getFeaturesCol())))

        def both(x: pd.Series) -> pd.DataFrame:
            y, p = scores(_stack(x), m)
            return pd.DataFrame({"y": y.astype(float), "p": list(p)})

        both.__annotations__ = {"x": pd.Series, "return": pd.DataFrame}
        out = dataset.withColumn("__both", pandas_udf(both, "y double, p array<double>")(vector_to_array(self.getFeaturesCol())))
        return out.withColumns({self.getPredictionCol(): F.col("__both.y"), self.getProbabilityCol(): array_to_vector("__both.p")}).drop("__both")


def _fits_all(fit_all):
    """Makes ``fit`` and ``fitMultiple`` of ``fit_all(self, df, estimators) -> models``."""

    def _fit(self, dataset):
        return fit_all(self, dataset, [self])[0]

    def fit_multiple(self, dataset, maps):
        return iter(list(enumerate(fit_all(self, dataset, [self.copy(m) for m in maps]))))

    return _fit, fit_multiple


# mixtures


class GaussianClasses(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """A mixture of Gaussians for each class; a row gets the class of the largest prior times likelihood.

    ``covarianceType``: 'full', 'tied' (one matrix for the components of a class), 'diag', or 'spherical' (one variance).
    Components start at the rows of smallest seeded hash in the class, with the class's own variance; then ``maxIter``
    steps of EM, fewer if no likelihood rises by ``tol`` a row. A class of fewer rows has fewer components. All classes and
    candidates share each pass.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", predictionCol="prediction", probabilityCol="probability", nComponents=1, covarianceType="full", maxIter=20, tol=1e-6, floor=1e-6, seed=0):
        super().__init__()
        self.nComponents = Param(self, "nComponents", "Gaussians of a class", TypeConverters.toInt)
        self.covarianceType = Param(self, "covarianceType", "full, tied, diag or spherical", TypeConverters.toString)
        self.maxIter = Param(self, "maxIter", "steps of EM at most", TypeConverters.toInt)
        self.tol = Param(self, "tol", "least gain of the mean log-likelihood", TypeConverters.toFloat)
        self.floor = Param(self, "floor", "added to each variance", TypeConverters.toFloat)
        self._setDefault(nComponents=1, covarianceType="full", maxIter=20, tol=1e-6, floor=1e-6, labelCol="y", seed=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit_all(self, dataset: DataFrame, each: list[GaussianClasses]) -> list[GaussianClassesModel]:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).persist()
        try:
            stats = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").collect()
            ys, n = [r["y"] for r in stats], np.array([r["n"] for r in stats], float)
            dims = len(rows.first()["x"])
            most = max(e.getOrDefault("nComponents") for e in each)
            starts = _first_rows(rows, most, self.getSeed())
            fits = [_Mixture(dims, len(starts[y][: e.getOrDefault("nComponents")]), e.getOrDefault("covarianceType"), e.getOrDefault("floor")) for e in each for y in ys]
            owner = [(e, y) for e in each for y in ys]
            spread = _class_scatter(rows, ys, dims, n)
            for f, (e, y) in zip(fits, owner, strict=True):
                f.start(starts[y][: f.k], *spread[y])
            history: list[list[float]] = [[] for _ in fits]
            live = [f.k > 1 for f in fits]  # one Gaussian is its class's moments
            at = np.cumsum([0, *[f.size for f in fits]])
            for step in range(max(e.getOrDefault("maxIter") for e in each)):
                live = [go and step < e.getOrDefault("maxIter") for go, (e, _) in zip(live, owner, strict=True)]
                if not any(live):
                    break
                todo = [(i, float(y)) for i, (_, y) in enumerate(owner) if live[i]]

                def e_step(b, todo=todo, fits=fits, at=at):
                    x, y, out = _arrays(b, dims), b.column(1).to_numpy(), np.zeros(at[-1])
                    for i, label in todo:
                        own = x[y == label]
                        if len(own):
                            out[at[i] : at[i + 1]] += fits[i].sums(own)
                    return out

                total = summed(rows, e_step, int(at[-1]))
                for i, _ in todo:
                    like = fits[i].update(total[at[i] : at[i + 1]])
                    live[i] = not history[i] or like - history[i][-1] > owner[i][0].getOrDefault("tol")
                    history[i].append(like)
            models = []
            for j, e in enumerate(each):
                own = fits[j * len(ys) : (j + 1) * len(ys)]
                logs = np.concatenate([np.log(n[c] / n.sum()) + np.log(np.maximum(f.weight, 1e-300)) for c, f in enumerate(own)])
                arrays = {"classes": np.array(ys), "owner": np.concatenate([[c] * f.k for c, f in enumerate(own)]), "log_weight": logs, "mean": np.concatenate([f.mean for f in own]), "precision": np.concatenate([f.precisions() for f in own]), "log_det": np.concatenate([f.log_dets() for f in own])}
                model = GaussianClassesModel(**arrays)._like(e)
                model.log_likelihoods = history[j * len(ys) : (j + 1) * len(ys)]
                models.append(model)
            return models
        finally:
            rows.unpersist()

    _fit, fitMultiple = _fits_all(_fit_all)


def _first_rows(rows: DataFrame, k: int, seed: int) -> dict[float, np.ndarray]:
    """The ``k`` distinct rows of smallest hash of each class; a task hands on as many at most."""

    def run(batches):
        held: dict[float, list] = {}
        for b in batches:
            for x, y, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                best = held.setdefault(y, [])
                if (h, x) not in best:
                    best.append((h, x))
                    best.sort()
                    del best[k:]
        flat = [(y, h, x) for y, best in held.items() for h, x in best]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.list_(pa.float64())))], names=["y", "h", "x"])

    hashed = rows.select("x", "y", F.xxhash64(F.col("x"), F.lit(seed)).alias("h"))
    tops = hashed.mapInArrow(run, "y double, h long, x array<double>").distinct()
    from pyspark.sql import Window as W

    tops = tops.withColumn("i", F.row_number().over(W.partitionBy("y").orderBy("h", "x"))).filter(F.col("i") <= k)
    out: dict[float, list] = {}
    for r in tops.orderBy("y", "i").collect():  # k rows for each class
        out.setdefault(r["y"], []).append(r["x"])
    return {y: np.array(v) for y, v in out.items()}


def _class_scatter(rows: DataFrame, ys: list[float], dims: int, n: np.ndarray) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of each class, in two passes."""

    def means(b):
        x, y = _arrays(b, dims), b.column(1).to_numpy()
        return np.concatenate([x[y == c].sum(0) for c in ys])

    mean = summed(rows, means, len(ys) * dims).reshape(len(ys), dims) / n[:, None]

    def squares(b):
        x, y = _arrays(b, dims), b.column(1).to_numpy()
        return np.concatenate([((d := x[y == c] - m).T @ d).ravel() for c, m in zip(ys, mean, strict=True)])

    cov = summed(rows, squares, len(ys) * dims * dims).reshape(len(ys), dims, dims) / n[:, None, None]
    return {c: (m, s) for c, m, s in zip(ys, mean, cov, strict=True)}


class _Mixture:
    """One class's mixture: its EM step from sums."""

    def __init__(self, dims: int, k: int, kind: str, floor: float):
        self.dims, self.k, self.kind, self.floor = dims, k, kind, floor
        square = dims * dims if kind == "full" else dims  # 'tied' takes its second moment from the class
        self.size = 1 + k * (1 + dims + (0 if kind == "tied" else square))

    def start(self, means: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> None:
        self.weight = np.full(self.k, 1 / self.k)
        self.mean = means.astype(float) if self.k > 1 else mean[None]
        self.scatter = cov + np.outer(mean, mean)  # of the class, about 0
        eye = np.eye(self.dims) * self.floor
        if self.kind in ("full", "tied"):
            self.cov = np.array([cov + eye] * (self.k if self.kind == "full" else 1))
        else:
            var = np.diag(cov) + self.floor
            self.cov = np.array([var if self.kind == "diag" else np.full(self.dims, var.mean())] * self.k)

    def precisions(self) -> np.ndarray:
        """(k, d, d), or (k, d) of diagonal ones as diagonals."""
        if self.kind in ("full", "tied"):
            return np.broadcast_to(np.linalg.inv(self.cov), (self.k, self.dims, self.dims)).copy()
        return np.array([np.diag(1 / c) for c in self.cov])

    def log_dets(self) -> np.ndarray:
        if self.kind in ("full", "tied"):
            return np.broadcast_to(np.linalg.slogdet(self.cov)[1], (self.k,)).copy()
        return np.log(self.cov).sum(1)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """(rows, k): log of weight times density."""
        out = np.log(np.maximum(self.weight, 1e-300)) - 0.5 * (self.log_dets() + self.dims * np.log(2 * np.pi))
        if self.kind in ("full", "tied"):
            p = self.precisions()
            return out - 0.5 * np.stack([(((x - m) @ p[j]) * (x - m)).sum(1) for j, m in enumerate(self.mean)], 1)
        return out - 0.5 * np.stack([((x - m) ** 2 / c).sum(1) for m, c in zip(self.mean, self.cov, strict=True)], 1)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood, and of each component its share, and its first and second moments."""
        joint = self.log_joint(x)
        top = joint.max(1, keepdims=True)
        whole = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        r = np.exp(joint - whole[:, None])
        parts = [np.array([whole.sum()]), r.sum(0), (r.T @ x).ravel()]
        if self.kind == "full":
            parts.append(np.stack([(x * r[:, j : j + 1]).T @ x for j in range(self.k)]).ravel())
        elif self.kind != "tied":
            parts.append((r.T @ (x * x)).ravel())
        return np.concatenate(parts)

    def update(self, s: np.ndarray) -> float:
        """The M step; the mean log-likelihood of the numbers before it."""
        k, d = self.k, self.dims
        share = s[1 : 1 + k]
        n, safe = share.sum(), np.maximum(share, 1e-12)
        mean = s[1 + k : 1 + k + k * d].reshape(k, d) / safe[:, None]
        second = s[1 + k + k * d :]
        self.weight, self.mean = share / n, mean
        if self.kind == "full":
            self.cov = second.reshape(k, d, d) / safe[:, None, None] - np.einsum("ki,kj->kij", mean, mean) + np.eye(d) * self.floor
        elif self.kind == "tied":
            self.cov = (self.scatter - np.einsum("k,ki,kj->ij", self.weight, mean, mean) + np.eye(d) * self.floor)[None]
        else:
            var = np.maximum(second.reshape(k, d) / safe[:, None] - mean**2, 0) + self.floor
            self.cov = var if self.kind == "diag" else np.repeat(var.mean(1, keepdims=True), d, 1)
        return float(s[0] / n)


class GaussianClassesModel(_Classifies):
    def _dims(self, m: dict) -> int:
        return m["mean"].shape[1]

    def _scores(self, x, m):
        joint = m["log_weight"] - 0.5 * m["log_det"] - 0.5 * np.stack([(((x - mu) @ p) * (x - mu)).sum(1) for mu, p in zip(m["mean"], m["precision"], strict=True)], 1)
        top = joint.max(1, keepdims=True)
        part = np.exp(joint - top)
        p = np.stack([part[:, m["owner"] == c].sum(1) for c in range(len(m["classes"]))], 1)
        return m["classes"][p.argmax(1)], p / p.sum(1, keepdims=True)


# linear models


def _labels(rows: DataFrame) -> np.ndarray:
    return np.array(sorted(r["y"] for r in rows.select("y").distinct().collect()))


def _targets(y: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """(rows, outputs) of 1 and -1: one output for two classes, else one against all others for each."""
    return np.where(y[:, None] == (classes[1:] if len(classes) == 2 else classes), 1.0, -1.0)


def _slopes(loss: str, margin: np.ndarray) -> np.ndarray:
    """The derivative of the loss in the margin y f(x)."""
    if loss == "hinge":
        return np.where(margin < 1, -1.0, 0.0)
    if loss == "modified_huber":
        return np.where(margin >= 1, 0.0, np.where(margin >= -1, -2 * (1 - margin), -4.0))
    return -1 / (1 + np.exp(np.clip(margin, -500, 500)))


def _shrink(w: np.ndarray, penalty: str, alpha: float, rate: float, l1_ratio: float) -> np.ndarray:
    """A step against the penalty: weights decay for l2; for l1 they move towards 0 and stop there."""
    l1 = {"l1": 1.0, "elasticnet": l1_ratio}.get(penalty, 0.0) * alpha * rate
    l2 = {"l2": 1.0, "elasticnet": 1 - l1_ratio}.get(penalty, 0.0) * alpha * rate
    w = w / (1 + l2)
    return np.sign(w) * np.maximum(np.abs(w) - l1, 0)


class _Linear(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasWeightCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    def _declare(self, **defaults):
        self.penalty = Param(self, "penalty", "none, l1, l2 or elasticnet", TypeConverters.toString)
        self.alpha = Param(self, "alpha", "share of the penalty", TypeConverters.toFloat)
        self.l1Ratio = Param(self, "l1Ratio", "share of l1 in elasticnet", TypeConverters.toFloat)
        self.epochs = Param(self, "epochs", "passes over all rows at most", TypeConverters.toInt)
        self._setDefault(**{"l1Ratio": 0.15, "labelCol": "y", "seed": 0, **defaults})

    def _rows(self, dataset: DataFrame) -> DataFrame:
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined("weightCol") else F.lit(1.0)
        x = vector_to_array(self.getFeaturesCol())
        return dataset.select(x.alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.alias("w"), F.xxhash64(x, F.col(self.getLabelCol()), F.lit(self.getSeed())).alias("h"))


class SGDClassifier(_Linear):
    """A linear model by mini-batches of sub-gradients, with hinge, modified Huber or logistic loss.

    Rows are dealt into ``batches`` by a seeded hash; a step takes the weighted mean slope of one batch, summed over the
    tasks, at a rate of ``rate`` / sqrt(1 + step), then one step against the penalty. Intercepts are not penalised. More than
    two classes are fitted one against all others. All candidates of a grid take their steps in the same passes.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", weightCol=None, predictionCol="prediction", probabilityCol="probability", loss="modified_huber", penalty="l2", alpha=1e-4, l1Ratio=0.15, epochs=10, batches=4, rate=0.5, seed=0):
        super().__init__()
        self._declare(penalty="l2", alpha=1e-4, epochs=10)
        self.loss = Param(self, "loss", "hinge, modified_huber or log", TypeConverters.toString)
        self.batches = Param(self, "batches", "parts of the rows, one for each step", TypeConverters.toInt)
        self.rate = Param(self, "rate", "first step's length", TypeConverters.toFloat)
        self._setDefault(loss="modified_huber", batches=4, rate=0.5)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit_all(self, dataset: DataFrame, each: list[SGDClassifier]) -> list[LinearClassesModel]:
        n_batches = self.getOrDefault("batches")
        rows = self._rows(dataset).withColumn("part", F.pmod("h", F.lit(n_batches))).persist()
        try:
            classes, dims = _labels(rows), len(rows.first()["x"])
            outs = 1 if len(classes) == 2 else len(classes)
            w = np.zeros((len(each), outs, dims + 1))
            losses = [e.getOrDefault("loss") for e in each]
            steps = [e.getOrDefault("epochs") * n_batches for e in each]
            for step in range(max(steps)):

                def slopes(b, w=w):
                    x = np.hstack([_arrays(b, dims), np.ones((b.num_rows, 1))])
                    t, weight = _targets(b.column(1).to_numpy(), classes), b.column(2).to_numpy()
                    out = np.empty_like(w)
                    for i, loss in enumerate(losses):
                        out[i] = (_slopes(loss, t * (x @ w[i].T)) * t * weight[:, None]).T @ x
                    return np.append(out.ravel(), weight.sum())

                total = summed(rows.filter(F.col("part") == step % n_batches), slopes, w.size + 1)
                if not total[-1]:
                    continue
                slope, w = (total[:-1] / total[-1]).reshape(w.shape), w.copy()
                for i, e in enumerate(each):
                    if step < steps[i]:
                        rate = e.getOrDefault("rate") / np.sqrt(1 + step)
                        w[i] -= rate * slope[i]
                        w[i, :, :-1] = _shrink(w[i, :, :-1], e.getOrDefault("penalty"), e.getOrDefault("alpha"), rate, e.getOrDefault("l1Ratio"))
            kinds = {"hinge": 0.0, "modified_huber": 1.0, "log": 2.0}
            return [LinearClassesModel(classes=classes, weight=w[i], kind=kinds[losses[i]])._like(e) for i, e in enumerate(each)]
        finally:
            rows.unpersist()

    _fit, fitMultiple = _fits_all(_fit_all)


class MixedPerceptron(_Linear):
    """A perceptron by iterative parameter mixing.

    Rows are dealt into ``shards`` by a seeded hash, and stand in its order there. In a round each shard starts from the
    mixed weights, passes its rows once and corrects at each mistake; then the shards' weights are averaged, by the rows
    they hold. It ends after a round without a mistake, or ``epochs`` rounds. One shard is the sequential perceptron. The
    penalty shrinks the mixed weights once a round. Rows of weight v correct by v. All candidates share each pass.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", weightCol=None, predictionCol="prediction", probabilityCol="probability", penalty="none", alpha=1e-4, l1Ratio=0.15, epochs=20, shards=8, seed=0):
        super().__init__()
        self._declare(penalty="none", alpha=1e-4, epochs=20)
        self.shards = Param(self, "shards", "parts of the rows that are passed side by side", TypeConverters.toInt)
        self._setDefault(shards=8)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit_all(self, dataset: DataFrame, each: list[MixedPerceptron]) -> list[LinearClassesModel]:
        shards = self.getOrDefault("shards")
        rows = self._rows(dataset).withColumn("part", F.pmod("h", F.lit(shards)))
        rows = rows.repartition(shards, "part").sortWithinPartitions("part", "h").persist()
        try:
            classes, dims = _labels(rows), len(rows.first()["x"])
            outs = 1 if len(classes) == 2 else len(classes)
            w, live = np.zeros((len(each), outs, dims + 1)), np.ones(len(each), bool)
            for _ in range(max(e.getOrDefault("epochs") for e in each)):
                mixed, wrong = _mix(rows, w, classes, dims)
                for i in np.flatnonzero(live):
                    w[i] = mixed[i]
                    if each[i].getOrDefault("penalty") != "none":
                        w[i, :, :-1] = _shrink(w[i, :, :-1], each[i].getOrDefault("penalty"), each[i].getOrDefault("alpha"), 1.0, each[i].getOrDefault("l1Ratio"))
                    elif not wrong[i]:
                        live[i] = False
                if not live.any():
                    break
            return [LinearClassesModel(classes=classes, weight=w[i], kind=0.0)._like(e) for i, e in enumerate(each)]
        finally:
            rows.unpersist()

    _fit, fitMultiple = _fits_all(_fit_all)


def _mix(rows: DataFrame, w: np.ndarray, classes: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the shards' weights averaged, and each candidate's mistakes."""

    def run(batches):
        held, own, n, wrong, shard = [], None, 0, None, None
        for b in batches:
            x = np.hstack([_arrays(b, dims), np.ones((b.num_rows, 1))])
            t, weight, part = _targets(b.column(1).to_numpy(), classes), b.column(2).to_numpy(), b.column(4).to_pylist()
            for i in range(b.num_rows):
                if part[i] != shard:
                    held += [] if own is None else [(own * n, n, wrong)]
                    own, n, wrong, shard = w.copy(), 0, np.zeros(len(w)), part[i]
                miss = t[i] * (own @ x[i]) <= 0  # (candidates, outputs)
                if miss.any():
                    own += (miss * t[i] * weight[i])[:, :, None] * x[i]
                    wrong += miss.sum(1)
                n += 1
        held += [] if own is None else [(own * n, n, wrong)]
        if held:
            total = np.concatenate([sum(h[0] for h in held).ravel(), [sum(h[1] for h in held)], sum(h[2] for h in held)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "s"])

    got = rows.mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros(w.size + 1 + len(w))
    total[got.column("at").to_numpy()] = got.column("s").to_numpy()
    return (total[: w.size] / max(total[w.size], 1)).reshape(w.shape), total[w.size + 1 :]


class LinearClassesModel(_Classifies):
    def _dims(self, m: dict) -> int:
        return m["weight"].shape[1] - 1

    @property
    def coefficients(self) -> np.ndarray:
        return self.numbers["weight"][:, :-1]

    def _scores(self, x, m):
        f = x @ m["weight"][:, :-1].T + m["weight"][:, -1]
        two = len(m["classes"]) == 2
        y = m["classes"][(f[:, 0] > 0).astype(int) if two else f.argmax(1)]
        if not m["kind"]:
            return y, None
        p = np.clip((f + 1) / 2, 0, 1) if m["kind"] == 1 else 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        if two:
            return y, np.hstack([1 - p, p])
        return y, np.where(p.sum(1, keepdims=True) > 0, p / np.maximum(p.sum(1, keepdims=True), 1e-300), 1 / p.shape[1])


# projections


class _Projection(_Fitted, HasOutputCol):
    """(x - center) times the columns of ``axes``."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        m = self.numbers
        move = pandas_udf(lambda x: pd.Series(list((_stack(x) - m["center"]) @ m["axes"])), "array<double>")
        return dataset.withColumn(self.getOutputCol(), array_to_vector(move(vector_to_array(self.getFeaturesCol()))))

    @property
    def axes(self) -> np.ndarray:
        return self.numbers["axes"]


class FisherLDAModel(_Projection):
    pass


class RandomizedPCAModel(_Projection):
    pass


def _signed(axes: np.ndarray) -> np.ndarray:
    """Each column's entry of largest size is positive."""
    return axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)


class FisherLDA(Estimator, HasFeaturesCol, HasLabelCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fisher's discriminants as a stage: at most ``nComponents`` of the classes - 1 directions, from the class moments."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", outputCol="selected", nComponents=None):
        super().__init__()
        self.nComponents = Param(self, "nComponents", "directions at most", TypeConverters.toInt)
        self._setDefault(labelCol="y", outputCol="selected")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FisherLDAModel:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).persist()
        try:
            stats = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").collect()
            ys, n = [r["y"] for r in stats], np.array([r["n"] for r in stats], float)
            spread = _class_scatter(rows, ys, len(rows.first()["x"]), n)
        finally:
            rows.unpersist()
        share = n / n.sum()
        grand = sum(s * spread[y][0] for s, y in zip(share, ys, strict=True))
        within = sum(s * spread[y][1] for s, y in zip(share, ys, strict=True))
        between = sum(s * np.outer(spread[y][0] - grand, spread[y][0] - grand) for s, y in zip(share, ys, strict=True))
        val, vec = np.linalg.eig(np.linalg.pinv(within) @ between)
        k = min(len(ys) - 1, self.getOrDefault("nComponents") if self.isDefined("nComponents") else len(ys) - 1)
        return FisherLDAModel(center=grand, axes=_signed(np.real(vec[:, np.argsort(-np.real(val), kind="stable")[:k]])))._like(self)


class RandomizedPCA(Estimator, HasFeaturesCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Principal components by a randomised range finder.

    A Gaussian sketch of k + ``oversample`` columns goes through the centred rows ``power`` times and once more, each a
    pass that sums x (x^T q) over the tasks; then one small decomposition. No d x d matrix is made. ``whiten`` divides each
    component by its standard deviation.
    """

    @keyword_only
    def __init__(self, *, featuresCol="features", outputCol="selected", k=10, power=3, oversample=10, whiten=False, seed=0):
        super().__init__()
        self.k = Param(self, "k", "components", TypeConverters.toInt)
        self.power = Param(self, "power", "passes of the sketch", TypeConverters.toInt)
        self.oversample = Param(self, "oversample", "columns of the sketch beyond k", TypeConverters.toInt)
        self.whiten = Param(self, "whiten", "components of variance 1", TypeConverters.toBoolean)
        self._setDefault(k=10, power=3, oversample=10, whiten=False, seed=0, outputCol="selected")
        self._set(**{k_: v for k_, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RandomizedPCAModel:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x")).persist()
        try:
            dims = len(rows.first()["x"])
            total = summed(rows, lambda b: np.append(_arrays(b, dims).sum(0), b.num_rows), dims + 1)
            n, mean = total[-1], total[:-1] / total[-1]
            size = min(dims, self.getOrDefault("k") + self.getOrDefault("oversample"))
            q = np.random.default_rng(self.getSeed()).standard_normal((dims, size))

            def through(b, q):
                x = _arrays(b, dims) - mean
                return (x.T @ (x @ q)).ravel()

            for _ in range(self.getOrDefault("power")):
                q = np.linalg.qr(summed(rows, lambda b, q=q: through(b, q), dims * size).reshape(dims, size))[0]

            def inner(b, q=q):
                p = (_arrays(b, dims) - mean) @ q
                return (p.T @ p).ravel()

            small = summed(rows, inner, size * size).reshape(size, size) / n
        finally:
            rows.unpersist()
        val, vec = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-val, kind="stable")[: self.getOrDefault("k")]
        axes = _signed(q @ vec[:, order])
        if self.getOrDefault("whiten"):
            axes = axes / np.sqrt(np.maximum(val[order], 1e-300))
        return RandomizedPCAModel(center=mean, axes=axes)._like(self)
