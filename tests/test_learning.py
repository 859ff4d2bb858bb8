"""Cross-validation, experiments and own estimators against plain numpy."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cohortlake.operators import crossval, estimators, experiments, extratrees, features, learning


def blobs(seed=7, n=90, d=5, classes=2, gap=3.0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % classes
    x = rng.normal(size=(n, d))
    x[:, 1] += gap * y
    x[:, 3] -= gap * (y == classes - 1)
    return x, y


def frame(spark, x, y, weight=None):
    rows = [(i, Vectors.dense(v), float(c), float(1 if weight is None else weight[i])) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["sample_id", "features", "y", "weight"]).repartition(3)


def tables(spark, x, y, folds=3):
    feats = spark.createDataFrame([(i, f, float(v)) for i, row in enumerate(x) for f, v in enumerate(row)], "sample_id long, feature_id int, value double")
    labels = spark.createDataFrame([(i, int(c), i // 2 % folds) for i, c in enumerate(y)], "sample_id long, y int, fold int")
    return feats, labels


# cross-validation


def test_folds_equal_a_run_of_each_fold_alone(spark):
    """Scaling, preselection, weights and predictions of each fold, worked out from its training rows alone."""
    x, y = blobs(n=80)
    x[:, 4] = 2.5  # no spread
    y = np.where(np.arange(80) % 5 == 0, 1, 0)
    x[:, 1] += 3 * y
    feats, labels = tables(spark, x, y)
    fold = np.arange(80) // 2 % 3
    presel = crossval.Preselection("pearson", "percentile", 50)
    cv = crossval.cross_validate(feats, labels, "gmm", presel, grid=[{"nComponents": 1, "covarianceType": "diag"}])
    rows = {(r["fold"], r["sample_id"]): r for r in crossval.training_table(feats, labels, crossval.fold_measures(feats, labels, presel)).collect()}
    got = {(r["fold"], r["sample_id"]): r for r in cv.predictions.collect()}
    measured = {(r["fold"], r["feature_id"]): r["measure"] for r in cv.selected.collect()}
    assert len(got) == 80 and len(rows) == 240 and len(measured) == 15
    for k in range(3):
        train = fold != k
        mu, sd = x[train].mean(0), x[train].std(0)
        z = (x - mu) / np.where(sd == 0, 1, sd)
        r = np.array([0 if sd[f] == 0 else abs(np.corrcoef(z[train, f], y[train])[0, 1]) for f in range(5)])
        r = np.where(r >= np.percentile(r, 50), r, 0)
        assert np.allclose([measured[k, f] for f in range(5)], r)
        z = z[:, r > 0]
        n = np.bincount(y[train])
        score = np.stack([np.log(n[c] / n.sum()) - 0.5 * (np.log((v := z[train & (y == c)].var(0) + 1e-6)) + (z - z[train & (y == c)].mean(0)) ** 2 / v).sum(1) for c in (0, 1)], 1)
        for i in range(80):
            assert np.allclose(rows[k, i]["features"].toArray(), z[i]) and rows[k, i]["is_test"] == (fold[i] == k)
            assert np.isclose(rows[k, i]["weight"], 1 if fold[i] == k else n.sum() / (2 * n[y[i]]))
        for i in np.flatnonzero(~train):
            p = np.exp(score[i] - score[i].max())
            assert got[k, i]["y_pred"] == score[i].argmax() and np.allclose(got[k, i]["probabilities"], p / p.sum()) and got[k, i]["y_true"] == y[i]


def test_grid_scores_and_importances_are_kept(spark):
    x, y = blobs()
    feats, labels = tables(spark, x, y)
    cv = crossval.cross_validate(feats, labels, "cart", grid=[{"maxDepth": 1, "impurity": "gini"}, {"maxDepth": 4, "impurity": "entropy"}])
    fits = cv.fits.orderBy("fold").collect()
    assert [f["fold"] for f in fits] == [0, 1, 2] and all(f["n_features"] == 5 and 0.5 < f["score"] <= 1 for f in fits)
    assert all(json.loads(f["params"]) in ({"maxDepth": 1, "impurity": "gini"}, {"maxDepth": 4, "impurity": "entropy"}) for f in fits)
    imp = {}
    for r in cv.importances.collect():
        imp.setdefault(r["fold"], {})[r["feature_id"]] = r["importance"]
    assert set(imp) == {0, 1, 2} and all(np.isclose(sum(v.values()), 1) and max(v, key=v.get) in (1, 3) for v in imp.values())
    # the score is the mean accuracy over the inner folds
    rows = crossval.training_table(feats, labels, crossval.fold_measures(feats, labels)).filter("fold = 0 and not is_test")
    estimator, maps = learning.classifier("cart", grid=[json.loads(fits[0]["params"])])
    alone = [crossval.accuracy(estimator.fit(own, maps[0]).transform(rest)) for own, rest in crossval.inner_folds(rows, "sample_id")]
    assert np.isclose(np.mean(alone), fits[0]["score"])


def test_fold_without_features(spark):
    """A fold in which no feature survives has no predictions; classes of one size and constant features measure 0."""
    y = np.arange(12) % 2
    feats, labels = tables(spark, np.ones((12, 2)), y)
    cv = crossval.cross_validate(feats, labels, "gmm", crossval.Preselection("pearson", "percentile", 50), grid=[{"nComponents": 1}])
    assert cv.predictions.count() == 0 and {(r["fold"], r["n_features"]) for r in cv.fits.collect()} == {(0, 0), (1, 0), (2, 0)}
    assert cv.importances.count() == 0 and {r["measure"] for r in cv.selected.collect()} == {0.0}


def test_selectors_in_a_fold(spark):
    x, y = blobs()
    feats, labels = tables(spark, x, y)
    parts = [learning.feature_selector("anova", out="sel0", k=2), learning.feature_selector("lda", out="sel1")]
    p = crossval.cross_validate(feats, labels, "gmm", grid=[{"nComponents": 1}], selectors=parts).predictions
    assert p.select(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0] > 0.9


# experiments


def test_experiments_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    x, y = blobs(n=60)
    feats, labels = tables(spark, x, y)
    configs = spark.createDataFrame([(f"c/{i} %", "gmm", "pearson", 10.0 * i) for i in range(4)], "config_id string, cl string, prefs string, prefs_thr double")
    table = experiments.ResultsTable(spark, str(tmp_path / "results"))
    ran = []
    plain = experiments.cross_validate

    def breaks(features, labels, name, presel, **more):
        if presel.thr == 20.0 and not ran.count("broken"):
            ran.append("broken")
            raise RuntimeError("lost")
        ran.append(presel.thr)
        return plain(features, labels, name, presel, **more)

    monkeypatch.setattr(experiments, "cross_validate", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        experiments.run_experiments(feats, labels, configs, table, grid=[{"nComponents": 1}])
    assert table.done() == ["c/0 %", "c/1 %", "c/3 %"] and sorted(r for r in ran if r != "broken") == [0.0, 10.0, 30.0]
    # a configuration that was cut off before its metrics does not count, and is written over
    (tmp_path / "results" / "config=c%2F1 %".replace(" %", "%20%25") / "metrics" / "_SUCCESS").unlink()
    assert table.done() == ["c/0 %", "c/3 %"]
    ran.clear()
    ran.append("broken")
    out = experiments.run_experiments(feats, labels, configs, table, grid=[{"nComponents": 1}])
    assert sorted(r for r in ran if r != "broken") == [10.0, 20.0] and out.count() == 12
    assert {r["config_id"] for r in out.collect()} == set(table.done()) and len(table.done()) == 4
    ran.clear()
    again = experiments.run_experiments(feats, labels, configs, table, grid=[{"nComponents": 1}])
    assert not ran and sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert table.read("predictions").count() == 240 and set(table.read("fits").columns) >= {"config_id", "params", "n_features"}


# mixtures


def plain_em(x, means, kind, floor, steps):
    """EM of one mixture, a component at a time."""
    n, d = x.shape
    k = len(means)
    mean, w = means.copy(), np.full(k, 1 / k)
    cov = np.cov(x.T, bias=True) + floor * np.eye(d)
    if kind == "diag":
        cov = np.diag(np.diag(cov))
    if kind == "spherical":
        cov = np.eye(d) * np.diag(cov).mean()
    covs, likes = [cov.copy() for _ in range(k)], []
    for _ in range(steps):
        logs = np.stack([np.log(w[j]) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(covs[j])[1] + np.einsum("ij,jk,ik->i", x - mean[j], np.linalg.inv(covs[j]), x - mean[j])) for j in range(k)], 1)
        whole = np.logaddexp.reduce(logs, axis=1)
        r = np.exp(logs - whole[:, None])
        likes.append(whole.mean())
        w = r.sum(0) / n
        mean = (r.T @ x) / r.sum(0)[:, None]
        own = [((x - mean[j]).T * r[:, j]) @ (x - mean[j]) for j in range(k)]
        if kind == "tied":
            covs = [sum(own) / n + floor * np.eye(d)] * k
        else:
            covs = [s / r[:, j].sum() + floor * np.eye(d) for j, s in enumerate(own)]
            if kind == "diag":
                covs = [np.diag(np.diag(c)) for c in covs]
            if kind == "spherical":
                covs = [np.eye(d) * np.diag(c).mean() for c in covs]
    return w, mean, likes


@pytest.mark.parametrize("kind", ["full", "tied", "diag", "spherical"])
def test_mixtures_equal_plain_em(spark, kind):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(60, 3)) * [1, 2, 0.5] + [4 * (i % 2), 0, 3 * (i // 2)] for i in range(4)])
    y = np.arange(240) // 120
    df = frame(spark, x, y)
    e = estimators.GaussianClasses(nComponents=3, covarianceType=kind, maxIter=12, tol=-1.0)
    model = e.fit(df)
    starts = estimators._first_rows(df.select(vector_to_array("features").alias("x"), "y", F.lit(0)), 3, 0)
    m = model.numbers
    for c in (0, 1):
        w, mean, likes = plain_em(x[y == c], starts[c], kind, 1e-6, 12)
        assert np.allclose(model.log_likelihoods[c], likes, atol=1e-7)
        assert np.all(np.diff(likes) > -1e-9)
        assert np.allclose(m["mean"][m["owner"] == c], mean, atol=1e-5) and np.allclose(np.exp(m["log_weight"][m["owner"] == c]), w / 2, atol=1e-6)
    p = model.transform(df).select("y", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r["y"] == r["prediction"] for r in p]) > 0.8 and all(np.isclose(sum(r["p"]), 1) for r in p)


def test_candidates_share_passes_and_equal_single_fits(spark):
    x, y = blobs(n=60, classes=3)
    df = frame(spark, x, y)
    for name, grid in (("gmm", [{"nComponents": 1, "covarianceType": "diag"}, {"nComponents": 2, "covarianceType": "tied"}]), ("sgd", [{"loss": "log", "penalty": "l1", "alpha": 0.01}, {"loss": "hinge", "penalty": "l2", "alpha": 0.1}]), ("percep", [{"penalty": "none"}, {"penalty": "l2", "alpha": 0.1}])):
        e, maps = learning.classifier(name, 5, 3, grid=grid)
        for i, model in e.fitMultiple(df, maps):
            alone = e.fit(df, maps[i])
            assert all(np.allclose(v, alone.numbers[k]) for k, v in model.numbers.items())


# linear models


def plain_sgd(x, t, weight, part, loss, penalty, alpha, steps, rate0=0.5, n_batches=4):
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((t.shape[1], x1.shape[1]))
    for step in range(steps):
        own = part == step % n_batches
        if not own.any():
            continue
        slope = np.zeros_like(w)
        for xi, ti, wi in zip(x1[own], t[own], weight[own], strict=True):
            for o in range(len(w)):
                z = ti[o] * (w[o] @ xi)
                d = {"hinge": -1.0 if z < 1 else 0.0, "modified_huber": 0.0 if z >= 1 else (-2 * (1 - z) if z >= -1 else -4.0), "log": -1 / (1 + np.exp(z))}[loss]
                slope[o] += wi * d * ti[o] * xi
        rate = rate0 / np.sqrt(1 + step)
        w -= rate * slope / weight[own].sum()
        l1, l2 = {"l1": (1, 0), "l2": (0, 1), "elasticnet": (0.15, 0.85)}[penalty]
        v = w[:, :-1] / (1 + l2 * alpha * rate)
        w[:, :-1] = np.sign(v) * np.maximum(np.abs(v) - l1 * alpha * rate, 0)
    return w


@pytest.mark.parametrize("loss,penalty,classes", [("hinge", "l1", 2), ("modified_huber", "elasticnet", 2), ("log", "l2", 3)])
def test_sgd_equals_plain_steps(spark, loss, penalty, classes):
    x, y = blobs(n=80, classes=classes)
    weight = np.linspace(0.5, 2, 80)
    df = frame(spark, x, y, weight)
    e = estimators.SGDClassifier(weightCol="weight", loss=loss, penalty=penalty, alpha=0.02, epochs=5, seed=4)
    part = {r["sample_id"]: r["p"] for r in df.select("sample_id", F.pmod(F.xxhash64(vector_to_array("features"), "y", F.lit(4)), F.lit(4)).alias("p")).collect()}
    t = np.where(y[:, None] == ([1] if classes == 2 else [0, 1, 2]), 1.0, -1.0)
    want = plain_sgd(x, t, weight, np.array([part[i] for i in range(80)]), loss, penalty, 0.02, 20)
    model = e.fit(df)
    assert np.allclose(model.numbers["weight"], want, atol=1e-9)
    out = model.transform(df).select("y", "prediction").collect()
    assert np.mean([r["y"] == r["prediction"] for r in out]) > 0.75
    assert ("probability" in model.transform(df).columns) == (loss != "hinge")


def test_one_shard_is_the_sequential_perceptron(spark):
    x, y = blobs(n=70, gap=1.0)
    df = frame(spark, x, y)
    order = [r["sample_id"] for r in df.withColumn("h", F.xxhash64(vector_to_array("features"), "y", F.lit(0))).orderBy("h").collect()]
    w = np.zeros(6)
    for _ in range(4):
        for i in order:
            xi, t = np.append(x[i], 1), 2 * y[i] - 1
            if t * (w @ xi) <= 0:
                w += t * xi
    model = estimators.MixedPerceptron(epochs=4, shards=1).fit(df)
    assert np.allclose(model.numbers["weight"][0], w)


def test_mixed_perceptron_separates(spark):
    x, y = blobs(n=200, gap=12.0)
    df = frame(spark, x, y)
    model = estimators.MixedPerceptron(epochs=60, shards=5).fit(df)
    assert model.transform(df).filter("y <> prediction").count() == 0
    three = frame(spark, *blobs(n=90, classes=3, gap=12.0))
    assert estimators.MixedPerceptron(epochs=60, shards=3).fit(three).transform(three).filter("y <> prediction").count() < 9


# projections


def test_lda_stage_in_a_pipeline_is_saved_and_loaded(spark, tmp_path):
    x, y = blobs(classes=3)
    df = frame(spark, x, y)
    e, maps = learning.classifier("gmm", grid=[{"nComponents": 1}])
    model = learning.build_pipeline([learning.feature_selector("lda", out="sel0")], e).fit(df, maps[0])
    assert isinstance(model, PipelineModel) and model.stages[0].axes.shape == (5, 2)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    rows = lambda m: sorted((r["sample_id"], r["prediction"], tuple(r["sel0"].toArray())) for r in m.transform(df).collect())
    assert rows(model) == rows(again)
    within = sum(np.cov(x[y == c].T, bias=True) * (y == c).mean() for c in range(3))
    between = sum((y == c).mean() * np.outer(x[y == c].mean(0) - x.mean(0), x[y == c].mean(0) - x.mean(0)) for c in range(3))
    val = np.sort(np.real(np.linalg.eigvals(np.linalg.inv(within) @ between)))[::-1][:2]
    a = model.stages[0].axes
    assert np.allclose([(v @ between @ v) / (v @ within @ v) for v in a.T], val)


def test_randomised_components_span_the_exact_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 3)) @ rng.normal(size=(3, 30)) + 5
    df = frame(spark, x, np.zeros(150))
    model = estimators.RandomizedPCA(k=3, power=2, oversample=4).fit(df)
    _, size, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    a = model.axes
    assert np.allclose(a @ a.T, vt[:3].T @ vt[:3], atol=1e-6)
    white = estimators.RandomizedPCA(k=3, power=2, whiten=True).fit(df).transform(df).select("selected").collect()
    assert np.allclose(np.std([r["selected"].toArray() for r in white], axis=0), 1)
    p = Pipeline(stages=[learning.feature_selector("rpca", k=2)]).fit(df).transform(df)
    assert len(p.first()["selected"]) == 2


def test_grids(spark):
    """All candidates that there are to be; every one of them is a parameter of its estimator."""
    sizes = {"cart": 6, "rf": 72, "gmm": 12, "linsvm": 7, "sgd": 54, "percep": 28}
    assert {n: len(learning.classifier(n, 40)[1]) for n in sizes} == sizes
    with pytest.raises(ValueError):
        learning.classifier("other")
    assert len(learning.selector_grid("rpca", 40)) == 48 and learning.selector_grid("anova", 6) == [{"selectionThreshold": k} for k in (1, 3, 5)]


def test_measures_by_fold_equal_those_of_each_fold(spark):
    x, y = blobs(n=60)
    feats, labels = tables(spark, x, y)
    m = features.train_moments(features.moments(feats, labels, ("fold", "feature_id", "y")))
    for method in ("pearson", "bhattacharyya", "welcht"):
        both = {(r["fold"], r["feature_id"]): r["measure"] for r in features.measure_features(m, method, ("fold", "feature_id")).collect()}
        for k in range(3):
            own = labels.filter(F.col("fold") != k).select("sample_id", "y")
            alone = features.measure_features(features.moments(feats, own), method).collect()
            assert all(np.isclose(both[k, r["feature_id"]], r["measure"]) for r in alone)


# extremely randomised trees


def plain_extra_trees(x, y, trees, tried, depth, seed):
    """One tree and node at a time."""
    total = np.zeros((trees, x.shape[1]))
    measure = lambda own: 1 - sum(((y[own] == c).mean()) ** 2 for c in np.unique(y))
    for t in range(trees):
        todo = [(1, np.arange(len(x)), 0)]
        while todo:
            node, own, level = todo.pop()
            if level == depth or len(np.unique(y[own])) < 2:
                continue
            feats, share = extratrees.draws(seed, t, node, x.shape[1], tried)
            best = None
            for f, u in zip(feats, share, strict=True):
                v = x[own, f]
                if v.min() < v.max():
                    left = v <= v.min() + u * (v.max() - v.min())
                    gain = measure(own) - (left.sum() * measure(own[left]) + (~left).sum() * measure(own[~left])) / len(own)
                    if best is None or round(gain, 12) > round(best[0], 12):
                        best = gain, f, left
            if best:
                total[t, best[1]] += len(own) / len(x) * best[0]
                todo += [(2 * node, own[best[2]], level + 1), (2 * node + 1, own[~best[2]], level + 1)]
    return (total / total.sum(1, keepdims=True)).mean(0)


@pytest.mark.parametrize("classes,tried", [(2, 2), (3, 5)])
def test_extra_trees_equal_one_node_at_a_time(spark, classes, tried):
    x, y = blobs(n=90, classes=classes, gap=1.5)
    x[:, 2] = 1
    model = extratrees.ExtraTreesSelector(k=2, trees=7, tried=str(tried), maxDepth=5, seed=3).fit(frame(spark, x, y))
    want = plain_extra_trees(x, y, 7, tried, 5, 3)
    assert np.allclose(model.featureImportances, want) and model.indices == sorted(np.argsort(-want, kind="stable")[:2].tolist())
    assert extratrees.ExtraTreesSelector(trees=3).fit(frame(spark, x, np.zeros(90))).indices == [0, 1, 2, 3, 4]  # one class: all measure 0


def test_extra_trees_stage_is_saved_and_loaded(spark, tmp_path):
    x, y = blobs()
    df = frame(spark, x, y)
    stage = learning.feature_selector("extratrees", k=2)
    model = Pipeline(stages=[stage.copy({stage.trees: 5})]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    rows = lambda m: sorted((r["sample_id"], tuple(r["selected"].toArray())) for r in m.transform(df).collect())
    assert rows(PipelineModel.load(str(tmp_path / "m"))) == rows(model) and len(rows(model)[0][1]) == 2
