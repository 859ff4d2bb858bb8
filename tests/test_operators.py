"""Known answers, brute force and properties where SQL has no say."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import deid, endmembers, evaluation, features, files, idsets, learning, thresholds, timeseries, voxels


def values(spark, xs, grp="g"):
    return spark.createDataFrame([(grp, i, float(x)) for i, x in enumerate(xs)], "grp string, feature_id long, value double")


def test_spread(spark):
    items = spark.range(10)
    assert sorted(r[0] for r in features.spread(items, 3, "id").select("id").collect()) == [0, 4, 7]


def test_moments_of_a_sample(spark):
    df = spark.createDataFrame([(0, float(x)) for x in (1, 2, 2, 3, 9, 20)], "sample_id int, value double")
    r = features.sample_stats(df).first()
    assert [round(r[c], 6) for c in ("var", "median", "kurtosis", "skewness")] == [45.138889, 2.5, 0.116493, 1.294541]


def test_rank_threshold_counts(spark):
    out = thresholds.rank_threshold(values(spark, range(1, 101)), 95)
    assert out.filter("value = 0").count() == 94


def test_percentile_ignores_nan(spark):
    out = {r["feature_id"]: r["value"] for r in thresholds.percentile_threshold(values(spark, [1, 2, 3, float("nan")]), 50).collect()}
    assert out == {0: 0.0, 1: 2.0, 2: 3.0, 3: 0.0}


def test_percentile_between_equal_values_is_that_value(spark):
    """0.3 x 1601.24 + 0.7 x 1601.24 is more than 1601.24 in doubles."""
    out = thresholds.percentile_threshold(values(spark, [1601.24] * 4), 90)
    assert [r["value"] for r in out.collect()] == [1601.24] * 4


def robust_plain(v, bins=1000):
    """The zooming limits, one value at a time."""
    v = np.asarray(v, float)
    lo, hi, n = v.min(), v.max(), len(v)
    all_lo, all_hi, bottom, top, first, last = lo, hi, 0, 0, 0, bins - 1
    for jump in range(1, 11):
        if jump > 1:
            bottom, top = max(bottom - 1, 0), min(top + 1, bins - 1)
            lo, hi = lo + bottom / bins * (hi - lo), lo + (top + 1) / bins * (hi - lo)
        if jump == 10 or lo == hi:
            lo, hi = all_lo, all_hi
            if lo == hi:
                return lo, hi
        b = np.clip(np.trunc(v * (bins / (hi - lo)) - lo * (bins / (hi - lo))), 0, bins - 1).astype(int)
        h = np.bincount(b, minlength=bins)
        if jump == 10:
            n, first, last = n - h[0] - h[-1], 1, bins - 2
        bottom = next(i for i in range(first, bins) if h[first : i + 1].sum() >= n / 50)
        top = next(i for i in range(last, -1, -1) if h[i : last + 1].sum() >= n / 50)
        w = (hi - lo) / bins
        t2, t98 = lo + bottom * w, lo + (top + 1) * w
        if t98 - t2 >= (hi - lo) / 10:
            break
    return t2, t98


@pytest.mark.parametrize("seed", range(4))
def test_robust_limits_zoom(spark, seed):
    rng = np.random.default_rng(seed)
    xs = np.concatenate([rng.normal(5, 0.01, 500), [1e4 * (seed + 1)], [-300.0] * (seed % 2)])
    r = thresholds.robust_limits(values(spark, xs)).first()
    assert np.allclose((r["t2"], r["t98"]), robust_plain(xs), rtol=1e-9)


def test_robust_limits_of_equal_values(spark):
    r = thresholds.robust_limits(values(spark, [3, 3, 3])).first()
    assert (r["t2"], r["t98"]) == (3, 3)


def test_drain_cube(spark):
    cube = spark.createDataFrame([(i, j, k, 1) for i in range(5) for j in range(5) for k in range(5)], "i int, j int, k int, roi int")
    assert voxels.drain_rois(cube).count() == 98


def test_mask_and_empty_tables(spark):
    v = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 1, 0, 0, 2.0)], "volume_id string, i int, j int, k int, value double")
    m = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 0.0)], "i int, j int, k int, value double")
    assert [r["value"] for r in voxels.apply_mask(v, m).collect()] == [1.0]
    assert voxels.apply_mask(v.limit(0), m).count() == 0 and voxels.apply_mask(v, m.limit(0)).count() == 0


def test_fold_metrics_known(spark):
    p = spark.createDataFrame([("c", 0, i, t, q) for i, (t, q) in enumerate(zip((1, 1, 0, 0), (1, 0, 0, 0)))], "config_id string, fold int, sample_id int, y_true int, y_pred int")
    r = evaluation.fold_metrics(p).first()
    assert [round(r[c], 6) for c in ("acc", "sens", "spec", "prec", "f1", "auc")] == [0.75, 0.5, 1, 1, 0.666667, 0.75]
    one = evaluation.fold_metrics(p.filter("y_true = 1")).first()
    assert one["auc"] is None and one["spec"] == 0


def test_fisher():
    assert round(evaluation.fisher_exact(3, 1, 1, 3), 6) == 0.485714
    assert evaluation.fisher_exact(5, 0, 0, 5) == pytest.approx(2 / math.comb(10, 5))


def test_filter_series_of_mixed_lengths(spark):
    """Each series is filtered as if it were alone; the reference result is a convolution of each padded row, both ways."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate([60, 200, 60, 33, 200, 61])] + [(6, None), (7, [])]
    out = {r["id"]: r["ts"] for r in timeseries.filter_series(spark.createDataFrame(rows, "id int, ts array<double>"), 0.01, 0.1, 2.0, "fir", order=16).collect()}
    assert out[6] is None and out[7] == []
    t = np.arange(17) - 8
    kernel = (0.4 * np.sinc(0.4 * t) - 0.04 * np.sinc(0.04 * t)) * np.hamming(17)
    for i, x in rows[:6]:
        x = np.array(x)
        if len(x) < 48:
            want = timeseries.band_pass(x[None], 0.01, 0.1, 2.0, "fourier")[0]
        else:
            want = x - x.mean()
            for _ in range(2):
                want = np.convolve(np.pad(want, 8, mode="reflect"), kernel, mode="valid")[::-1]
            want = want + x.mean()
        assert out[i] == pytest.approx(want, abs=1e-12)


def test_rogers_tanimoto_by_brute_force(spark):
    rng = np.random.default_rng(8)
    chosen = {c: {int(f) for f in rng.integers(0, 30, 12)} for c in "abcde"}
    rows = [(c, f, 1.0) for c, fs in chosen.items() for f in fs] + [("a", 99, 0.0), ("a", min(chosen["a"]), 2.0)]
    out = {(r["a"], r["b"]): r["value"] for r in evaluation.rogers_tanimoto_matrix(spark.createDataFrame(rows, "config_id string, feature_id int, weight double"), 100).collect()}
    assert out == {(a, b): pytest.approx(2 * len(x ^ y) / (100 + len(x ^ y))) for a, x in chosen.items() for b, y in chosen.items()}


def test_rogers_tanimoto(spark):
    s = spark.createDataFrame([("A", 0, 1, 1.0), ("A", 0, 2, 1.0), ("B", 0, 2, 1.0), ("B", 0, 3, 1.0)], "config_id string, fold int, feature_id int, weight double")
    out = {(r["a"], r["b"]): r["value"] for r in evaluation.rogers_tanimoto_matrix(s, 4).collect()}
    assert out["A", "B"] == pytest.approx(2 / 3) and out["A", "A"] == 0 and out["B", "A"] == out["A", "B"]


def test_id_sets(spark):
    rows = [("A", "a", "r1", 1), ("A", "a", "r2", 2), ("A", "b", "r3", 3), ("A", None, "r4", 4), ("B", "b", "s1", 1), ("B", "c", None, 2)]
    ids = spark.createDataFrame(rows, "set_name string, id string, ref string, pos long")
    assert [tuple(r) for r in idsets.id_repetitions(ids).collect()] == [("A", "a", 2)]
    out = {tuple(r) for r in idsets.compare_idsets(ids, "A", "B").collect()}
    assert out == {("A", "B", "a", "r1"), ("A", "B", None, "r4"), ("B", "A", "c", "Not found")}


def test_curve_groups(spark):
    t = spark.createDataFrame([("f", 0x5012, 0, "", "x", "1"), ("f", 0x6000, 0, "", "y", "2"), ("f", 0x11, 0, "", "z", "3")], "file string, grp int, elem int, vr string, keyword string, value string")
    assert [r["keyword"] for r in deid.anonymize_headers(t).collect()] == ["y"]


def test_lattice_memories(spark):
    s = spark.createDataFrame([(0, [1.0, 3.0]), (1, [2.0, 5.0])], "id long, x array<double>")
    got = {(r["b"], r["c"]): (r["w"], r["m"]) for r in endmembers.lattice_memories(s).collect()}
    assert got == {(0, 0): (0, 0), (0, 1): (-3, -2), (1, 0): (2, 3), (1, 1): (0, 0)}


def test_atgp_against_projection(spark):
    x = np.random.default_rng(1).normal(size=(60, 5))
    s = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    want, u = [int((x**2).sum(1).argmax())], None
    for _ in range(2):
        u = x[want].T
        p = np.eye(5) - u @ np.linalg.pinv(u)
        want.append(int(((x @ p) ** 2).sum(1).argmax()))
    assert endmembers.atgp(s, 3) == want


def test_nfindr_finds_corners(spark):
    rng = np.random.default_rng(2)
    corners = np.array([[0, 0, 0.0], [10, 0, 0], [0, 10, 0], [0, 0, 10]])
    w = rng.dirichlet(np.ones(4), 80) * 0.9 + 0.025
    x = np.vstack([corners, w @ corners])
    s = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    assert sorted(endmembers.nfindr(s, 4)) == [0, 1, 2, 3]


def test_virtual_dimensionality(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) @ rng.normal(size=(2, 6)) * 10 + 30 + rng.normal(size=(400, 6)) * 0.01
    s = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    n, mean, cov = endmembers.moments(s)
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    assert 1 <= endmembers.virtual_dimensionality(s)[1e-3] <= 6


def test_inductions_pick_rows():
    x = np.random.default_rng(4).normal(size=(40, 3))
    for own in (endmembers.ilsia(x), endmembers.eiha(x), endmembers.ilsia(x, alpha=0.5)):
        assert len(own) == len(set(own)) >= 1 and all(0 <= i < 40 for i in own)
    x = np.abs(x) + 0.1
    e = endmembers.cca_endmembers(x.T @ x / len(x), 3)
    assert len(e) <= 3 and (e > -1e-6).all()


def test_group_products(spark, monkeypatch):
    monkeypatch.setattr(endmembers, "HELD_BYTES", 100)
    x = np.random.default_rng(11).normal(size=(90, 4))
    s = spark.createDataFrame([("a" if i % 3 else None, i, v.tolist()) for i, v in enumerate(x)], "label string, id long, x array<double>").repartition(5)
    for centred in (False, True):
        z = x - x.mean(1, keepdims=True) if centred else x
        got = {r["label"]: (r["n"], r["m"]) for r in endmembers.products(s, ["label"], centred).collect()}
        for label, rows in (("a", np.arange(90) % 3 > 0), (None, np.arange(90) % 3 == 0)):
            assert got[label][0] == rows.sum() and np.allclose(np.reshape(got[label][1], (4, 4)), z[rows].T @ z[rows])
    assert endmembers.products(s.limit(0), ["label"]).count() == 0
    cone = endmembers.induce_cone(s.withColumn("x", F.transform("x", lambda v: F.abs(v) + 0.1)).filter("label is not null"), ["label"], 2).collect()
    want = np.abs(x[np.arange(90) % 3 > 0]) + 0.1
    assert np.allclose([r["x"] for r in sorted(cone, key=lambda r: r["comp"])], endmembers.cca_endmembers(want.T @ want / len(want), 2))


def test_filters():
    t = np.arange(256) * 2.0
    slow, fast = np.sin(2 * np.pi * 0.02 * t), np.sin(2 * np.pi * 0.2 * t)
    for method in ("fourier", "fir", "boxcar"):
        out = timeseries.band_pass((slow + fast + 5)[None], 0.005, 0.08, 2.0, method)[0]
        assert out.mean() == pytest.approx(5, abs=0.3)
        assert np.corrcoef(out[30:-30], slow[30:-30])[0, 1] > 0.9, method


def test_coherence_and_granger():
    rng = np.random.default_rng(5)
    a = rng.normal(size=512)
    b = np.concatenate([[0], a[:-1]]) + 0.1 * rng.normal(size=512)
    assert timeseries.welch_coherence(a, a, nfft=32) == pytest.approx(1)
    assert timeseries.welch_coherence(a, b, nfft=32) > 0.8 > 0.3 > timeseries.welch_coherence(a, rng.normal(size=512), nfft=32)
    assert timeseries.granger(a, b) > 10 * abs(timeseries.granger(b, a))


def test_eigen_against_svd(spark):
    m = np.random.default_rng(6).normal(size=(24, 30)) + 3
    flat = np.ones((2, 30))
    s = spark.createDataFrame([("v", i, 1 + i % 2, v.tolist()) for i, v in enumerate(m)] + [("v", 90 + i, 3, v.tolist()) for i, v in enumerate(flat)], "volume_id string, voxel_id long, roi int, ts array<double>").repartition(4)
    got = {(r["roi"], r["comp"]): np.array(r["ts"]) for r in timeseries.eigen_timeseries(s, 2).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)} and np.allclose(got[3, 0], 0)
    for roi in (1, 2):
        x = m[roi - 1 :: 2] - m[roi - 1 :: 2].mean(1, keepdims=True)
        u, size, vt = np.linalg.svd(x, full_matrices=False)
        for k in range(2):
            sign = np.sign(u[np.abs(u[:, k]).argmax(), k])
            assert np.allclose(got[roi, k], sign * size[k] * vt[k])


def test_hooks(spark):
    timeseries.register_selector("first", lambda m: m[:1])
    timeseries.register_measure("dot", lambda a, b: float(a @ b))
    s = spark.createDataFrame([("v", i, i % 2 + 1, [float(i), 1.0]) for i in range(4)], "volume_id string, voxel_id long, roi int, ts array<double>")
    out = {(r["roi_a"], r["roi_b"]): r["value"] for r in timeseries.functional_connectivity(s, "first", "dot").collect()}
    assert out == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 2.0}


def test_common_prefix(spark):
    p = spark.createDataFrame([("a/b/c.x",), ("a/b/d/e.x",)], "path string")
    assert files.common_prefix(p).first()["prefix"] == "a/b"


def test_nearest_match(spark):
    b = spark.createDataFrame([("r/s1/t/base.x",), ("r/s2/t/base.x",), ("q/none.x",)], "path string")
    t = spark.createDataFrame([("r/s1/u/hit_2.y",), ("r/s1/u/hit_1.y",), ("r/z/hit_0.y",)], "path string")
    out = {r["path"]: r["match"] for r in files.nearest_match(b, t, "hit_").collect()}
    assert out == {"r/s1/t/base.x": "r/s1/u/hit_1.y", "r/s2/t/base.x": "r/s1/u/hit_1.y", "q/none.x": ""}


def _two_classes(spark, n=60):
    rng = np.random.default_rng(7)
    y = np.arange(n) % 2
    x = rng.normal(size=(n, 6))
    x[:, 2] += 4 * y
    feats = spark.createDataFrame([(i, f, float(x[i, f])) for i in range(n) for f in range(6)], "sample_id long, feature_id int, value double")
    labels = spark.createDataFrame([(i, int(y[i]), i // 2 % 2) for i in range(n)], "sample_id long, y int, fold int")
    return feats, labels


@pytest.mark.parametrize("name", ["cart", "gmm"])
def test_classifiers_beat_chance(spark, name):
    feats, labels = _two_classes(spark)
    grid = {"cart": [{"maxDepth": 3}, {"maxDepth": 5}], "gmm": None}[name]
    p = learning.cross_validate(feats, labels, name, learning.Preselection("pearson", "percentile", 50), grid=grid).predictions
    assert p.count() == 60 and p.select(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0] > 0.85


def test_selectors(spark):
    feats, labels = _two_classes(spark)
    rows = learning.to_vectors(feats, labels.select("sample_id", "y"))
    assert learning.feature_selector("anova", k=1).fit(rows).selectedFeatures == [2]
    assert learning.feature_selector("rfe", k=1)(rows).getIndices() == [2]
    assert 2 in learning.feature_selector("rfecv")(rows).getIndices()
    assert learning.feature_selector("extratrees", k=1).fit(rows).indices == [2]
    assert np.abs(learning.feature_selector("lda").fit(rows).axes[:, 0]).argmax() == 2


def test_rank_and_percentile_agree_with_numpy(spark):
    x = np.random.default_rng(8).normal(size=300).round(1)
    out = thresholds.apply_threshold(values(spark, x), "percentile", 70).orderBy("feature_id")
    assert np.allclose([r["value"] for r in out.collect()], np.where(x >= np.percentile(x, 70), x, 0))
