"""Places, carried values, merged aggregates: against plain Python, with groups over many ranges."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cohortlake.operators import aggregates, features, tables, timeseries

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see this module


@pytest.fixture
def many_ranges(spark):
    """Small tables stay in as many ranges as the session has partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, old)


def test_places(spark, many_ranges):
    rng = np.random.default_rng(1)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}", None if i % 13 == 0 else int(rng.integers(0, 40))) for i in range(600)]
    df = spark.createDataFrame(rows, "grp string, v int").repartition(6)
    got = {}
    for r in tables.places(df, "grp", ["v"]).collect():
        got.setdefault(r["grp"], []).append((r["at"], r["v"], r["n"], r["g"]))
    first = []
    for g in sorted(got, key=lambda g: (g is not None, g)):
        own = sorted(got[g])
        want = sorted((v for x, v in rows if x == g), key=lambda v: (v is not None, v))
        assert [x[0] for x in own] == list(range(len(want))) and [x[1] for x in own] == want
        assert {x[2] for x in own} == {len(want)} and len({x[3] for x in own}) == 1
        first.append(own[0][3])
    assert first == sorted(first)
    whole = tables.places(df, None, ["v"], at="p").orderBy("p").collect()
    assert [r["p"] for r in whole] == list(range(600)) and "__all" not in whole[0].asDict()
    assert tables.places(df.limit(0), "grp", ["v"]).count() == 0


@pytest.mark.parametrize("n,k", [(10, 3), (7, 7), (3, 5), (100, 9)])
def test_plain_folds_are_tiles(spark, many_ranges, n, k):
    got = {r["sample_id"]: r["fold"] for r in features.assign_folds(spark.range(n).withColumnRenamed("id", "sample_id"), k, "plain").collect()}
    want = np.concatenate([np.full(len(part), i) for i, part in enumerate(np.array_split(np.arange(n), k))])
    assert [got[i] for i in range(n)] == want.tolist()


def test_spread_of_few_and_many(spark, many_ranges):
    for n, num in ((10, 3), (50, 7), (5, 5), (4, 9)):
        items = spark.range(n)
        want = sorted({-(-i * n // num) for i in range(num)} & set(range(n)))
        assert features.takespread(items, num, "id") == want
        flags = features.makespread(items, num, "id").collect()
        assert sorted(r["id"] for r in flags if r["chosen"]) == want and len(flags) == n


def test_values_are_carried_over_ranges(spark, many_ranges):
    rng = np.random.default_rng(3)
    held = {int(t): float(t) for t in rng.choice(200, 25, replace=False)}
    df = spark.createDataFrame([(t, v) for t, v in held.items()] + [(0, None), (199, None)], "t int, v double").groupBy("t").agg(F.max("v").alias("v"))
    for how, order in (("ffill", range(200)), ("bfill", range(199, -1, -1))):
        got = {r["t"]: r["v"] for r in features.fill_grid(df, ["t"], "v", how=how).collect()}
        now, want = None, {}
        for t in order:
            now = held.get(t, now)
            want[t] = now
        assert got == want
    two = spark.createDataFrame([("a", 0, 1.0), ("a", 5, None), ("b", 2, 7.0), (None, 3, 4.0)], "g string, t int, v double")
    got = {(r["g"], r["t"]): r["v"] for r in features.fill_grid(two, ["g", "t"], "v", how="ffill").collect() if r["g"]}
    assert [got["a", t] for t in range(6)] == [1.0] * 6 and [got["b", t] for t in range(6)] == [None, None, 7.0, 7.0, 7.0, 7.0]


# aggregates

DISTANCES = {
    "cityblock": lambda x, y: np.abs(x - y).sum(),
    "euclidean": lambda x, y: np.linalg.norm(x - y),
    "sqeuclidean": lambda x, y: ((x - y) ** 2).sum(),
    "chebyshev": lambda x, y: np.abs(x - y).max(),
    "canberra": lambda x, y: sum(abs(a - b) / (abs(a) + abs(b)) if a or b else 0 for a, b in zip(x, y, strict=True)),
    "braycurtis": lambda x, y: np.abs(x - y).sum() / np.abs(x + y).sum(),
    "cosine": lambda x, y: 1 - x @ y / np.sqrt((x @ x) * (y @ y)),
    "correlation": lambda x, y: 1 - np.corrcoef(x, y)[0, 1],
}


def long_table(spark, n=120, d=4):
    x = np.random.default_rng(4).normal(size=(n, d)).round(1)
    x[:, 3] = 0
    y = np.arange(n) % 3
    feats = spark.createDataFrame([(i, f, float(x[i, f])) for i in range(n) for f in range(d)], "sample_id long, feature_id int, value double").repartition(6)
    return x, y, feats, spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "sample_id long, y int")


@pytest.mark.parametrize("name", list(DISTANCES))
def test_named_distances_equal_the_callable(spark, name):
    x, y, feats, labels = long_table(spark)
    got = {r["feature_id"]: r["measure"] for r in features.distance_features(feats, labels, name).collect()}
    with np.errstate(all="ignore"):
        alone = {r["feature_id"]: r["measure"] for r in features.distance_features(feats, labels, DISTANCES[name]).collect()}
    assert set(got) == set(alone) == {0, 1, 2, 3} and all(np.isclose(got[f], alone[f]) for f in got)
    if name == "correlation":
        assert got[3] == 0  # of a feature without spread: NaN


class Extremes(aggregates.Mergeable):
    """Least, largest and number; two values."""

    def zero(self):
        return np.array([np.inf, -np.inf, 0])

    def update(self, s, v):
        return self.merge(s, [v[:, 0].min(), v[:, 0].max(), len(v)])

    def merge(self, a, b):
        return np.array([min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2]])

    def finish(self, s):
        return np.array([s[1] - s[0], s[2]])


def test_a_users_aggregate_is_merged(spark, monkeypatch):
    x, y, feats, labels = long_table(spark)
    for held in (1 << 20, 1):  # states handed on at the end, or after each batch
        monkeypatch.setattr(aggregates, "HELD_BYTES", held)
        got = {r["feature_id"]: r["value"] for r in aggregates.aggregate(feats, ["feature_id"], ["value"], Extremes()).collect()}
        assert all(np.allclose(got[f], [np.ptp(x[:, f]), 120]) for f in range(4))
    m = {r["feature_id"]: r["measure"] for r in features.feature_selection(feats, labels, "distance", measure=Extremes()).collect()}
    assert all(np.isclose(m[f], np.ptp(x[:, f])) for f in range(4))
    odd = spark.createDataFrame([(None, "a", 1.0), (None, "a", 5.0), (1, None, 2.0)], "k int, l string, v double")
    assert {(r["k"], r["l"], tuple(r["value"])) for r in aggregates.aggregate(odd, ["k", "l"], ["v"], Extremes()).collect()} == {(None, "a", (4.0, 2.0)), (1, None, (0.0, 1.0))}
    assert aggregates.aggregate(odd.limit(0), ["k"], ["v"], Extremes()).count() == 0


class Sums(aggregates.Mergeable):
    """Sum of the series, and the sum of their squares: two components."""

    def zero(self):
        return np.zeros(0)

    def update(self, s, v):
        return self.merge(s, np.concatenate([v.sum(0), (v * v).sum(0)]))

    def merge(self, a, b):
        return np.asarray(b) if not len(a) else np.asarray(a) if not len(b) else a + b

    def finish(self, s):
        return s


def test_a_merged_selector(spark):
    timeseries.register_selector("sums", Sums())
    x = np.random.default_rng(5).normal(size=(30, 4))
    s = spark.createDataFrame([("v", i, i % 2, v.tolist()) for i, v in enumerate(x)], "volume_id string, voxel_id long, roi int, ts array<double>").repartition(5)
    got = {(r["roi"], r["comp"]): r["ts"] for r in timeseries.select_timeseries(s, "sums").collect()}
    assert len(got) == 4
    for roi in (0, 1):
        assert np.allclose(got[roi, 0], x[roi::2].sum(0)) and np.allclose(got[roi, 1], (x[roi::2] ** 2).sum(0))
