"""Inductions over ranges equal one pass in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import endmembers, scans


def starts(df, seed):
    rows = df.withColumn("h", F.xxhash64(F.col("id"), F.lit(seed))).orderBy("h", "id").select("grp", "id").collect()
    out = {}
    for r in rows:
        out.setdefault(r["grp"], []).append(r["id"])
    return out


@pytest.mark.parametrize("method,options", [("ilsia", {}), ("ilsia", {"alpha": 0.6}), ("eiha", {"alpha": 0.3}), ("eiha", {})])
def test_ranges_equal_one_pass(spark, method, options):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(420, 3)).round(2) * rng.choice([1, 1, 4], size=(420, 1))
    x[::50] = 0
    grp = np.array(["a", None, "b"], dtype=object)[np.where(np.arange(420) < 300, 0, 1 + np.arange(420) % 2)]
    df = spark.createDataFrame([(g, int(3 * i), v.tolist()) for i, (g, v) in enumerate(zip(grp, x, strict=True))], "grp string, id long, x array<double>").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges stay small
    try:
        got = scans.sources(df, method, ["grp"], 3, **options)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    first = starts(df, 3)
    for g in ("a", "b", None):
        ids = [3 * i for i in range(420) if grp[i] == g]
        own = x[[i // 3 for i in ids]]
        z = (own - own.mean(0)) / np.where(own.std(0) == 0, 1, own.std(0)) if method == "ilsia" else own
        start = next(ids.index(i) for i in first[g] if np.abs(z[ids.index(i)]).sum() > 0)
        want = getattr(endmembers, method)(own, start=start, **options)
        assert got[g,] == [ids[i] for i in want], (g, len(want))
    flags = scans.induce(df, method, ["grp"], 2, 3, **options).filter("source = 1").collect()
    assert {(r["grp"], r["id"]) for r in flags} == {(k[0], i) for k, v in got.items() for i in v[:2]}


def test_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(scans, "GROUPS", 2)
    df = spark.createDataFrame([(i % 5, i, [float(i % 7), float(i % 3)]) for i in range(100)], "grp int, id long, x array<double>")
    many = scans.sources(df, "ilsia", ["grp"])
    monkeypatch.setattr(scans, "GROUPS", 4096)
    assert many == scans.sources(df, "ilsia", ["grp"]) and len(many) == 5


def test_groups_of_zeros_and_no_groups(spark):
    df = spark.createDataFrame([("z", i, [0.0, 0.0]) for i in range(5)], "grp string, id long, x array<double>")
    for method in scans.METHODS:
        assert scans.sources(df, method, ["grp"]) == {("z",): []}
        assert scans.induce(df, method, ["grp"]).filter("source = 1").count() == 0
        assert scans.induce(df.limit(0), method, ["grp"]).count() == 0


def test_moments(spark):
    x = np.random.default_rng(1).normal(size=(60, 4)) + 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(5)
    n, mean, cov = endmembers.moments(df)
    assert n == 60 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    assert endmembers.moments(df.limit(0))[0] == 0
