"""Time series of voxels and regions: series (volume_id, voxel_id, roi, ts ARRAY<DOUBLE>)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cohortlake.operators.aggregates import Mergeable, aggregate
from cohortlake.operators.endmembers import products
from cohortlake.operators.sizes import small

SELECTORS: dict[str, Callable] = {}
MEASURES: dict[str, Callable] = {}


def register_selector(name: str, f: Callable) -> None:
    """``f(matrix: series x time) -> components x time``; or a ``Mergeable`` over series, which ends with the components' values
    end to end: it never gets a whole region."""
    SELECTORS[name] = f


def register_measure(name: str, f: Callable, symmetric: bool = True) -> None:
    """``f(ts_a, ts_b) -> float``."""
    MEASURES[name] = (f, symmetric)


def normalize_series(ts, how: str) -> Column:
    """'percent': (x / mean - 1) 100; 'zscore': (x - mean) / std, 0 where std is 0."""
    x = F.col(ts) if isinstance(ts, str) else ts
    n = F.size(x).cast("double")
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    if how == "percent":
        return _with(mean, lambda m: F.transform(x, lambda v: (v / m - 1) * 100))
    return _with(mean, lambda m: _with(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / n), lambda s: F.transform(x, lambda v: F.when(s == 0, 0.0).otherwise((v - m) / s))))


def _with(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once a row, not once an element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def band_pass(x: np.ndarray, lb: float, ub: float | None, tr: float, method: str = "fir", order: int = 64, rounds: int = 2) -> np.ndarray:
    """Rows of ``x`` limited to lb..ub Hz. 'fir' falls back to 'fourier' for series shorter than 3 orders."""
    n = x.shape[-1]
    nyquist = 0.5 / tr
    ub = nyquist if ub is None else ub
    if method == "fir" and n < 3 * order:
        method = "fourier"
    if method == "fourier":
        f = np.fft.rfft(x, axis=-1)
        freq = np.arange(f.shape[-1]) / (n * tr)
        off = (freq < lb) | (freq > ub)
        off[0] = False
        f[..., off] = 0
        return np.fft.irfft(f, n, axis=-1)
    if method == "boxcar":
        smooth = lambda v, hz: v if hz <= 0 else _box(v, max(1, round(1 / (2 * hz * tr))), rounds)
        low = smooth(x, ub) if ub < nyquist else x
        return low - smooth(low, lb) + low.mean(axis=-1, keepdims=True) if lb > 0 else low
    t = np.arange(order + 1) - order / 2
    ideal = lambda hz: 2 * hz * tr * np.sinc(2 * hz * tr * t)
    kernel = (ideal(ub) - ideal(lb)) * np.hamming(order + 1)
    mean = x.mean(axis=-1, keepdims=True)

    def once(v):
        wide = np.pad(v, [(0, 0)] * (v.ndim - 1) + [(order // 2, order // 2)], mode="reflect")
        return sum(k * wide[..., j : j + n] for j, k in enumerate(kernel[::-1]))

    return once(once(x - mean)[..., ::-1])[..., ::-1] + mean


def _box(x: np.ndarray, width: int, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        pad = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(width // 2, width - 1 - width // 2)], mode="edge")
        c = np.cumsum(np.concatenate([np.zeros((*x.shape[:-1], 1)), pad], axis=-1), axis=-1)
        x = (c[..., width:] - c[..., :-width]) / width
    return x


def filter_series(series: DataFrame, lb: float, ub: float | None, tr: float = 2.0, method: str = "fir", column: str = "ts", order: int = 64) -> DataFrame:
    """Series of the same length in a batch are filtered together; a null stays null, an empty one empty."""

    @pandas_udf("array<double>")
    def run(ts: pd.Series) -> pd.Series:
        out = ts.copy()
        for n, rows in ts.groupby(ts.map(len, na_action="ignore")):
            if n:
                found = band_pass(np.stack(rows.to_numpy()).astype(float), lb, ub, tr, method, order)
                out[rows.index] = pd.Series(list(found), rows.index)
        return out

    return series.withColumn(column, run(column))


def filtered_set(series: DataFrame, filters: list[tuple[str, float | None, float | None]], tr: float = 2.0, method: str = "fourier") -> DataFrame:
    """The original (band 'original') and one copy for each (name, lb, ub); None is the band's open end."""
    out = series.withColumn("band", F.lit("original"))
    for name, lb, ub in filters:
        out = out.unionByName(filter_series(series, lb or 0.0, ub, tr, method).withColumn("band", F.lit(name)))
    return out


def mean_timeseries(series: DataFrame) -> DataFrame:
    """(volume_id, roi, t, x): the mean over the voxels of a region, t from 0."""
    return series.select("volume_id", "roi", F.posexplode("ts").alias("t", "x")).groupBy("volume_id", "roi", "t").agg(F.avg("x").alias("x"))


def as_arrays(long: DataFrame) -> DataFrame:
    whole = long.groupBy("volume_id", "roi").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("p"))
    return whole.select("volume_id", "roi", F.transform("p", lambda p: p["x"]).alias("ts"))


def eigen(gram: np.ndarray, n_comps: int) -> np.ndarray:
    """Component scores over time from the times x times sum of products of the centred series; signs are free."""
    val, vec = np.linalg.eigh(gram)
    first = np.argsort(-val, kind="stable")
    s = np.sqrt(np.maximum(val[first], 0))
    n = min(n_comps, int((s > 1e-7 * max(s[0], 1e-300)).sum()) or 1)  # squares keep half of the digits
    return (vec[:, first[:n]] * s[:n]).T


def select_timeseries(series: DataFrame, selector: str, n_comps: int = 1) -> DataFrame:
    """(volume_id, roi, comp, ts) by 'mean', 'eigen' or a registered selector. Of those a ``Mergeable`` is merged from tasks; another
    callable gets one whole region at a time in a task."""
    if selector == "mean":
        return as_arrays(mean_timeseries(series)).select("volume_id", "roi", F.lit(0).alias("comp"), "ts")
    if selector == "eigen":
        return eigen_timeseries(series, n_comps)
    f = SELECTORS[selector]
    if isinstance(f, Mergeable):
        keys = ["volume_id", "roi"]
        whole = aggregate(series, keys, ["ts"], f, "flat").join(series.groupBy(*keys).agg(F.max(F.size("ts")).alias("n")), keys)
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size("flat") / F.col("n")).cast("int") - 1), lambda i: F.slice("flat", i * F.col("n") + 1, F.col("n")))
        return whole.select(*keys, F.posexplode(parts).alias("comp", "ts"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("voxel_id")
        out = np.atleast_2d(f(np.stack([np.asarray(x, dtype=float) for x in pdf["ts"]])))
        return pd.DataFrame({"volume_id": pdf["volume_id"].iloc[0], "roi": pdf["roi"].iloc[0], "comp": np.arange(len(out), dtype="int32"), "ts": out.tolist()})

    kinds = {c: series.schema[c].dataType.simpleString() for c in ("volume_id", "roi")}
    return series.select("volume_id", "roi", "voxel_id", "ts").groupBy("volume_id", "roi").applyInPandas(run, f"volume_id {kinds['volume_id']}, roi {kinds['roi']}, comp int, ts array<double>")


def eigen_timeseries(series: DataFrame, n_comps: int = 1) -> DataFrame:
    """(volume_id, roi, comp, ts): the first components of each region's series, each centred over time; the voxel of the
    largest loading (the smallest voxel_id of several) has a positive one.

    Regions are summed as times x times products, so no task holds a whole one; a second pass over the voxels finds signs.
    """
    keys = ["volume_id", "roi"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.asarray(pdf["m"].iloc[0], dtype=float)
        d = int(round(len(m) ** 0.5))
        out = eigen(m.reshape(d, d), n_comps)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(out) for c in keys}, "comp": np.arange(len(out), dtype="int32"), "score": out.tolist()})

    kinds = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in keys)
    found = products(series.select(*keys, F.col("ts").alias("x")), keys, centred=True).groupBy(*keys).applyInPandas(run, f"{kinds}, comp int, score array<double>")
    # scores sum to 0 over time, so a series need not be centred to find its loading
    load = F.aggregate(F.zip_with("ts", "score", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    voxels = series.select(*keys, "voxel_id", "ts").join(found, keys).select(*keys, "comp", "score", "voxel_id", load.alias("load"))
    most = voxels.groupBy(*keys, "comp").agg(F.max_by("load", F.struct(F.abs("load"), -F.col("voxel_id"))).alias("load"), F.first("score").alias("score"))
    return most.select(*keys, "comp", F.when(F.col("load") < 0, F.transform("score", lambda v: -v)).otherwise(F.col("score")).alias("ts"))


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    d = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / d) if d > 0 else 0.0


def welch_coherence(a: np.ndarray, b: np.ndarray, tr: float = 2.0, lb: float = 0.0, ub: float | None = None, nfft: int = 64) -> float:
    """Mean magnitude-squared coherence over lb < f < ub: Hann windows of nfft, half overlapping, no detrending."""
    n = min(nfft, len(a))
    window = np.hanning(n + 1)[:-1]
    starts = range(0, len(a) - n + 1, max(1, n // 2))
    fa, fb = (np.array([np.fft.rfft(x[s : s + n] * window) for s in starts]) for x in (a, b))
    sxy, sxx, syy = (fa.conj() * fb).mean(0), (np.abs(fa) ** 2).mean(0), (np.abs(fb) ** 2).mean(0)
    freq = np.arange(len(sxx)) / (n * tr)
    ub = 0.5 / tr if ub is None else ub
    c = np.where(sxx * syy > 0, np.abs(sxy) ** 2 / np.maximum(sxx * syy, 1e-300), 0.0)[(freq > lb) & (freq < ub)]
    return float(c.mean()) if len(c) else 0.0


def granger(a: np.ndarray, b: np.ndarray, tr: float = 2.0, lb: float = 0.0, ub: float | None = None, n_freqs: int = 128) -> float:
    """Spectral causality a -> b of an order-1 bivariate autoregression (Yule-Walker), mean over lb < f < ub."""
    x = np.stack([a - a.mean(), b - b.mean()])
    n = x.shape[1]
    r0, r1 = x @ x.T / n, x[:, 1:] @ x[:, :-1].T / n
    coef = r1 @ np.linalg.pinv(r0)
    noise = r0 - coef @ r1.T
    freq = np.arange(1, n_freqs) * (0.5 / tr) / n_freqs
    ub = 0.5 / tr if ub is None else ub
    freq = freq[(freq > lb) & (freq < ub)]
    out = []
    for f in freq:
        h = np.linalg.inv(np.eye(2) - coef * np.exp(-2j * np.pi * f * tr))
        s = h @ noise @ h.conj().T
        part = (noise[0, 0] - noise[0, 1] ** 2 / noise[1, 1]) * abs(h[1, 0]) ** 2
        out.append(np.log(s[1, 1].real / max(s[1, 1].real - part, 1e-300)))
    return float(np.mean(out)) if out else 0.0


MEASURES |= {"correlation": (pearson, True), "coherence": (welch_coherence, True), "granger": (granger, False)}


def pair_measure(pairs: DataFrame, measure: str, into: str = "value", **options) -> DataFrame:
    """``into`` for each row's (ts_a, ts_b), in Arrow batches."""
    f, _ = MEASURES[measure]

    @pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(np.asarray(x, dtype=float), np.asarray(y, dtype=float), **options) for x, y in zip(a, b, strict=True)], dtype=float)

    return pairs.withColumn(into, run("ts_a", "ts_b")).drop("ts_a", "ts_b")


def roi_pairs(rois: DataFrame, symmetric: bool = False) -> DataFrame:
    """(volume_id, roi_a, roi_b, ts_a, ts_b): every ordered pair of a volume's regions, or those with a <= b."""
    a = rois.select("volume_id", F.col("roi").alias("roi_a"), F.col("ts").alias("ts_a"))
    b = rois.select("volume_id", F.col("roi").alias("roi_b"), F.col("ts").alias("ts_b"))
    out = a.join(b, "volume_id")
    return out.filter("roi_a <= roi_b") if symmetric else out


def connectivity_matrix(rois: DataFrame, measure: str = "correlation", **options) -> DataFrame:
    """(volume_id, roi_a, roi_b, value). Correlation is worked out by built-in functions, other measures in Arrow batches;
    symmetric ones once a pair, and mirrored."""
    if measure == "correlation" and MEASURES[measure][0] is pearson:
        long = rois.select("volume_id", "roi", F.posexplode("ts").alias("t", "x"))
        return correlation_long(long).withColumn("value", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))
    symmetric = MEASURES[measure][1]
    out = pair_measure(roi_pairs(rois, symmetric), measure, **options).select("volume_id", "roi_a", "roi_b", "value")
    if not symmetric:
        return out
    both = F.when(F.col("roi_a") == F.col("roi_b"), F.array(F.struct("roi_a", "roi_b"))).otherwise(F.array(F.struct("roi_a", "roi_b"), F.struct(F.col("roi_b").alias("roi_a"), F.col("roi_a").alias("roi_b"))))
    return out.select("volume_id", F.explode(both).alias("p"), "value").select("volume_id", "p.roi_a", "p.roi_b", "value")


def correlation_long(long: DataFrame) -> DataFrame:
    """The same by built-in functions alone, from (volume_id, roi, t, x)."""
    a, b = (long.select("volume_id", "t", F.col("roi").alias(f"roi_{s}"), F.col("x").alias(f"x{s}")) for s in "ab")
    return a.join(b, ["volume_id", "t"]).groupBy("volume_id", "roi_a", "roi_b").agg(F.corr("xa", "xb").alias("value"))


def seed_correlation(seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """seeds (seed, t, x) and targets (target, t, x): correlation of each with each."""
    j = seeds.select("seed", "t", F.col("x").alias("xs")).join(targets.select("target", "t", F.col("x").alias("xt")), "t")
    return j.groupBy("seed", "target").agg(F.corr("xs", "xt").alias("value"))


def mean_seed_correlation(seeds: DataFrame, targets: DataFrame) -> DataFrame:
    return seed_correlation(seeds, targets).agg(F.avg("value").alias("value"))


def seed_coherence(seeds: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """seeds (seed, ts), targets (target, ts)."""
    pairs = targets.withColumnRenamed("ts", "ts_b").crossJoin(small(seeds.withColumnRenamed("ts", "ts_a"), 10_000))
    return pair_measure(pairs, "coherence", **options).select("seed", "target", "value")


def mean_seed_coherence(seeds: DataFrame, targets: DataFrame, **options) -> DataFrame:
    return seed_coherence(seeds, targets, **options).agg(F.avg("value").alias("value"))


def functional_connectivity(series: DataFrame, selector: str = "mean", measure: str = "correlation", normalize: str | None = None, band: tuple[float, float | None] | None = None, tr: float = 2.0, n_comps: int = 1, **options) -> DataFrame:
    """The matrix (volume_id, roi_a, roi_b, value) of many scans at once. Regions with several components use the first."""
    rows = series.filter((F.col("roi") != 0) & (F.aggregate("ts", F.lit(0.0), lambda a, x: a + x) != 0))
    if normalize:
        rows = rows.withColumn("ts", normalize_series("ts", normalize))
    if band:
        rows = filter_series(rows, band[0], band[1], tr)
    rois = select_timeseries(rows, selector, n_comps).filter("comp = 0")
    return connectivity_matrix(rois, measure, **options)


def edge_list(matrix: DataFrame) -> DataFrame:
    """(a, b, weight): cells above 0 off the diagonal."""
    return matrix.filter((F.col("value") > 0) & (F.col("roi_a") != F.col("roi_b"))).select(F.col("roi_a").alias("a"), F.col("roi_b").alias("b"), F.col("value").alias("weight"))


def is_symmetric(matrix: DataFrame) -> DataFrame:
    """One row ``symmetric``: |a - b| <= 1e-8 + 1e-5 |b| for all cells and their mirrors, scan by scan."""
    scan = ["volume_id"] if "volume_id" in matrix.columns else []
    t = matrix.select(*scan, F.col("roi_b").alias("roi_a"), F.col("roi_a").alias("roi_b"), F.col("value").alias("other"))
    j = matrix.join(t, [*scan, "roi_a", "roi_b"], "left")
    return j.agg(F.bool_and(F.coalesce(F.abs(F.col("value") - F.col("other")) <= 1e-8 + 1e-5 * F.abs("other"), F.lit(False))).alias("symmetric"))
