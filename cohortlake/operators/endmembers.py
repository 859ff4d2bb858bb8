"""Lattice memories and endmember induction: samples (id, x ARRAY<DOUBLE>) of d variables."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.scans import induce  # noqa: F401
from cohortlake.operators.sizes import small


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in column]) if len(column) else np.zeros((0, 0))


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    c = batch.column(batch.schema.get_field_index(name))
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def lattice_memories(samples: DataFrame) -> DataFrame:
    """(b, c, w, m): the least and the largest of y_b - x_c over all samples, d x d rows from each task."""

    def run(batches):
        low = high = None
        for batch in batches:
            x = _rows(batch, "x")
            for at in range(0, len(x), 256):
                diff = x[at : at + 256, :, None] - x[at : at + 256, None, :]
                a, b = diff.min(0), diff.max(0)
                low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        if low is not None:
            d = len(low)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(low.ravel()), pa.array(high.ravel())], names=["b", "c", "w", "m"])

    part = samples.select("x").mapInArrow(run, "b int, c int, w double, m double")
    return part.groupBy("b", "c").agg(F.min("w").alias("w"), F.max("m").alias("m"))


def wm_endmembers(samples: DataFrame) -> DataFrame:
    """(kind, col, b, value): columns of W moved by u, of M by v, and u and v themselves: 2 d + 2 vectors."""
    x = samples.select(F.posexplode("x").alias("c", "v")).groupBy("c").agg(F.max("v").alias("u"), F.min("v").alias("v"))
    lam = lattice_memories(samples).join(small(x), "c")
    out = lam.select(F.lit("w").alias("kind"), F.col("c").alias("col"), "b", (F.col("w") + F.col("u")).alias("value"))
    out = out.union(lam.select(F.lit("m"), "c", "b", F.col("m") + F.col("v")))
    return out.union(x.select(F.lit("u"), F.lit(0), "c", "u")).union(x.select(F.lit("v"), F.lit(0), "c", "v"))


def moments(samples: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance (population): two passes of ``products``, of which Spark adds the d x d sums of all tasks."""
    whole = samples.select(F.lit(0).alias("all"), F.concat("x", F.array(F.lit(1.0))).alias("x"))
    first = products(whole, ["all"]).first()
    if first is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    n = first["n"]
    last = np.array(first["m"]).reshape(round(len(first["m"]) ** 0.5), -1)[-1]
    mean = last[:-1] / n
    about = F.transform("x", lambda v, i: v - F.element_at(F.lit(mean.tolist()), i + 1))
    m2 = np.array(products(samples.select(F.lit(0).alias("all"), about.alias("x")), ["all"]).first()["m"]).reshape(len(mean), -1)
    return n, mean, m2 / n


HELD_BYTES = 64 << 20  # of sums that a task of ``products`` holds before it hands them on


def products(samples: DataFrame, by: list[str], centred: bool = False) -> DataFrame:
    """(*by, n, m): of each group the number of samples and the d x d sum of x x^T, row by row; ``centred`` takes each x
    less its own mean first. Tasks hand on their sums cell by cell, so a group of any size is never gathered: only d x d
    numbers of it are."""

    def cells(held, kinds):
        for key, (n, m) in held.items():
            size = m.size
            yield pa.RecordBatch.from_arrays([*[pa.array([k] * size, t) for k, t in zip(key, kinds, strict=True)], pa.array(np.arange(size, dtype="int32")), pa.array(np.full(size, n)), pa.array(m.ravel())], names=[*by, "at", "n", "s"])

    def run(batches):
        held, kinds = {}, []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            x = _rows(batch, "x")
            x = x - x.mean(1, keepdims=True) if centred and len(x) else x
            keys = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by], strict=True))
            places = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            for key, rows in places.items():
                part = x[rows]
                n, m = held.get(key, (0, 0.0))
                held[key] = (n + len(rows), m + part.T @ part)
            if sum(m.nbytes for _, m in held.values()) > HELD_BYTES:
                yield from cells(held, kinds)
                held = {}
        yield from cells(held, kinds)

    schema = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in by)
    sums = samples.select(*by, "x").mapInArrow(run, f"{schema}, at int, n long, s double").groupBy(*by, "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = sums.groupBy(*by).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("m"))
    return whole.select(*by, "n", F.transform("m", lambda c: c["s"]).alias("m"))


def virtual_dimensionality(samples: DataFrame, rates: tuple[float, ...] = (1e-3, 1e-4, 1e-5)) -> dict[float, int]:
    """The HFC count of sources for each false-alarm rate."""
    n, mean, cov = moments(samples)
    corr = cov + np.outer(mean, mean)
    lc, lr = (np.sort(np.linalg.eigvalsh(m))[::-1] for m in (cov, corr))
    sigma = np.sqrt(np.maximum(2 * lc / n + 2 * lr / n + 2 / n * lc * lr, 1e-300))
    return {pf: int(sum(d > -NormalDist(0, s).inv_cdf(pf) for d, s in zip(lr - lc, sigma, strict=True))) for pf in rates}


def _largest(samples: DataFrame, score) -> tuple[int, float]:
    """(id, score) of the largest ``score(matrix) -> vector``; ties go to the smallest id."""

    def run(batches):
        best = None
        for batch in batches:
            if batch.num_rows:
                s, ids = score(_rows(batch, "x")), batch.column(0).to_numpy()
                i = np.lexsort((ids, -np.round(s, 12)))[0]
                if best is None or (round(s[i], 12), -ids[i]) > (round(best[1], 12), -best[0]):
                    best = (int(ids[i]), float(s[i]))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]])], names=["id", "s"])

    r = samples.select("id", "x").mapInArrow(run, "id long, s double").orderBy(F.desc(F.round("s", 12)), "id").first()
    return r["id"], r["s"]


def _vector(samples: DataFrame, ident: int) -> np.ndarray:
    return np.array(samples.filter(F.col("id") == ident).select("x").first()["x"], dtype=float)


def atgp(samples: DataFrame, p: int = 0) -> list[int]:
    """Ids of p targets: the largest, then each time the one farthest from the span of those before. p <= 0: by HFC.

    One scan a target with a d x p basis, kept orthonormal; nothing but the ids and vectors chosen comes back.
    """
    p = p if p > 0 else virtual_dimensionality(samples, (1e-5,))[1e-5]
    out: list[int] = []
    basis = None
    for _ in range(p):
        q = basis
        ident, s = _largest(samples, lambda x, q=q: (x * x).sum(1) - (0 if q is None else ((x @ q) ** 2).sum(1)))
        if basis is not None and s <= 1e-12:
            break
        out.append(ident)
        v = _vector(samples, ident)
        if basis is not None:
            v = v - basis @ (basis.T @ v)
            v = v - basis @ (basis.T @ v)
        v = (v / np.linalg.norm(v))[:, None]
        basis = v if basis is None else np.hstack([basis, v])
    return out


def nfindr(samples: DataFrame, p: int, seed: int = 0) -> list[int]:
    """Ids of p samples that span the largest simplex in p - 1 principal components.

    |det| is linear in one column, so for each slot one scan finds the sample that makes it largest; at most 3 p sweeps.
    """
    _, mean, cov = moments(samples)
    val, vec = np.linalg.eigh(cov)
    axes = vec[:, np.argsort(-val)[: p - 1]]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(p - 1)] < 0, -1, 1)
    point = lambda x: np.vstack([np.ones(len(x)), ((x - mean) @ axes).T])
    start = samples.select("id", "x").orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(p).collect()
    ids, m = [r["id"] for r in start], point(_matrix([r["x"] for r in start]))
    for _ in range(3 * p):
        changed = False
        for k in range(p):
            minor = np.delete(m, k, axis=1)
            cof = np.array([(-1) ** r * np.linalg.det(np.delete(minor, r, axis=0)) for r in range(p)])
            now = abs(cof @ m[:, k])
            ident, s = _largest(samples, lambda x, cof=cof: np.abs(cof @ point(x)))
            if s > now * (1 + 1e-9) and ident not in ids:
                ids[k], changed = ident, True
                m[:, k] = point(_vector(samples, ident)[None])[:, 0]
        if not changed:
            break
    return ids


# order-dependent inductions of one matrix; `scans` has those of groups of any size


def _lam(y: np.ndarray) -> np.ndarray:
    return (y[:, :, None] - y[:, None, :]).min(0)


def _dominant(v: np.ndarray, high: bool) -> bool:
    for j in range(len(v)):
        d = v[j] - np.delete(v, j, axis=0)
        hit = np.isclose(d, (d.max(1) if high else d.min(1))[:, None], atol=1e-9)
        if not hit.all(0).any():
            return False
    return True


def ilsia(x: np.ndarray, alpha: float = 0.0, seed: int = 0, start: int | None = None) -> list[int]:
    """Rows that are incremental strong lattice independent sources, in order of induction; ``start`` is the first."""
    std = x.std(0)
    z = (x - x.mean(0)) / np.where(std == 0, 1, std)
    some = np.flatnonzero(np.abs(z).sum(1) > 0)
    if not len(some):
        return []
    own = [int(np.random.default_rng(seed).choice(some)) if start is None else start]
    w = _lam(z[own])
    for i in some:
        if i in own:
            continue
        v = z[i]
        if alpha == 0:
            close = np.abs((w + v[None, :]).max(1) - v).max() <= 1e-9
        else:
            low = (-w.T + v[None, :]).min(1)
            mu = ((w + low[None, :]).max(1) - v)
            c = (w + (0.5 * np.abs(mu).max() + low)[None, :]).max(1)
            close = np.abs(c - v).max() < alpha
        if close:
            agree = [(np.sign(z[s]) == np.sign(v)).sum() for s in own]
            s = int(np.argmax(agree))
            if np.linalg.norm(z[own[s]]) < np.linalg.norm(v):
                own[s] = int(i)
                w = _lam(z[own])
            continue
        both = np.vstack([z[own], v])
        if _dominant(both, True) or _dominant(both, False):
            own.append(int(i))
            w = _lam(z[own])
    return own


def eiha(x: np.ndarray, alpha: float = 2.0, seed: int = 0, start: int | None = None) -> list[int]:
    """Rows at the extremes: new quadrants whose perturbed signs are not below or above all others; ``start`` is the first."""
    mean, std = x.mean(0), x.std(0)
    some = np.flatnonzero(np.abs(x).sum(1) > 0)
    if not len(some):
        return []
    own = [int(np.random.default_rng(seed).choice(some)) if start is None else start]
    for i in some:
        d = x[i] - mean
        sign = np.sign(d)
        same = [k for k, e in enumerate(own) if (np.sign(x[e] - mean) == sign).all()]
        if same:
            if np.linalg.norm(d) > np.linalg.norm(x[own[same[0]]] - mean):
                own[same[0]] = int(i)
            continue
        if any(((x[i] - x[e]) ** 2 < alpha * std).all() for e in own):
            continue
        binary = lambda v: v - mean > 0
        others = [binary(x[e]) for e in own]
        up, down = binary(x[i] + alpha * std), binary(x[i] - alpha * std)
        if not any((o >= up).all() for o in others) or not any((o <= down).all() for o in others):
            own.append(int(i))
    return own


def cca_endmembers(corr: np.ndarray, p: int, seed: int = 0, tol: float = 1e-6) -> np.ndarray:
    """p vectors at the edge of the convex cone of the first p eigenvectors of the correlation x^T x / n (fewer if the draws run out)."""
    val, vec = np.linalg.eigh(corr)
    v = vec[:, np.argsort(-val)[:p]]
    v = v * np.where(v.sum(0) < 0, -1, 1)
    rng, out = np.random.default_rng(seed), []
    for _ in range(1000 * p):
        if len(out) == p or len(v) < p - 1:
            break
        rows = rng.choice(len(v), p - 1, replace=False)
        _, _, null = np.linalg.svd(v[rows]) if p > 1 else (0, 0, np.eye(1))
        for a in (null[-1], -null[-1]):
            e = v @ a
            if e.min() > -tol and not any(np.allclose(e / np.linalg.norm(e), o / np.linalg.norm(o), atol=1e-6) for o in out):
                out.append(e)
                break
    return np.array(out)


def induce_cone(samples: DataFrame, by: list[str], p: int, seed: int = 0) -> DataFrame:
    """(*by, comp, x): CCA's vectors of each group, from its d x d correlation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(round(len(pdf["m"].iloc[0]) ** 0.5))
        e = cca_endmembers(np.asarray(pdf["m"].iloc[0], dtype=float).reshape(d, d) / pdf["n"].iloc[0], p, seed)
        out = pd.DataFrame({"comp": np.arange(len(e), dtype="int32"), "x": pd.Series([v.tolist() for v in e], dtype=object)})
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in by)
    return products(samples, by).groupBy(*by).applyInPandas(run, f"{kinds}, comp int, x array<double>")
