"""Column functions for values and voxel coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def binarise(value, low: float, high: float, inclusive: bool = True) -> Column:
    v = _c(value)
    inside = (v >= low) & (v <= high) if inclusive else (v > low) & (v < high)
    return F.when(inside, 1).otherwise(0)


def threshold(value, low: float, high: float, inclusive: bool = True) -> Column:
    return _c(value) * binarise(value, low, high, inclusive)


def nonzero(series) -> Column:
    """Whether the sum of a series (not each value) differs from 0."""
    return F.aggregate(_c(series), F.lit(0.0), lambda a, x: a + x) != 0


def valid_coordinate(i, j, k, shape: tuple[int, int, int]) -> Column:
    inside = F.lit(True)
    for c, n in zip((i, j, k), shape, strict=True):
        inside = inside & (_c(c) >= 0) & (_c(c) < n)
    return inside


def flat_index(i, j, k, shape: tuple[int, int, int]) -> Column:
    return (_c(i) * shape[1] + _c(j)) * shape[2] + _c(k)


def affine(m: list[float], x, y, z) -> tuple[Column, Column, Column]:
    """The three coordinates of a 3 x 4 row-major map."""
    return tuple(_c(x) * m[4 * r] + _c(y) * m[4 * r + 1] + _c(z) * m[4 * r + 2] + m[4 * r + 3] for r in range(3))


def inverse_affine(m: list[float]) -> list[float]:
    import numpy as np

    inv = np.linalg.inv(np.array(m, dtype=float).reshape(3, 4)[:, :3])
    return np.hstack([inv, -inv @ np.array(m, dtype=float).reshape(3, 4)[:, 3:]]).ravel().tolist()


def nearest(x) -> Column:
    """Half-up rounding to an integer."""
    return F.floor(_c(x) + 0.5).cast("int")


def sampling_interval(zooms) -> Column:
    return F.element_at(_c(zooms), -1)


def component_count(n_series, n_comps: int | None = None, share: float | None = None) -> Column:
    """``n_comps``, or the floor of ``n_series`` times ``share`` (a percentage where it is above 1)."""
    if n_comps is not None:
        return F.least(F.lit(n_comps), _c(n_series)).cast("int")
    return F.floor(_c(n_series) * (share / 100 if share > 1 else share)).cast("int")
