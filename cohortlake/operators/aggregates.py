"""A user's aggregate in four functions, over groups of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of states that a task holds before it hands them on.
HELD_BYTES = 64 << 20
#: Parts that a group's states are merged in, before those are merged.
SPREAD = 32


class Mergeable:
    """What an aggregate has to say; its state is a vector of numbers, of any length.

    ``update`` gets the rows of one group in a batch (rows x columns). States meet in any order, so ``merge`` has to be
    associative and commutative, up to rounding.
    """

    def zero(self) -> np.ndarray:
        raise NotImplementedError

    def update(self, state: np.ndarray, values: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def finish(self, state: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def aggregate(df: DataFrame, by: list[str], columns: list[str], f: Mergeable, into: str = "value") -> DataFrame:
    """(*by, into ARRAY<DOUBLE>): ``f`` over ``columns`` (numbers, or one array column) of each group, null keys included.

    Tasks hand on one state for each group they see, and a group's states are merged in two steps: no task gets the rows of
    a whole group, however large it is.
    """
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def out(held: dict, schema: pa.Schema) -> pa.RecordBatch:
        keys = [pa.array([k[i] for k in held], schema.field(c).type) for i, c in enumerate(by)]
        return pa.RecordBatch.from_arrays([*keys, pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=[*by, "state"])

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        if len(cols) == 1 and pa.types.is_list(cols[0].type):
            return cols[0].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in cols], 1)

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix(batch)
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by], strict=True)):
                rows.setdefault(key, []).append(i)
            for key, at in rows.items():
                held[key] = np.asarray(f.update(held[key] if key in held else f.zero(), values[at]), float)
            if sum(v.nbytes for v in held.values()) > HELD_BYTES:
                yield out(held, batch.schema)
                held = {}
        if held:
            yield out(held, batch.schema)

    def merged(last: bool):
        def run(key, table):
            total = f.zero()
            for state in table.column("state").to_pylist():
                total = np.asarray(f.merge(total, np.asarray(state, float)), float)
            total = np.atleast_1d(np.asarray(f.finish(total), float)) if last else total
            return pa.table({**{c: table.column(c).slice(0, 1) for c in by}, "state": pa.array([total.tolist()], pa.list_(pa.float64()))})

        return run

    states = df.select(*by, *columns).mapInArrow(partial, f"{kinds}, state array<double>").withColumn("__part", F.pmod(F.xxhash64("state"), F.lit(SPREAD)))
    some = states.groupBy(*by, "__part").applyInArrow(merged(False), f"{kinds}, state array<double>")
    return some.groupBy(*by).applyInArrow(merged(True), f"{kinds}, state array<double>").withColumnRenamed("state", into)


def distance(name: str, a: Column, b: Column) -> Column:
    """A distance of two columns over a group, as an aggregate expression: NaN where it is not defined."""
    nan = F.lit(float("nan"))
    diff, total = F.abs(a - b), lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    ratio = lambda x, y: F.when(y == 0, nan).otherwise(x / y)
    known = {
        "cityblock": lambda: total(diff),
        "euclidean": lambda: F.sqrt(total(diff * diff)),
        "sqeuclidean": lambda: total(diff * diff),
        "chebyshev": lambda: F.coalesce(F.max(diff), F.lit(0.0)),
        "canberra": lambda: total(F.when(F.abs(a) + F.abs(b) == 0, 0.0).otherwise(diff / (F.abs(a) + F.abs(b)))),
        "braycurtis": lambda: ratio(total(diff), total(F.abs(a + b))),
        "cosine": lambda: 1 - ratio(total(a * b), F.sqrt(total(a * a) * total(b * b))),
        "correlation": lambda: 1 - ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)),
    }
    if name not in known:
        raise ValueError(f"no distance {name}")
    return known[name]()
