"""Order-dependent inductions over groups of any size: exactly what one pass in the order of ids would give.

A sample changes the set of sources (an event) or leaves it as it is, and most leave it. So samples are sorted by ranges of
(group, id); in each pass all ranges look, with the sources so far, for the first sample that changes them. The range that
has the earliest one saw the true sources, as no sample before it changes them, and has gone on with them to its own end;
its sources count, and the next pass looks behind it. Others' are thrown away. A group takes as many passes as ranges of it
have events, and no group is ever in one task. The driver holds the sources of a block of groups, never their samples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.sizes import small

#: Groups whose sources are induced at the same time.
GROUPS = 4096
#: Numbers of an intermediate array in a task.
CELLS = 1 << 20


class Ilsia:
    """Incremental strong lattice independent sources of standardised samples.

    A sample that depends on the sources (or is within ``alpha`` of what they recall) replaces the source of most like
    signs if it is longer; another one joins if it is dominant with them.
    """

    def __init__(self, mean: np.ndarray, std: np.ndarray, alpha: float = 0.0):
        self.mean, self.scale, self.alpha = mean, np.where(std == 0, 1, std), alpha
        self.ids: list[int] = []
        self.own = np.zeros((0, len(mean)))

    def points(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def put(self, ident: int, v: np.ndarray, place: int) -> None:
        """A new source, at the end or in the place of another."""
        if place < 0:
            self.ids.append(ident)
            self.own = np.vstack([self.own, v])
        else:
            self.ids[place], self.own[place] = ident, v
        self.lam = (self.own[:, :, None] - self.own[:, None, :]).min(0)

    def _close(self, v: np.ndarray) -> np.ndarray:
        w = self.lam
        if self.alpha == 0:
            return np.abs((w[None] + v[:, None, :]).max(2) - v).max(1) <= 1e-9
        low = (v[:, None, :] - w.T[None]).min(2)
        mu = (w[None] + low[:, None, :]).max(2) - v
        c = (w[None] + (0.5 * np.abs(mu).max(1, keepdims=True) + low)[:, None, :]).max(2)
        return np.abs(c - v).max(1) < self.alpha

    def _dominant(self, v: np.ndarray, high: bool) -> np.ndarray:
        end = (lambda d: d.max(-1, keepdims=True)) if high else (lambda d: d.min(-1, keepdims=True))
        hits = lambda d: np.isclose(d, end(d), atol=1e-9)
        m = len(self.own)
        new, out = np.ones(v.shape, bool), np.ones(len(v), bool)
        for j in range(m):
            others = np.delete(np.arange(m), j)
            among = hits(self.own[j] - self.own[others]).all(0) if m > 1 else True
            out &= (hits(self.own[j] - v) & among).any(1)
            new &= hits(v - self.own[j])
        return out & new.any(1)

    def events(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each sample changes the sources, and the place it takes (-1: a new one)."""
        close = self._close(v)
        agree = np.stack([(np.sign(s) == np.sign(v)).sum(1) for s in self.own], 1)
        like = agree.argmax(1)
        longer = np.linalg.norm(self.own, axis=1)[like] < np.linalg.norm(v, axis=1)
        found, place = close & longer, np.where(close, like, -1)
        rest = np.flatnonzero(~close)
        if len(rest):
            found[rest] = self._dominant(v[rest], True) | self._dominant(v[rest], False)
        return found, place


class Eiha:
    """Extremes: the farthest sample of each quadrant about the mean, where its signs, moved by ``alpha`` deviations, are
    not below or not above those of all others."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, alpha: float = 2.0):
        self.mean, self.std, self.alpha = mean, std, alpha
        self.ids: list[int] = []
        self.own = np.zeros((0, len(mean)))

    def points(self, x: np.ndarray) -> np.ndarray:
        return x

    put = Ilsia.put

    def events(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = v - self.mean
        same = np.stack([(np.sign(e - self.mean) == np.sign(d)).all(1) for e in self.own], 1)
        any_same, first = same.any(1), same.argmax(1)
        farther = np.linalg.norm(d, axis=1) > np.linalg.norm(self.own - self.mean, axis=1)[first]
        near = np.stack([((v - e) ** 2 < self.alpha * self.std).all(1) for e in self.own], 1).any(1)
        others = self.own - self.mean > 0
        up, down = v + self.alpha * self.std - self.mean > 0, v - self.alpha * self.std - self.mean > 0
        below = np.stack([(o >= up).all(1) for o in others], 1).any(1)
        above = np.stack([(o <= down).all(1) for o in others], 1).any(1)
        return np.where(any_same, farther, ~near & (~below | ~above)), np.where(any_same, first, -1)


METHODS = {"ilsia": Ilsia, "eiha": Eiha}


def _go_on(state, ids: np.ndarray, v: np.ndarray) -> bool:
    """Takes samples in their order; whether any changed the sources."""
    at, changed, step = 0, False, max(1, CELLS // max(1, v.shape[1] ** 2))
    while at < len(ids):
        own, fresh = slice(at, at + step), None
        found, place = state.events(v[own])
        found &= ~np.isin(ids[own], state.ids) & (v[own] != 0).any(1)
        if not found.any():
            at += step
            continue
        fresh = int(np.flatnonzero(found)[0])
        state.put(int(ids[at + fresh]), v[at + fresh], int(place[fresh]))
        at, changed = at + fresh + 1, True
    return changed


def _runs(batches, keys: int):
    """(key, ids, x) of runs of equal keys in a task's sorted rows."""
    for b in batches:
        if not b.num_rows:
            continue
        names = list(zip(*[b.column(i).to_pylist() for i in range(keys)], strict=True))
        cut = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        ids, x = b.column(keys).to_numpy(), b.column(keys + 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(names), -1)
        for a, e in zip(cut, cut[1:]):
            yield names[a], ids[a:e], x[a:e]


def sources(samples: DataFrame, method: str, by: list[str], seed: int = 0, **options) -> dict[tuple, list[int]]:
    """The ids of the sources of each group of ``samples`` (*by, id, x), in the order of induction.

    The first source is the sample of smallest seeded hash of its id among those that are not 0 (for ILSIA, after
    standardisation); the others are taken by ascending id. A group of zeros has none.
    """
    out: dict[tuple, list[int]] = {}
    n = samples.select(*by).distinct().count()
    blocks = -(-n // GROUPS)
    for block in range(blocks):
        part = samples if blocks == 1 else samples.filter(F.pmod(F.xxhash64(*by), F.lit(blocks)) == block)
        out.update(_block(part.select(*by, "id", F.col("x").cast("array<double>").alias("x")), METHODS[method], by, seed, options))
    return out


def _block(samples: DataFrame, kind, by: list[str], seed: int, options: dict) -> dict[tuple, list[int]]:
    keys = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in by)
    rows = samples.repartitionByRange(*by, "id").sortWithinPartitions(*by, "id").persist()
    try:
        stats = samples.select(*by, F.posexplode("x").alias("i", "v")).groupBy(*by, "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        stats = stats.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("d"))
        states = {tuple(r[c] for c in by): kind(np.array([d["m"] for d in r["d"]]), np.array([d["s"] for d in r["d"]]), **options) for r in stats.collect()}
        types = [samples.select(*by).limit(0).toArrow().schema.field(c).type for c in by]

        def first(batches):
            best: dict[tuple, tuple] = {}
            for key, ids, x, h in _hashed(batches, len(by)):
                some = np.flatnonzero((states[key].points(x) != 0).any(1))
                for i in some[np.lexsort((ids[some], h[some]))[:1]]:
                    if key not in best or (h[i], ids[i]) < best[key][:2]:
                        best[key] = (h[i], ids[i], x[i])
            cols = [pa.array([k[i] for k in best], types[i]) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.int64()), pa.array([v[2].tolist() for v in best.values()], pa.list_(pa.float64()))], names=[*by, "h", "id", "x"])

        hashed = rows.select(*by, "id", "x", F.xxhash64(F.col("id"), F.lit(seed)).alias("h"))
        starts = hashed.mapInArrow(first, f"{keys}, h long, id long, x array<double>").groupBy(*by).agg(F.min(F.struct("h", "id", "x")).alias("s"))
        live: dict[tuple, int | None] = {}
        for r in starts.collect():
            key = tuple(r[c] for c in by)
            states[key].put(r["s"]["id"], states[key].points(np.array([r["s"]["x"]]))[0], -1)
            live[key] = None
        while live:
            live = _pass(rows, states, live, by, keys, types)
        return {k: s.ids for k, s in states.items()}
    finally:
        rows.unpersist()


def _hashed(batches, keys: int):
    for b in batches:
        at = 0
        for key, ids, x in _runs([b], keys):
            yield key, ids, x, b.column(keys + 2).to_numpy()[at : at + len(ids)]
            at += len(ids)


def _pass(rows: DataFrame, states: dict, live: dict, by: list[str], keys: str, types: list) -> dict:
    """One pass of all ranges; takes over the earliest change of each group, and returns the groups that had one, with the
    last id behind which to go on."""
    import copy

    def run(batches):
        held: dict[tuple, list] = {}
        for key, ids, x in _runs(batches, len(by)):
            if key not in live:
                continue
            if live[key] is not None:
                later = ids > live[key]
                ids, x = ids[later], x[later]
            if not len(ids):
                continue
            if key not in held:
                held[key] = [copy.deepcopy(states[key]), int(ids[0]), False, 0]
            own = held[key]
            own[2] |= _go_on(own[0], ids, own[0].points(x))
            own[3] = int(ids[-1])
        done = {k: v for k, v in held.items() if v[2]}
        cols = [pa.array([k[i] for k in done], types[i]) for i in range(len(by))]
        lists = [pa.array([v[1] for v in done.values()], pa.int64()), pa.array([v[3] for v in done.values()], pa.int64()), pa.array([v[0].ids for v in done.values()], pa.list_(pa.int64())), pa.array([v[0].own.ravel().tolist() for v in done.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([*cols, *lists], names=[*by, "first", "last", "ids", "own"])

    found = rows.select(*by, "id", "x").mapInArrow(run, f"{keys}, first long, last long, ids array<long>, own array<double>")
    found = found.groupBy(*by).agg(F.min(F.struct("first", "last", "ids", "own")).alias("s"))
    after = {}
    for r in found.collect():
        key, s = tuple(r[c] for c in by), r["s"]
        state = states[key]
        state.ids, state.own = list(s["ids"]), np.array(s["own"]).reshape(len(s["ids"]), -1)
        state.lam = (state.own[:, :, None] - state.own[:, None, :]).min(0)
        after[key] = s["last"]
    return after


def induce(samples: DataFrame, method: str, by: list[str], n_comps: int | None = None, seed: int = 0, **options) -> DataFrame:
    """(*by, id, source): samples (*by, id, x) with a 0/1 flag of the rows that ILSIA or EIHA takes, in each group; of them
    the first ``n_comps``. Null keys are groups; ids are unique in a group."""
    found = [(*key, i) for key, ids in sources(samples, method, by, seed, **options).items() for i in ids[:n_comps]]
    keys = ", ".join(f"__{c} {samples.schema[c].dataType.simpleString()}" for c in by)
    chosen = small(samples.sparkSession.createDataFrame(found, f"{keys}, __id long"))
    same = F.col("id") == F.col("__id")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = samples.select(*by, "id").join(chosen, same, "left")
    return out.select(*by, "id", F.col("__id").isNotNull().cast("int").alias("source"))
