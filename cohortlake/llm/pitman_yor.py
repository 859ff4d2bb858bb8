"""A hierarchical Pitman-Yor language model over words, seated by Gibbs sampling in Spark tasks.

Restaurants stand in two levels above the base: one for each context, the word before a token, and the root, the parent
that all of them share; the root draws from an even base over the known words and one unknown. Contexts and words are
told apart by 48-bit hashes (a hundred million words have 18 pairs alike), so restaurants and dishes grow with the corpus. A customer of a dish sits at a table; each
table of a context is a customer of the same dish in the root.

Tokens are dealt by their context into buckets of bounded size, so a context's restaurant is whole inside a bucket. The
root is dealt by word: after each round the buckets send it their tables of each word, it seats them, and sends back
each word's count, customers and tables. Within a round a bucket makes Gibbs sweeps over the
dishes: given all others' tables as of the sweep's start, a dish's customers sit anew, a table's worth at a time: those
of one table part into two, or of two go to one. Who parts is drawn by the exact chances of every way to part, and
accepted by Metropolis and Hastings's rule, so that a frequent dish needs moves for its tables, not for its customers.
All dishes of all restaurants are seated by this one law. Seats are kept from round to round; draws come from seeds by
bucket and round, so a lost task gives the same again. Predictive probabilities are averaged over the states of the last
round after ``BURN_IN``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import new_path, short_shuffles, small_batches, stored, tidy, tidy_groups
from cohortlake.llm.words import LOWER, NON_SPACE, chunks, find_words

SWEEPS, BURN_IN, SEED = 5, 2, 11  # of the last round; the rounds before make BURN_IN sweeps
ROUNDS = 2  # in which the root is seated
BUCKET_TOKENS = 1_250_000
BYTES_PER_TOKEN = 6
#: Strength of the contexts' restaurants and of the root.
STRENGTH = (1.0, 10.0)
ROWS = 30_000  # of a piece of work; with one bit for held-out rows they fit 16 bits
PIECE_BYTES = 12 << 20  # of text dealt at a time
HOMES = 8  # buckets for each part of the root
#: Sums of logarithms travel as multiples of 2^-32 (add-one counts) and 2^-24 (the model): a document's sum is off by
#: half of that for each bucket at most.
FINE = (float(1 << 32), float(1 << 24))
_SPARE = np.uint64(16)  # bits of a 64-bit hash that are not kept
_END = np.uint64(0xE9D000000001)
_BEGIN = np.uint64(0xBE6100000003)


def packed(*arrays: np.ndarray) -> bytes:
    head = b"".join(a.dtype.str.encode().ljust(8) + len(a).to_bytes(8, "little") for a in arrays)
    raw = len(arrays).to_bytes(8, "little") + head + b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    at, out = 8 + 16 * n, []
    for i in range(n):
        kind = np.dtype(raw[8 + 16 * i : 16 + 16 * i].decode().strip())
        size = int.from_bytes(raw[16 + 16 * i : 24 + 16 * i], "little")
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


def narrow(values: np.ndarray, limit: int) -> np.ndarray:
    """Numbers below ``limit`` in as few bytes as hold them."""
    return values.astype(np.min_scalar_type(max(0, limit - 1)))


def planes(values: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then the second ones, and so on: what is alike stands together, and packs well."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T).reshape(-1)


def values_of(planes: np.ndarray, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def steps(ordered: np.ndarray) -> np.ndarray:
    """Hashes in order as the planes of their differences."""
    return planes(np.diff(ordered, prepend=np.zeros(1, np.uint64)))


def hashes_of(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(values_of(steps, np.uint64), dtype=np.uint64)


def part_of(words: np.ndarray, n: int) -> np.ndarray:
    """The part 0..n-1 of each hash; parts are ranges of hashes."""
    return ((words >> np.uint64(16)) * np.uint64(n)) >> np.uint64(32)


def token_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, whether it is its text's first, and row of all tokens of a column: each text's words and its end."""
    hashes, firsts, rows = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.uint16)]
    for a, b in chunks(column):
        words = find_words(column.slice(a, b - a), NON_SPACE, LOWER)
        first = words.first_word()
        n = words.n_texts
        h = np.empty(len(words.hash) + n, dtype=np.uint64)
        h[np.arange(len(words.hash)) + words.text] = words.hash >> _SPARE
        ends = first[1:] + np.arange(n)
        h[ends] = _END
        begins = np.zeros(len(h), bool)
        begins[np.concatenate([[0], ends[:-1] + 1])] = True
        hashes.append(h)
        firsts.append(begins)
        rows.append(np.repeat(np.arange(a, b, dtype=np.uint16), np.diff(first) + 1))
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(rows)


def pieces(batches):
    """Batches put together to about ``PIECE_BYTES`` and at most ``ROWS`` rows."""
    held, rows, size = [], 0, 0
    join = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            if held and (rows + b.num_rows > ROWS or size + b.nbytes > PIECE_BYTES):
                yield join()
                held, rows, size = [], 0, 0
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
    if held:
        yield join()


def blob(words: np.ndarray, near: np.ndarray, w: np.ndarray, row: np.ndarray) -> bytes:
    return packed(steps(words), *[planes(x.astype(np.uint32)) for x in (np.diff(near, prepend=0), w)], planes(row.astype(np.uint16)))


def opened(blob: bytes) -> tuple[np.ndarray, ...]:
    words, near, w, row = unpacked(blob)
    return hashes_of(words), np.cumsum(values_of(near, np.uint32), dtype=np.int64), values_of(w, np.uint32).astype(np.int64), values_of(row, np.uint16)


def dealt(docs: DataFrame, buckets: int, key_kind: str) -> DataFrame:
    """``docs`` (key, text, held) to one row per piece and bucket of its tokens, and one row (bucket below 0) of its keys.

    A blob has its words' hashes in order, and of each token, by context and word, the number of its context and of its
    own word, and its row with the held-out bit.
    """

    def run(batches):
        pid = TaskContext.get().partitionId()
        for no, b in enumerate(pieces(batches)):
            held = b.column(2).to_numpy(zero_copy_only=False)
            h, begins, row = token_arrays(b.column(1))
            count = np.bincount(row, minlength=b.num_rows)
            row = row | (held[row].astype(np.uint16) << 15)
            words, w = np.unique(np.append(h, _BEGIN), return_inverse=True)
            del h
            begin, w, n = w[-1], w[:-1], len(words)
            near = np.full_like(w, begin)
            near[1:] = w[:-1]
            near[begins] = begin
            order = np.argsort(near * n + w)
            near, w, row = near[order], w[order], row[order]
            border = np.searchsorted(near, np.searchsorted(part_of(words, buckets), np.arange(buckets + 1, dtype=np.uint64)))
            some, blobs = np.flatnonzero(np.diff(border)), []
            for k in some:
                s = slice(border[k], border[k + 1])
                own, ids = np.unique(np.concatenate([near[s], w[s]]), return_inverse=True)
                blobs.append(blob(words[own], *ids.reshape(2, -1), row[s]))
            k = len(some)
            keys = pa.ListArray.from_arrays(pa.array([0] * (k + 1) + [b.num_rows], pa.int32()), b.column(0))
            counts = pa.array([None] * k + [count.tolist()], pa.list_(pa.int64()))
            flags = pa.array([None] * k + [held.tolist()], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*some.tolist(), -1 - (pid * 4099 + no) % (1 << 30)], pa.int32()), pa.array([pid] * (k + 1), pa.int32()), pa.array([no] * (k + 1), pa.int32()), pa.array([*blobs, None], pa.binary()), keys, counts, flags],
                names=["bucket", "pid", "no", "blob", "keys", "counts", "held"],
            )

    return docs.mapInArrow(tidy(run), f"bucket int, pid int, no int, blob binary, keys array<{key_kind}>, counts array<long>, held array<boolean>")


def counted(blobs: list[bytes]) -> tuple[bytes, list[int]]:
    """All words of a bucket and its dishes (context, word, customers) from the training tokens; and their statistics."""
    parts = [opened(x) for x in blobs]
    words = np.unique(np.concatenate([p[0] for p in parts]))
    keys, n = [], len(words)
    for own, near, w, row in parts:
        at, train = np.searchsorted(words, own), row < 1 << 15
        keys.append(at[near[train]] * n + at[w[train]])
    del parts
    dish, c = np.unique(np.concatenate(keys), return_counts=True)
    model = [planes(x.astype(np.uint32)) for x in (np.diff(dish // n, prepend=0), dish % n, c)]
    return packed(steps(words), *model), [int(c.sum()), int((c == 1).sum()), int((c == 2).sum())]


_TABLE = "bucket int, pid int, no int, model binary, stats array<long>, tokens array<struct<pid: int, no: int, blob: binary>>, keys array<{0}>, counts array<long>, held array<boolean>"


def _gather(key, table):
    """A bucket's pieces to one row with its model; the keys of pieces pass."""
    table = table.combine_chunks().sort_by([("pid", "ascending"), ("no", "ascending")])
    pid, no, blobs = (table.column(c).to_pylist() for c in ("pid", "no", "blob"))
    kind = pa.list_(pa.struct([("pid", pa.int32()), ("no", pa.int32()), ("blob", pa.binary())]))
    if blobs[0] is None:
        n = table.num_rows
        model, stats, tokens, one = pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, kind), table
    else:
        found, numbers = counted(blobs)
        one = table.slice(0, 1)
        model, stats = pa.array([found], pa.binary()), pa.array([numbers], pa.list_(pa.int64()))
        tokens = pa.array([[{"pid": p, "no": n, "blob": x} for p, n, x in zip(pid, no, blobs, strict=True)]], kind)
    return pa.table({"bucket": one.column("bucket"), "pid": one.column("pid"), "no": one.column("no"), "model": model, "stats": stats, "tokens": tokens, **{c: one.column(c) for c in ("keys", "counts", "held")}})


class Parting:
    """How s customers of one table, or of two tables put together, part into two.

    The ways to part weigh by their sizes i and s - i as (1-d)(2-d)...(i-1-d) times (1-d)(2-d)...(s-i-1-d). ``rate`` is
    the weight of all ways over that of one table; ``draw`` gives the second table's size by these weights. Both come from
    r(s) = (2-2d)(3-2d)...(s-1-2d) / (1-d)(2-d)...(s-1-d): up to ``EXACT`` from a table, beyond by its series in 1/s,
    whose error is below 1e-9 there.
    """

    EXACT = 1 << 16

    def __init__(self, d: float):
        s = np.arange(3, self.EXACT + 1)
        self.d, self.inverse = d, np.concatenate([[1.0], np.cumprod((s - 1 - d) / (s - 1 - 2 * d))]) * (1 - d)  # 1 / r(2), ...
        self.bend = d * (3 * d + 1) / 2
        self.scale = self.inverse[-1] * float(self.EXACT) ** -d * (1 + self.bend / self.EXACT)

    def inverse_r(self, s: np.ndarray) -> np.ndarray:
        x = np.maximum(s, self.EXACT).astype(float)
        return np.where(s <= self.EXACT, self.inverse[np.minimum(s, self.EXACT) - 2], self.scale * x**self.d / (1 + self.bend / x))

    def rate(self, s: np.ndarray) -> np.ndarray:
        return (1 - (1 - 2 * self.d) / self.inverse_r(s)) / self.d

    def draw(self, s: np.ndarray, rng) -> np.ndarray:
        """Customer m + 1 opens the second table with a chance that falls with m; those after them go where the others do."""
        d = self.d
        goal = (1 - 2 * d) + (1 - rng.random(len(s))) * (self.inverse_r(s) - (1 - 2 * d))
        m = np.searchsorted(self.inverse, goal) + 1
        far = np.flatnonzero(m > self.EXACT - 1)
        if len(far):
            x = (goal[far] / self.scale) ** (1 / d)
            m[far] = np.ceil((goal[far] / self.scale * (1 + self.bend / x)) ** (1 / d)).astype(np.int64) - 1
        m = np.minimum(m, s - 1)
        return 1 + rng.binomial(s - m - 1, rng.beta(1 - d, m - d))


@lru_cache(8)
def parting(d: float) -> Parting:
    return Parting(d)


class Seating:
    """Customers of many dishes at tables. Dish x has ``n[x]`` customers at ``t[x]`` tables, whose sizes stand from ``first[x]`` on."""

    def __init__(self, n: np.ndarray):
        self.n = n.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])[:-1]
        self.size = np.zeros(int(self.n.sum()), np.min_scalar_type(int(self.n.max(initial=0))))  # no dish has more tables than customers
        self.t = np.ones(len(n), np.int64)
        self.size[self.first] = self.n

    def _places(self, t: np.ndarray) -> np.ndarray:
        return np.repeat(self.first, t) + np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)

    def fill(self, t: np.ndarray, sizes: np.ndarray) -> Seating:
        """Seats the customers by what ``tables`` gave."""
        self.t = t.astype(np.int64)
        self.size[self._places(self.t - 1)] = sizes
        dish = np.repeat(np.arange(len(t)), self.t - 1)
        self.size[self.first + self.t - 1] = self.n - np.bincount(dish, sizes, len(t)).astype(np.int64)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Each dish's number of tables, and the sizes of all but its last one, which has the rest."""
        return self.t.copy(), self.size[self._places(self.t - 1)]

    def pick(self, rng) -> None:
        """A customer of each dish, any with the same chance, is its pivot: their table goes to the first place."""
        at = np.searchsorted(np.cumsum(self.size, dtype=np.int64), self.first + (rng.random(len(self.n)) * self.n).astype(np.int64), "right")
        self.size[self.first], self.size[at] = self.size[at], self.size[self.first]

    def split(self, x: np.ndarray, base: np.ndarray, p: np.ndarray, d: float, rng) -> None:
        """Of each dish, the pivot's table parts into theirs and one more, if that is accepted."""
        s = self.size[self.first[x]].astype(np.int64)
        x, s = x[s > 1], s[s > 1]
        t = self.t[x]
        goes = rng.random(len(x)) * t < (base[x] + d * t * p[x]) * parting(d).rate(s)
        x, s, t = x[goes], s[goes], t[goes]
        second = parting(d).draw(s, rng)
        self.size[self.first[x]] = s - second
        self.size[self.first[x] + t] = second
        self.t[x] += 1

    def join(self, x: np.ndarray, base: np.ndarray, p: np.ndarray, d: float, rng) -> None:
        """Of each dish, another table, any with the same chance, joins the pivot's, if that is accepted: what undoes a split."""
        x = x[self.t[x] > 1]
        t, first = self.t[x] - 1, self.first[x]
        other = first + 1 + (rng.random(len(x)) * t).astype(np.int64)
        s = self.size[first].astype(np.int64) + self.size[other]
        goes = rng.random(len(x)) * (base[x] + d * t * p[x]) * parting(d).rate(s) < t
        x, t, first, other = x[goes], t[goes], first[goes], other[goes]
        self.size[first] = s[goes]
        self.size[other] = self.size[first + t]
        self.size[first + t] = 0
        self.t[x] = t

    def sweep(self, others: np.ndarray, p: np.ndarray, strength: float, d: float, rng) -> None:
        """Customers of each dish sit anew, a table's worth at a time. ``others``: tables of other dishes in the restaurant;
        ``p``: the dish's share in the parent. Both as of the sweep's start.

        A dish makes two moves for each table that ``others`` and ``p`` let expect, and two more: they know nothing of the
        tables that it has, so its seats keep their distribution. It makes at most two for each of its customers.
        """
        base = (strength + d * others) * p
        moves = np.where(self.n > 1, np.ceil(np.minimum(2 * self.n, 2 + 2 * base / d)), 0).astype(np.int64)
        self.pick(rng)
        x = np.argsort(-moves, kind="stable")
        left = len(x) - np.searchsorted(np.sort(moves), np.arange(1, int(moves.max(initial=0)) + 1))
        for k in left.tolist():
            splits = rng.random(k) < 0.5
            self.split(x[:k][splits], base, p, d, rng)
            self.join(x[:k][~splits], base, p, d, rng)


@dataclass(frozen=True)
class Setting:
    tokens: int  # N
    words: int  # V
    discounts: tuple[float, float]
    root_customers: int
    root_tables: int

    def root(self, m, k) -> np.ndarray:
        """The root's probability of words with m customers at k tables."""
        d, s = self.discounts[1], STRENGTH[1]
        return (m - d * k + (s + d * self.root_tables) / (self.words + 1)) / (s + self.root_customers)


class Bucket:
    """The restaurants of a bucket's contexts. Dishes are in order of context and word."""

    def __init__(self, model: bytes, seats: bytes | None = None):
        words, near, w, c = unpacked(model)
        self.words, n = hashes_of(words), len(words) // 8
        self.near = np.cumsum(values_of(near, np.uint32), dtype=np.int64)
        self.word, self.c = (values_of(x, np.uint32).astype(np.int64) for x in (w, c))
        self.n, self.keys = n, self.near * n + self.word
        self.count = np.bincount(self.word, self.c, n).astype(np.int64)
        self.customers = np.bincount(self.near, self.c, n)
        self.some = np.flatnonzero(self.c > 1)  # dishes of one customer have one table
        self.t = np.ones(len(self.c), np.int64)
        size = self.c[self.some]
        self.seating = Seating(size)
        if seats is not None:
            self.seating.fill(*[x.astype(np.int64) for x in unpacked(seats)])
            self.t[self.some] = self.seating.t

    def seats(self) -> bytes:
        return packed(*[narrow(x, int(x.max(initial=0)) + 1) for x in self.seating.tables()])

    def sent(self) -> np.ndarray:
        """Customers that each word has in the root: its tables."""
        return np.bincount(self.word, self.t, self.n).astype(np.int64)

    def sweep(self, root: np.ndarray, setting: Setting, rng) -> None:
        tables, some = np.bincount(self.near, self.t, self.n), self.some
        self.seating.sweep(tables[self.near[some]] - self.t[some], root[self.word[some]], STRENGTH[0], setting.discounts[0], rng)
        self.t[some] = self.seating.t

    def state(self, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
        """What each dish has of its own (0 stands last for dishes that are not there), and what a context leaves to the root."""
        d = setting.discounts[0]
        return np.append(self.c - d * self.t, 0.0), STRENGTH[0] + d * np.bincount(self.near, self.t, self.n)


def predicted(bucket: Bucket, states: list, root: np.ndarray, near: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The mean over ``states`` of the probability of each token."""
    wanted, last = near * bucket.n + w, len(bucket.keys)
    dish = np.searchsorted(bucket.keys, wanted)
    if last:
        dish[bucket.keys[np.minimum(dish, last - 1)] != wanted] = last
    p = sum(own[dish] + left[near] * root[w] for own, left in states)
    return p / ((STRENGTH[0] + bucket.customers[near]) * len(states))


_MAIL = "home int, bucket int, blob binary"
_REPLY = "bucket int, home int, blob binary, stats array<long>"


def messages(bucket: int, state: Bucket, homes: int, keep: bool) -> list[tuple[int, int, bytes]]:
    """To each part of the root the words of its range, their customers and counts; to the bucket itself its seats."""
    words, m, n = state.words, state.sent(), state.count
    border = np.searchsorted(part_of(words, homes), np.arange(homes + 1, dtype=np.uint64))
    out = []
    for h in np.flatnonzero(np.diff(border)):
        s = slice(border[h], border[h + 1])
        out.append((int(h), bucket, packed(steps(words[s]), *[narrow(x[s], int(x[s].max()) + 1) for x in (m, n)])))
    return out + ([(-1 - bucket, bucket, state.seats())] if keep else [])


def _mail(rows) -> pa.Table:
    home, bucket, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"home": pa.array(home, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _seat_root(setting: Setting | None, no: int):
    """A part of the root: sums what buckets send, seats it, and answers each; without a setting all words have one table."""

    def run(key, table):
        home, bucket, blobs = (table.column(c).to_pylist() for c in ("home", "bucket", "blob"))
        if home[0] < 0:
            return pa.table({"bucket": pa.array(bucket, pa.int32()), "home": pa.array(home, pa.int32()), "blob": pa.array(blobs, pa.binary()), "stats": pa.nulls(len(home), pa.list_(pa.int64()))})
        parts = sorted(((b, (hashes_of(w), m, n)) for b, (w, m, n) in zip(bucket, map(unpacked, blobs), strict=True)), key=lambda x: x[0])
        words = np.unique(np.concatenate([p[0] for _, p in parts]))
        m, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = [np.searchsorted(words, p[0]) for _, p in parts]
        for i, (_, p) in zip(at, parts, strict=True):
            m[i] += p[1]
            n[i] += p[2]
        k = (m > 0).astype(np.int64)
        if setting is not None:
            seated = np.flatnonzero(m)
            seating = Seating(m[seated])
            rng = np.random.default_rng([SEED, 1, no, home[0]])
            for _ in range(BURN_IN):
                seating.sweep(setting.root_tables - seating.t, np.full(len(seated), 1 / (setting.words + 1)), STRENGTH[1], setting.discounts[1], rng)
            k[seated] = seating.t
        stats = [int(x) for x in ((n > 0).sum(), m.sum(), k.sum(), (m == 1).sum(), (m == 2).sum())]
        rows = [packed(*[narrow(x[i], int(x[i].max()) + 1) for x in (n, m, k)]) for i in at]
        return pa.table({
            "bucket": pa.array([b for b, _ in parts], pa.int32()), "home": pa.array([home[0]] * len(rows), pa.int32()), "blob": pa.array(rows, pa.binary()),
            "stats": pa.array([stats] + [None] * (len(rows) - 1), pa.list_(pa.int64())),
        })

    return run


def _opened(left, right) -> tuple[int, Bucket, list[np.ndarray]]:
    """A bucket with its seats, and of each of its words the count, root customers and root tables."""
    mail = sorted(zip(right.column("home").to_pylist(), right.column("blob").to_pylist(), strict=True))
    seats = mail[0][1] if mail[0][0] < 0 else None
    answers = [unpacked(x) for h, x in mail if h >= 0]
    return left.column("bucket")[0].as_py(), Bucket(left.column("model")[0].as_py(), seats), [np.concatenate([a[i].astype(np.int64) for a in answers]) for i in range(3)]


def _round(setting: Setting, no: int, homes: int):
    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return _mail([])
        name, bucket, (_, m, k) = _opened(left, right)
        rng, root = np.random.default_rng([SEED, 0, no, name]), setting.root(m, k)
        for _ in range(BURN_IN):
            bucket.sweep(root, setting, rng)
        return _mail(messages(name, bucket, homes, True))

    return run


_PART = "pid int, no int, part binary"


def _scored(setting: Setting, no: int, sweeps: int, burn_in: int):
    """For each bucket and piece: rows, known tokens, sums of log10(count + 1) and of log10 of the model."""

    def run(left, right):
        rows = []
        if left.num_rows and right.num_rows:
            name, bucket, (n, m, k) = _opened(left, right)
            rng, root, states = np.random.default_rng([SEED, 0, no, name]), setting.root(m, k), []
            for i in range(sweeps):
                bucket.sweep(root, setting, rng)
                if i >= burn_in:
                    states.append(bucket.state(setting))
            bucket.seating = None
            add_one = np.log10(n + 1)
            for x in left.column("tokens")[0].values:
                words, near, w, row = opened(x["blob"].as_py())
                at = np.searchsorted(bucket.words, words)
                near, w = at[near], at[w]
                p = predicted(bucket, states, root, near, w)
                there, at = np.unique(row & np.uint16(0x7FFF), return_inverse=True)
                known, base, score = (np.bincount(at, v) for v in (n[w] > 0, add_one[w], np.log10(p)))
                sums = [planes(np.rint(v * f).astype(np.int64)) for v, f in zip((base, -score), FINE, strict=True)]
                rows.append((x["pid"].as_py(), x["no"].as_py(), packed(planes(np.diff(there, prepend=np.zeros(1, np.uint16))), planes(known.astype(np.uint32)), *sums)))
        pid, piece, part = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"pid": pa.array(pid, pa.int32()), "no": pa.array(piece, pa.int32()), "part": pa.array(part, pa.binary())})

    return run


def _total(left, right):
    keys = right.column("keys").combine_chunks().flatten()
    n, held = (right.column(c).combine_chunks().flatten() for c in ("counts", "held"))
    known, base, score = np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.zeros(len(keys))
    for x in left.column("part"):
        at, k, b, s = (values_of(v, kind) for v, kind in zip(unpacked(x.as_py()), (np.uint16, np.uint32, np.int64, np.int64), strict=True))
        at = np.cumsum(at, dtype=np.int64)
        known[at] += k
        base[at] += b / FINE[0]
        score[at] -= s / FINE[1]
    return pa.table({"key": keys, "held_out": held, "n_tokens": n, "n_known": pa.array(known), "base": pa.array(base), "score": pa.array(score)})


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """``df`` written to the shared folder as a table bucketed by ``key``: later joins on it leave its rows where they are."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    with short_shuffles(spark):
        df.write.bucketBy(n, key).option("path", new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def _sums(df: DataFrame, column: str, n: int) -> list[int]:
    row = df.agg(*[F.sum(F.col(column)[i]).alias(str(i)) for i in range(n)]).first()
    return [int(x or 0) for x in row]


def _discount(one: int, two: int) -> float:
    return float(np.clip(one / max(1, one + 2 * two), 0.05, 0.95))


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score (see the query's contract).

    Learns from the rows where ``held_out`` is not true. A null text is an empty one: its end alone. Repeated rows each
    count; a null key is a key; other columns are ignored. Without training rows every word is unknown; an empty table
    gives an empty result. A word is known by 48 bits of its hash.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(size // (BYTES_PER_TOKEN * bucket_tokens)) + 1, docs.sparkSession.sparkContext.defaultParallelism)
    homes, files = buckets // HOMES + 1, min(2 * buckets + 10, 50_000)  # so few buckets share a task and a file
    sent = dealt(rows, buckets, kind).repartition(files, "bucket")
    whole = bucketed(sent.groupBy("bucket").applyInArrow(tidy_groups(_gather), _TABLE.format(kind)), "restaurants", "bucket", files)
    keyed = whole.filter("bucket < 0").select("pid", "no", "keys", "counts", "held")
    table = whole.filter("bucket >= 0")
    tokens, *ones = _sums(table, "stats", 3)

    def first(batches):
        for b in batches:
            for bucket, model in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _mail(messages(bucket, Bucket(model.as_py()), homes, False)).to_batches()

    setting, mail = None, table.select("bucket", "model").mapInArrow(tidy(first), _MAIL)
    for no in range(ROUNDS):
        with short_shuffles(docs.sparkSession):
            answers = stored(mail.groupBy("home").applyInArrow(tidy_groups(_seat_root(setting, no)), _REPLY), "root")
        words, customers, tables, *root_ones = _sums(answers, "stats", 5)
        discounts = (_discount(*ones), _discount(*root_ones)) if setting is None else setting.discounts
        setting = Setting(tokens, words, discounts, customers, tables)
        if no < ROUNDS - 1:
            mail = table.select("bucket", "model").groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(tidy_groups(_round(setting, no, homes)), _MAIL)
    parts = table.select("bucket", "model", "tokens").groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(tidy_groups(_scored(setting, ROUNDS, sweeps, burn_in)), _PART)
    total = parts.groupBy("pid", "no").cogroup(keyed.groupBy("pid", "no")).applyInArrow(_total, f"key {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    free = float(np.log10(setting.tokens + setting.words + 1))
    return total.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(setting.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(free)).alias("base_score"), "score")
