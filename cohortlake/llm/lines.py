"""Line dedup by pairwise alignment.

Documents are linked through the lines that few of them hold (rare ones, by their hash): each holder to every earlier
one. A line of many documents says little about an overlap, so it links only where it is long or beside another line that
is shared with it: each run of two lines links its holders too, whatever its length and however many they are. Lines and
runs of many holders link each holder to the first one and to the one before it, so that a passage in any number of
documents makes two links for each and never all pairs. The lines of each linked pair are aligned as patience diff does: equal
lines at either end are taken, lines that are single on both sides are the anchors, their longest run in rising order
on both sides is kept, and what lies between two anchors is aligned in the same way. The aligned blocks are deleted from
the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlake.llm.common import sent, stored, tidy
from cohortlake.llm.words import NON_SPACE, chunks, find_words, mix, span_hash

#: Documents that hold a rare line at most.
RARE = 8
#: Words from which on a single line links its holders however many they are.
LONG = 25
#: Words that an aligned block holds at least to be deleted: any line with a word.
MIN_WORDS = 1
#: Rows of links or of found documents (some 60 bytes each), and deleted lines (4 bytes each), that may be sent to every task.
BROADCAST_ROWS, BROADCAST_ITEMS = 500_000, 2_000_000
#: Pairs of equal lines without an anchor that are listed to find the longest common run; beyond that rows of bits give
#: the same run.
MAX_MATCHES = 1_000_000
_TWO = np.uint64(0xD1342543DE82EF95)  # of a run's first line


def line_table(docs: DataFrame, key: str, text: str, long: int) -> DataFrame:
    """A row per document (k, t) with a word: ``lines`` (a hash of each line with a word), their ``words`` and line
    ``numbers``, and the distinct ``keys`` that may link it: other hashes of its lines and of its runs of two lines, each with whether it
    links any number of holders (``heavy``)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                words = find_words(part.column(2), NON_SPACE)
                data, borders = words.data, words.borders
                start = np.unique(np.concatenate([borders[:-1][np.diff(borders) > 0], np.flatnonzero(data == 10) + 1]))
                start = start[start < len(data)]
                row = np.searchsorted(borders, start, "right") - 1
                first = np.searchsorted(words.start, start)
                last = np.append(first[1:], len(words.start))
                number = np.arange(len(start)) - np.searchsorted(row, row)
                held = last > first
                row, first, last, number = row[held], first[held], last[held], number[held]
                if not len(row):
                    continue
                left, right = words.start[first], words.end[last - 1]  # white space at either end does not count
                n = last - first
                link, line = span_hash(data, left, right), span_hash(data ^ np.uint8(0xA5), left, right)
                x = np.flatnonzero(row[1:] == row[:-1])
                of, key_ = np.concatenate([row, row[x]]), np.concatenate([link, mix(link[x] * _TWO + link[x + 1])])
                heavy = np.concatenate([n >= long, np.ones(len(x), bool)])
                order = np.lexsort((key_, of))
                of, key_, heavy = of[order], key_[order], heavy[order]
                fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (key_[1:] != key_[:-1])])
                of, key_, heavy = of[fresh], key_[fresh], heavy[fresh]
                some = np.unique(row)

                def lists(values, of, kind, some=some):
                    return pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(of, some), len(of)).astype(np.int32)), pa.array(values, kind))

                own = [part.column(c).take(pa.array(some)) for c in (0, 1)]
                cols = [lists(line.view(np.int64), row, pa.int64()), lists(n, row, pa.int32()), lists(number, row, pa.int32()), lists(key_.view(np.int64), of, pa.int64()), lists(heavy, of, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*own, *cols], names=["k", "t", "lines", "words", "numbers", "keys", "heavy"])

    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x")).filter("x is not null")
    return rows.mapInArrow(tidy(run), f"k {kind}, t long, lines array<long>, words array<int>, numbers array<int>, keys array<long>, heavy array<boolean>")


def rising(values: list[int]) -> list[int]:
    """The places of a longest strictly rising run of ``values`` (the patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        j = bisect_left(tops, v)
        back[i] = at[j - 1] if j else -1
        if j == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[j], at[j] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def longest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common run of lines (gaps allowed) where no line is single on both sides."""
    in_a, in_b = {}, {}
    for held, lines in ((in_a, a), (in_b, b)):
        for i, x in enumerate(lines):
            held.setdefault(x, []).append(i)
    both = [x for x in in_a if x in in_b]
    if sum(len(in_a[x]) * len(in_b[x]) for x in both) > MAX_MATCHES:
        return _longest_by_bits(a, b, in_a, in_b)
    pairs = [(i, j) for x in both for i in in_a[x] for j in in_b[x]]
    pairs.sort(key=lambda p: (p[0], -p[1]))  # falling, so that a line is taken once
    return [pairs[i] for i in rising([j for _, j in pairs])]


def _longest_by_bits(a: list[int], b: list[int], in_a: dict[int, list[int]], in_b: dict[int, list[int]]) -> list[tuple[int, int]]:
    """The run that the piles of all pairs give, in n m / 64 steps and without a list of pairs.

    After each line of ``a``, a row of bits holds the tops of the piles: the places of ``b`` where the longest run with
    the lines so far grows. One row in ``step`` is kept; on the way back those between are worked out again.
    """
    own = [i for i, x in enumerate(a) if x in in_b]
    every = (1 << len(b)) - 1

    @lru_cache(64)
    def equal(x: int) -> int:
        bits = np.zeros(len(b), np.uint8)
        bits[in_b[x]] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def after(tops: int, i: int) -> int:
        free, match = every ^ tops, equal(a[i])
        return every ^ (((free + (free & match)) | (free & ~match)) & every)

    step = isqrt(len(own)) + 1
    kept, tops = [], 0
    for k, i in enumerate(own):
        if k % step == 0:
            kept.append(tops)
        tops = after(tops, i)
    out: list[tuple[int, int]] = []
    k, block, rows = len(own), -1, []
    while tops:
        j = tops.bit_length() - 1
        held = in_a[b[j]]
        i = held[bisect_left(held, own[k] if k < len(own) else len(a)) - 1]  # the last before the line of the next pair
        out.append((i, j))
        k = bisect_left(own, i)
        if k // step != block:
            block, rows = k // step, [kept[k // step]]
            for x in own[block * step : k]:
                rows.append(after(rows[-1], x))
        tops = rows[k % step] & ((1 << j) - 1)
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment of two lists of lines: pairs of places with equal lines, rising on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        n, m = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {x: y for y, x in enumerate(b[j:j_end], j) if m[x] == 1 and n.get(x) == 1}
        anchors = [(y, place[x]) for y, x in enumerate(a[i:i_end], i) if x in place]
        if not anchors:
            out += [(i + x, j + y) for x, y in longest(a[i:i_end], b[j:j_end])]
            continue
        kept = [anchors[x] for x in rising([y for _, y in anchors])]
        out += kept
        low = (i - 1, j - 1)
        for high in [*kept, (i_end, j_end)]:
            todo.append((low[0] + 1, high[0], low[1] + 1, high[1]))
            low = high
    return sorted(out)


def runs(places: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for p in places:
        if out and p == out[-1][-1] + 1:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def common_blocks(later: np.ndarray, earlier: np.ndarray, words: np.ndarray, min_words: int) -> tuple[list[int], list[int]]:
    """Places of the later document that align with the earlier one, and those of them in blocks of ``min_words`` words."""
    a, b = np.flatnonzero(np.isin(later, earlier)), np.flatnonzero(np.isin(earlier, later))
    used = a[[i for i, _ in align(later[a].tolist(), earlier[b].tolist())]].tolist() if len(a) else []
    return used, [p for run in runs(used) if words[run].sum() >= min_words for p in run]


def deletions(pairs: list[dict], numbers: list[int]) -> tuple[list[int], list]:
    """Line numbers to delete, and the keys of the earlier documents that hold them. ``pairs``: one document's blocks."""
    sure = {p for x in pairs for p in x["sure"]}
    used = sorted({p for x in pairs for p in x["used"]})
    gone = {p for run in runs(used) if not sure.isdisjoint(run) for p in run}
    owners = {x["ok"] for x in pairs if not gone.isdisjoint(x["used"])}
    return [numbers[p] for p in sorted(gone)], sorted(owners, key=lambda x: (x is None, x))


def _who(k: str, t: str) -> Column:
    return F.struct(F.col(k).isNull().alias("late"), F.col(k).alias("k"), F.col(t).alias("t"))


def _chained(shared: DataFrame) -> DataFrame:
    """(a, b): each holder ``who`` of a key, with the key's ``first`` holder and with the one before it.

    Holders are sorted by ranges of (key, who); only one holder of each range reaches over to the next, so a key of any
    number of holders is no single task.
    """
    rows = stored(shared.repartitionByRange("key", "who").withColumn("range", F.spark_partition_id()), "holders")
    earlier = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = rows.groupBy("key", "range").agg(F.max("who").alias("last")).select("key", "range", F.max("last").over(earlier).alias("carried"))
    inside = F.lag("who").over(W.partitionBy("key", "range").orderBy("who"))
    both = rows.withColumn("inside", inside).join(ends, ["key", "range"])
    near = both.select(F.col("who").alias("a"), F.coalesce("inside", "carried").alias("b")).filter("b is not null")
    return near.union(rows.select(F.col("who").alias("a"), F.col("first").alias("b")))


def links(table: DataFrame, rare: int) -> DataFrame:
    """Distinct pairs of documents to align: (k, t) the later one, (ok, ot) the earlier one; by key, null last, then text."""
    keys = table.select("k", "t", F.explode(F.arrays_zip("keys", "heavy")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.heavy").alias("heavy"), _who("k", "t").alias("who"))
    found = keys.groupBy("key").agg(F.min("who").alias("first"), F.count(F.lit(1)).alias("n"), F.max("heavy").alias("heavy"))
    found = found.filter((F.col("n") > 1) & ((F.col("n") <= rare) | F.col("heavy"))).select("key", "first", (F.col("n") <= rare).alias("few"))
    shared = stored(keys.select("key", "who").join(sent(found, "keys", BROADCAST_ROWS), "key"), "shared")
    many = _chained(shared.filter(~F.col("few")).select("key", "who", "first"))
    holders = shared.filter("few").groupBy("key").agg(F.array_sort(F.collect_set("who")).alias("w"))  # `rare` of them at most
    each = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice("w", F.lit(1), i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = holders.select(F.explode(each).alias("x")).select("x.a", "x.b")
    return many.union(few).filter("a <> b").distinct().select(F.col("a.k").alias("k"), F.col("a.t").alias("t"), F.col("b.k").alias("ok"), F.col("b.t").alias("ot"))


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, rare: int = RARE, long: int = LONG) -> DataFrame:
    """``k``, ``t`` (key and text hash), ``deleted`` (line numbers from 0), ``owners`` (keys of the earlier documents).

    Only documents with something to delete have a row. A document is its key and its text; documents go by key, null
    last, then by the text's hash.
    """
    kind = docs.schema[key].dataType.simpleString()
    table = stored(line_table(docs, key, text, long), "lines")
    pairs = stored(links(table, rare), "pairs")
    involved = pairs.select("k", "t").union(pairs.select("ok", "ot")).distinct().select(F.col("k").alias("k2"), F.col("t").alias("t2"))
    same = lambda k, t, k2, t2: F.col(k).eqNullSafe(F.col(k2)) & (F.col(t) == F.col(t2))
    own = table.select("k", "t", "lines", "words", "numbers").join(sent(involved, "involved", BROADCAST_ROWS), same("k", "t", "k2", "t2"), "left_semi")
    own = stored(own.dropDuplicates(["k", "t"]), "involved")
    earlier = own.select(F.col("k").alias("k2"), F.col("t").alias("t2"), F.col("lines").alias("others"))
    later = own.select(F.col("k").alias("k3"), F.col("t").alias("t3"), "lines", "words", "numbers")
    both = pairs.join(earlier.hint("merge"), same("ok", "ot", "k2", "t2")).select("k", "t", "ok", "others")
    both = both.join(later.hint("merge"), same("k", "t", "k3", "t3")).select("k", "t", "ok", "lines", "others", "words", "numbers")

    def aligned(batches):
        for b in batches:
            found = []
            for x, y, w in zip(b.column("lines"), b.column("others"), b.column("words"), strict=True):
                found.append(common_blocks(*(v.values.to_numpy(zero_copy_only=False) for v in (x, y, w)), min_words))
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            out = pa.RecordBatch.from_arrays([b.column("k"), b.column("t"), b.column("ok"), b.column("numbers"), *lists], names=["k", "t", "ok", "numbers", "used", "sure"])
            yield out.filter(pa.array([len(f[0]) > 0 for f in found], pa.bool_()))

    blocks = both.mapInArrow(tidy(aligned), f"k {kind}, t long, ok {kind}, numbers array<int>, used array<int>, sure array<int>")
    one = blocks.groupBy("k", "t").agg(F.collect_list(F.struct("ok", "used", "sure")).alias("pairs"), F.first("numbers").alias("numbers"))

    def cut(batches):
        for b in batches:
            found = [deletions(p, n) for p, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([d for d, _ in found], pa.list_(pa.int32())), pa.array([o for _, o in found], pa.list_(b.schema.field("k").type))], names=["k", "t", "deleted", "owners"])
            yield out.filter(pa.array([len(d) > 0 for d, _ in found], pa.bool_()))

    return one.mapInArrow(tidy(cut), f"k {kind}, t long, deleted array<int>, owners array<{kind}>")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, rare: int = RARE, long: int = LONG, into: str = "repeats") -> DataFrame:
    """``docs`` with the lines cut from ``text`` that align with an earlier document, and the struct ``into``: ``deleted``,
    ``owners``.

    Two documents are aligned if they share a line that ``rare`` rows hold at most. A line of ``long`` words, or any two
    lines in a row, link each holder to the first and to the one before, however many there are. Of an aligned pair the
    later one loses the aligned blocks of ``min_words`` words, and the aligned lines that adjoin them. A text that is
    repeated whole becomes empty. Null and empty texts stay as they are; lines without a word are never deleted and do
    not part a block. Rows with equal key and text are one document, so all of them are treated alike (each counts as a
    holder). An empty table gives an empty result. Other columns stay; one that is named ``into`` is replaced.
    """
    found = stored(find_repeats(docs, key, text, min_words, rare, long), "repeats").select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.struct("deleted", "owners").alias("__found"))
    items = found.agg(F.coalesce(F.sum(16 + F.size("__found.deleted") + F.size("__found.owners")), F.lit(0))).first()[0]
    found = F.broadcast(found) if items <= BROADCAST_ITEMS else found.hint("merge")
    rows = docs.drop(into).withColumn("__h", F.xxhash64(F.col(text)))
    out = rows.join(found, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__h") == F.col("__t")), "left")
    keep = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("__found.deleted"), i))
    cut = F.when(F.col("__found").isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))
    return out.withColumn(text, cut).withColumn(into, F.col("__found")).drop("__k", "__t", "__h", "__found")
