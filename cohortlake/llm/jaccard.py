"""N-gram Jaccard self-join: a MinHash LSH forest, then exact verification.

A text is the set of its five-word shingles; texts of equal sets are one class of copies and go on as one. Each tree of
the forest labels a set with ``LONGEST`` digests of MinHash values, most significant first, so that sorted labels are a
prefix trie. Sets below one trie node at a level are compared pair by pair, by counting common shingles. The forest is
first read at its longest prefixes, where few sets meet by chance. The links found there, each weighted by one over its
chance to be found, tell how similar linked sets are in these data, and so which share of all links any shorter prefix
finds: prefixes are shortened as far as the target recall needs, and what is then found is weighed again.

Nodes with the same sets are one piece of work, and a pair that meets in several pieces counts in the first alone, so
no pair is ever a row: a piece gives the number of links of each set and a forest of links that joins what is linked.
Large pieces are split into blocks, and each pair of blocks is a piece of its own.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import bucket_of, sent, stored, tidy
from cohortlake.llm.components import components
from cohortlake.llm.words import LETTERS, LOWER, Words, chunks, find_words, grams, mix

WORDS, THRESHOLD = 5, 0.8
TREES, LONGEST, RECALL = 16, 8, 0.9995
#: Shingles in a block of one piece, and half of those that one task works on, in the mean.
BLOCK = 500_000
#: Rows (about 60 bytes each) that may be sent to every task.
BROADCAST_ROWS = 500_000
#: Bytes of a block's bit table; beyond them common shingles are counted from posting lists.
BITS_BYTES = 32 << 20


def meets(similarity: np.ndarray | float, length: int, trees: int):
    """The chance that two sets share a node at this level in some tree."""
    return 1 - (1 - np.asarray(similarity) ** length) ** trees


def next_length(similarity: np.ndarray, found: np.ndarray, length: int, threshold: float, trees: int, recall: float) -> int:
    """The longest prefix, of ``length`` at most, that is expected to find the share ``recall`` of all links.

    ``found``: links of each ``similarity`` found at ``length``. One link at the threshold counts besides them, so that
    few or no links found mean caution.
    """
    weight = np.append(found / meets(similarity, length, trees), 1.0)
    similarity = np.append(similarity, threshold)
    k = length
    while k > 1 and (weight * meets(similarity, k, trees)).sum() < recall * weight.sum():
        k -= 1
    return k


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within each text, and the border of each text among them.

    A text of fewer than ``k`` words, but not none, has one shingle of all its words.
    """
    h, at = grams(words, k)
    text = words.text[at]
    first = words.first_word()
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    if len(few):
        own = np.zeros(len(few), dtype=np.uint64)
        for j in range(k - 1):
            there = first[few] + j < first[few + 1]
            own[there] = own[there] * np.uint64(0xD1342543DE82EF95) + words.hash[first[few][there] + j]
        h, text = np.concatenate([h, mix(own)]), np.concatenate([text, few])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if len(h):
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
        h, text = h[fresh], text[fresh]
    return h, np.searchsorted(text, np.arange(words.n_texts + 1))


def _reduce(f, values: np.ndarray, border: np.ndarray, none: int) -> np.ndarray:
    out = np.full(len(border) - 1, none, dtype=values.dtype)
    some = border[1:] > border[:-1]
    if some.any():
        out[some] = f.reduceat(values, border[:-1][some])
    return out


def signatures(docs: DataFrame, key: str, text: str, k: int, trees: int) -> DataFrame:
    """Per row: k, t, n (distinct shingles), s (a 64-bit id of the set) and its labels: in each tree 128 bits, of which
    ``hi`` holds the first four digests and ``lo`` the other four."""
    kind = docs.schema[key].dataType.simpleString()
    odd = mix(np.arange(1, trees * LONGEST + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                h, border = shingles(find_words(part.column(2), LETTERS, LOWER), k)
                n = np.diff(border)
                s = mix(_reduce(np.add, mix(h ^ np.uint64(0x5851F42D4C957F2D)), border, 0) + n.astype(np.uint64))
                label = np.zeros((2, len(n), trees), dtype=np.uint64)
                for t in range(trees):
                    for j in range(LONGEST):
                        digest = mix(_reduce(np.minimum, h * odd[t * LONGEST + j], border, 0)) & np.uint64(0xFFFF)
                        label[j // 4, :, t] = label[j // 4, :, t] << np.uint64(16) | digest
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * trees), pa.array(x.ravel().view(np.int64))) for x in label]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(s.view(np.int64)), *lists], names=["k", "t", "n", "s", "hi", "lo"])

    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))
    return rows.mapInArrow(tidy(run), f"k {kind}, t long, n long, s long, hi array<long>, lo array<long>")


def nodes(sets: DataFrame, length: int) -> DataFrame:
    """``s``, ``n`` and ``node``: the trie node of each tree that holds the set at this level."""
    each = sets.select("s", "n", F.posexplode(F.arrays_zip("hi", "lo")).alias("tree", "x"))
    hi = F.shiftright("x.hi", max(0, 64 - 16 * length))
    lo = F.shiftright("x.lo", 128 - 16 * length) if length > 4 else F.lit(0).cast("long")
    return each.select("s", "n", F.xxhash64("tree", hi, lo).alias("node"))


def links(
    sizes: np.ndarray, h: np.ndarray, border: np.ndarray, side: np.ndarray, threshold: Fraction, before: np.ndarray | None = None
) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Number of links of each set, a forest of links (pairs of rows) that joins what the links join, and the number of
    links of each similarity in hundredths.

    ``side``: all 0, each pair counts; otherwise pairs of a row of side 0 with one of side 1 count. ``before``: for each
    row the earlier pieces that hold it (padded with rows' own negative numbers); pairs with a common one do not count.
    """
    n = len(sizes)
    cross = bool(side.any())
    rank = np.argsort(sizes, kind="stable")
    size, side = sizes[rank], side[rank]
    _, code, count = np.unique(h, return_inverse=True, return_counts=True)
    row = np.empty(n, np.int64)
    row[rank] = np.arange(n)
    row = np.repeat(row, np.diff(border))
    shared = count[code] > 1
    row, code = row[shared], code[shared]
    renumber = np.cumsum(np.bincount(code, minlength=1) > 0) - 1
    code = renumber[code] if len(code) else code
    width = (int(code.max()) >> 6) + 1 if len(code) else 1
    dense = n * width * 8 <= BITS_BYTES
    if dense:
        bits = np.zeros(n * width, dtype=np.uint64)
        at = row * width + (code >> 6)
        order = np.argsort(at, kind="stable")
        at, bit = at[order], (np.uint64(1) << (code[order] & 63).astype(np.uint64))
        if len(at):
            begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            bits[at[begin]] = np.bitwise_or.reduceat(bit, begin)
        bits = bits.reshape(n, width)
    else:
        order = np.argsort(code, kind="stable")
        posting, post_at = row[order], np.searchsorted(code[order], np.arange(int(code.max()) + 2))
        order = np.argsort(row, kind="stable")
        own, own_at = code[order], np.searchsorted(row[order], np.arange(n + 1))
    p, q = threshold.numerator, threshold.denominator
    reach = np.searchsorted(size * p, size * q, "right")  # larger sets than that cannot be similar enough
    found = np.zeros(n, dtype=np.int64)
    label = np.arange(n)
    forest: list[tuple[int, int]] = []
    similar_by = np.zeros(101, dtype=np.int64)
    before = None if before is None else before[rank]
    step = max(1, (8 << 20) // (8 * width))
    for i in range(n - 1):
        hits = []
        if dense:
            for a in range(i + 1, int(reach[i]), step):
                b = min(a + step, int(reach[i]))
                common = np.bitwise_count(bits[a:b] & bits[i]).sum(axis=1, dtype=np.int64)
                good = np.flatnonzero(common * (p + q) >= p * (size[i] + size[a:b]))
                hits.append((a + good, common[good]))
        else:
            mine = own[own_at[i] : own_at[i + 1]]
            if len(mine):
                met = np.concatenate([posting[post_at[c] : post_at[c + 1]] for c in mine.tolist()])
                at, common = np.unique(met[met > i], return_counts=True)
                good = common * (p + q) >= p * (size[i] + size[at])
                hits.append((at[good], common[good]))
        if not hits:
            continue
        j, common = (np.concatenate(x) for x in zip(*hits, strict=True))
        fresh = side[j] != side[i] if cross else np.ones(len(j), bool)
        if before is not None and before.shape[1]:
            fresh &= ~(before[j][:, :, None] == before[i][None, None, :]).any(axis=(1, 2))
        j, common = j[fresh], common[fresh]
        if not len(j):
            continue
        similar_by += np.bincount(100 * common // (size[i] + size[j] - common), minlength=101)
        found[i] += len(j)
        found[j] += 1
        away = j[label[j] != label[i]]
        while len(away):
            forest.append((int(rank[i]), int(rank[away[0]])))
            label[label == label[away[0]]] = label[i]
            away = away[label[away] != label[i]]
    out = np.zeros(n, dtype=np.int64)
    out[rank] = found
    return out, forest, similar_by


#: kind 0: a set and its number of links; 1: two linked sets; 2: a similarity in hundredths and its number of links.
_FOUND = "kind int, s long, other long, n long"


def _verify(threshold: Fraction):
    def run(table):
        table = table.combine_chunks().sort_by([("work", "ascending"), ("s", "ascending")])
        work, piece, s, n, side = (table.column(c).to_numpy() for c in ("work", "piece", "s", "n", "side"))
        data = table.column("shingles").combine_chunks()
        h, border = np.frombuffer(b"".join(x.as_py() for x in data), dtype=np.uint64), np.concatenate([[0], np.cumsum(n)])
        held = table.column("pieces").combine_chunks()
        own_at, own = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False)
        out: list[list] = [[], [], [], []]

        def add(kind, *cols):
            for x, v in zip(out, (np.full(len(cols[0]), kind, np.int32), *cols), strict=True):
                x.append(v)

        begin = np.flatnonzero(np.concatenate([[True], work[1:] != work[:-1]])) if len(work) else []
        for a, b in zip(begin, [*begin[1:], len(work)], strict=True):
            at = border[a : b + 1]
            width = int(np.diff(own_at[a : b + 1]).max())
            before = np.repeat(-1 - np.arange(b - a, dtype=np.int64)[:, None], width, axis=1)  # no piece is below 0
            for i in range(b - a):
                mine = own[own_at[a + i] : own_at[a + i + 1]]
                mine = mine[mine < piece[a]]
                before[i, : len(mine)] = mine
            count, forest, similar_by = links(n[a:b], h[at[0] : at[-1]], at - at[0], side[a:b], threshold, before)
            some = np.flatnonzero(count)
            add(0, s[a:b][some], s[a:b][some], count[some])
            pair = s[a:b][np.array(forest, dtype=np.int64).reshape(-1, 2)]
            add(1, pair[:, 0], pair[:, 1], np.ones(len(pair), np.int64))
            some = np.flatnonzero(similar_by)
            add(2, some, some, similar_by[some])
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({name: pa.array(np.concatenate(x) if x else [], kind) for name, x, kind in zip(("kind", "s", "other", "n"), out, kinds, strict=True)})

    return run


def _work(texts: DataFrame, k: int) -> DataFrame:
    """One row per set and piece of work. A piece of b blocks has work for each block and each pair of blocks."""

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                h, border = shingles(find_words(part.column(2), LETTERS, LOWER), k)
                data = pa.array([h[x:y].tobytes() for x, y in zip(border[:-1], border[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(border).astype(np.int64)), data], names=["s", "held", "n", "shingles"])

    rows = texts.select("s", "held", "x").mapInArrow(tidy(run), "s long, held array<struct<piece: long, blocks: int>>, n long, shingles binary").dropDuplicates(["s"])
    rows = rows.select("s", "n", "shingles", F.col("held.piece").alias("pieces"), F.explode("held").alias("p"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("s"), F.col("p.blocks")).cast("int"))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return other.select(F.xxhash64("p.piece", low, high).alias("work"), F.col("p.piece").alias("piece"), "pieces", "s", "n", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "shingles")


def found_at(docs: DataFrame, sets: DataFrame, length: int, key: str, text: str, k: int, threshold: float, block: int) -> DataFrame:
    """What is found (``_FOUND``) among the sets that share a node at this level, all of it exact."""
    below = nodes(sets.filter("n > 0"), length)
    groups = below.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("s")).alias("x")).filter("c > 1")
    piece = F.xxhash64("x", "c", "w").bitwiseAND((1 << 62) - 1)  # nodes of the same sets have the same
    groups = groups.select("node", F.struct(piece.alias("piece"), F.ceil(F.col("w") / block).cast("int").alias("blocks")).alias("p"))
    held = below.join(sent(groups, "nodes", BROADCAST_ROWS), "node").groupBy("s").agg(F.collect_set("p").alias("held"))  # one a tree at most
    near = stored(sets.select("s", "k", "t", "n").join(held, "s"), "near")
    total, some = near.agg(F.sum(F.col("n") * F.aggregate("held", F.lit(0), lambda a, p: a + p["blocks"])), F.count(F.lit(1))).first()
    tasks = int((total or 0) // (2 * block)) + 1
    who = near.select("s", F.col("k").alias("k2"), F.col("t").alias("t2"), "held")
    who = F.broadcast(who) if some <= BROADCAST_ROWS // 4 else who  # these rows are wider
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))
    texts = texts.join(who, F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")))
    return stored(_work(texts, k).groupBy(bucket_of(tasks, "work").alias("task")).applyInArrow(_verify(Fraction(threshold).limit_denominator(1000)), _FOUND), "links")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = WORDS, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: k (key), t (text hash), copy_of, class_id, n_links.

    copy_of: the smallest key with the same set of shingles. class_id: the smallest key of all sets that links join,
    directly or not. n_links: how many other sets are similar by at least ``threshold``. Case and what stands between
    words do not count. Texts without a word, null included, have the empty set: one class, no links. A null key comes
    after all others; repeated rows are copies of each other; an empty table gives an empty result; other columns are
    ignored. ``recall``: the share of all links that the prefixes in use find in the mean, as weighed by those found.
    All links found are exact.
    """
    rows = stored(signatures(docs, key, text, k, trees), "signatures")
    sets = rows.groupBy("s").agg(F.min(F.struct(F.col("k").isNull().alias("late"), "k", "t")).alias("first"), F.min("n").alias("n"), F.min("hi").alias("hi"), F.min("lo").alias("lo"))
    sets = stored(sets.select("s", F.col("first.k").alias("k"), F.col("first.t").alias("t"), "n", "hi", "lo"), "sets")
    length = LONGEST
    while True:
        found = found_at(docs, sets, length, key, text, k, threshold, block)
        by = {r["s"]: r["n"] for r in found.filter("kind = 2").groupBy("s").agg(F.sum("n").alias("n")).collect()}  # 101 at most
        at = np.array(sorted(by), dtype=float)
        shorter = next_length(np.maximum(at / 100, threshold), np.array([by[x] for x in at]), length, threshold, trees, recall)
        if shorter == length:
            break
        length = shorter
    joined = components(found.filter("kind = 1").select(F.col("s").alias("u"), F.col("other").alias("v")))
    counts = found.filter("kind = 0").groupBy("s").agg(F.sum("n").alias("n_links"))
    named = sets.select("s", "k").join(joined.select(F.col("id").alias("s"), "component"), "s", "left").join(counts, "s", "left")
    named = stored(named.select("s", F.col("k").alias("copy_of"), F.coalesce("component", "s").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    ids = named.groupBy("c").agg(F.min("copy_of").alias("class_id"))
    named = named.join(ids, "c").select("s", "copy_of", "class_id", "n_links")
    return rows.select("k", "t", "s").join(named, "s").select("k", "t", "copy_of", "class_id", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest key; of rows with the same key and text, one."""
    found = stored(similar(docs, key, text, **options).select("k", "t", "class_id"), "classes")
    best = found.filter(F.col("k").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("t").alias("best"))
    best = best.select(F.col("class_id").alias("c"), "best")
    names = found.groupBy("k", "t", "class_id").agg(F.count(F.lit(1)).alias("n")).join(best, F.col("class_id").eqNullSafe(F.col("c")))
    stays = F.col("k").eqNullSafe(F.col("class_id")) & (F.col("t") == F.col("best"))
    marked = stored(names.select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.when(~stays, 0).when(F.col("n") > 1, 1).otherwise(2).alias("__m")).filter("__m < 2"), "marked")
    marked = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked.hint("merge")
    rows = docs.withColumn("__h", F.xxhash64(F.col(text)))
    rows = rows.join(marked, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__h") == F.col("__t")), "left").filter("__m is null or __m = 1")
    alone, again = rows.filter("__m is null"), rows.filter("__m = 1").dropDuplicates(["__k", "__t"])
    return alone.unionByName(again).drop("__h", "__k", "__t", "__m")
