"""Substring dedup by fixed-block anchors.

Texts are cut into blocks of ``BLOCK`` = 18 words that do not overlap: the index. Every window of 35 words holds one whole
block of its text, so if its words stand anywhere else too, the run of 18 words there, at whatever place, is a rolling
window that meets the index. All rolling windows are probed; those that meet a block elsewhere are hits. A hit is
extended to both sides: all windows of 35 words around it are candidates, told apart by 128 bits and counted over the
corpus, and those that stand twice or more are repeats; where they join up they are a maximal repeat.

Hits and windows are rows that are counted by hash, never pairs of documents. What a text repeats within itself is found
where the text is and counts as one row elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import short_shuffles, stored, tidy
from cohortlake.llm.words import NON_SPACE, Words, chunks, find_words, mix

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
#: Bits of the table of the index's hashes (32 MB), whatever its size. It only keeps windows that meet no block from becoming
#: rows; a table that fills up lets more of them through, and the result is the same.
TABLE_BITS = 28
#: Blocks whose places a task holds before it hands them on.
HELD = 1 << 20

_BASE = np.uint64(0xD1342543DE82EF95)


def rolling(words: Words, k: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside one text, and the number of each run's first word."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, back = np.full(n, base, np.uint64), np.full(n, pow(int(base), -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hash * power, out=total[1:])
    whole = np.flatnonzero(words.text[: n - k + 1] == words.text[k - 1 :])
    return mix((total[whole + k] - total[whole]) * back[whole]), whole


def _texts(column: pa.Array):
    """Row range and words of each piece of the column."""
    for a, e in chunks(column):
        yield a, e, find_words(column.slice(a, e - a), NON_SPACE)


def block_table(texts: DataFrame) -> np.ndarray:
    """One bit for each value of the low bits of the blocks' hashes, as 64-bit words. Words are merged where they are found
    and again by Spark; the driver gets each once."""

    def rows(held: list[np.ndarray]):
        at = np.unique(np.concatenate(held))
        word = at >> np.uint64(6)
        cut = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), cut)
        yield pa.RecordBatch.from_arrays([pa.array(word[cut].view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for _, _, words in _texts(b.column(0)):
                h, at = rolling(words, BLOCK)
                own = h[(at - words.first_word()[words.text[at]]) % BLOCK == 0] & np.uint64((1 << TABLE_BITS) - 1)
                held.append(own)
                n += len(own)
                if n > HELD:
                    yield from rows(held)
                    held, n = [], 0
        if n:
            yield from rows(held)

    merged = texts.select("text").mapInArrow(tidy(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # a thousand words to a row: they reach the driver as arrays
    parts = merged.groupBy(F.shiftright("word", 10).alias("part")).agg(F.collect_list(F.struct("word", "bits")).alias("words")).select("words").toArrow()
    out = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    for part in parts.column("words").chunks:
        word, bits = part.flatten().flatten()
        out[word.to_numpy()] = bits.to_numpy().view(np.uint64)
    return out


def known(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the table has a bit for each hash."""
    at = h & np.uint64((1 << TABLE_BITS) - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _distinct(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (text, h), where each distinct pair begins in it, and how often each stands."""
    order = np.lexsort((h, text))
    new = np.append(True, (text[order][1:] != text[order][:-1]) | (h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(h)))


def probes(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """(h, t1, t2, n, own): the distinct rolling windows of each text that the table knows, how often they stand there
    (2 for more), and whether one of them is a block."""
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            for a, e, words in _texts(b.column(2)):
                h, at = rolling(words, BLOCK)
                near = np.flatnonzero(known(sent.value, h))
                h, at = h[near], at[near]
                text = words.text[at]
                own = (at - words.first_word()[text]) % BLOCK == 0
                order, first, n = _distinct(text, h)
                if len(first):
                    ids = [b.column(i).slice(a, e - a).take(pa.array(text[order[first]])) for i in (0, 1)]
                    own = np.logical_or.reduceat(own[order], first)
                    yield pa.RecordBatch.from_arrays([pa.array(h[order[first]].view(np.int64)), *ids, pa.array(np.minimum(n, 2).astype(np.int8)), pa.array(own)], names=["h", "t1", "t2", "n", "own"])

    return texts.mapInArrow(tidy(run), "h long, t1 long, t2 long, n byte, own boolean")


def _around(at: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Whether each of ``size`` places lies in one of the ranges at+low .. at+high."""
    steps = np.bincount(np.maximum(at + low, 0), minlength=size + 1) - np.bincount(np.minimum(at + high + 1, size), minlength=size + 1)
    return np.cumsum(steps[:-1]) > 0


def windows(near: DataFrame) -> DataFrame:
    """Texts (t1, t2, text, hits) to a row for each distinct window of 35 words around a hit: (w1, w2, t1, t2, start, n)."""

    def run(batches):
        for b in batches:
            lists = b.column(3)
            for a, e, words in _texts(b.column(2)):
                hits = lists.slice(a, e - a)
                h, at = rolling(words, BLOCK)
                text = words.text[at]
                # a text's number goes into the hash, so that one search serves all texts of the piece
                own = np.repeat(np.arange(e - a), np.asarray(hits.value_lengths()))
                wanted = np.sort(mix(hits.flatten().to_numpy().view(np.uint64) ^ mix(own.astype(np.uint64) + np.uint64(1))))
                tagged = mix(h ^ mix(text.astype(np.uint64) + np.uint64(1)))
                hit = at[wanted[np.minimum(np.searchsorted(wanted, tagged), len(wanted) - 1)] == tagged] if len(wanted) else at[:0]
                w, start = rolling(words, WINDOW)
                w2 = rolling(words, WINDOW, np.uint64(0x9E3779B97F4A7C15))[0]
                near_hit = _around(hit, BLOCK - WINDOW, 0, len(words.hash))[start]
                w, w2, start = w[near_hit], w2[near_hit], start[near_hit]
                text = words.text[start]
                order, first, n = _distinct(text, w)
                if len(first):
                    at = order[first]
                    ids = [b.column(i).slice(a, e - a).take(pa.array(text[at])) for i in (0, 1)]
                    cols = [pa.array(w[at].view(np.int64)), pa.array(w2[at].view(np.int64)), *ids, pa.array((start[at] - words.first_word()[text[at]]).astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int8))]
                    yield pa.RecordBatch.from_arrays(cols, names=["w1", "w2", "t1", "t2", "start", "n"])

    return near.select("t1", "t2", "text", "hits").mapInArrow(tidy(run), "w1 long, w2 long, t1 long, t2 long, start int, n byte")


def repeats(texts: DataFrame) -> DataFrame:
    """(t1, t2, starts): where windows begin, in each text (t1, t2, text), that stand in another text, or there twice."""
    with short_shuffles(texts.sparkSession):
        hits = stored(probes(texts, block_table(texts)), "probes")
        shared = stored(hits.groupBy("h").agg(F.sum("n").alias("n"), F.max("own").alias("own")).filter("n > 1 and own").select("h"), "shared")
        hits = stored(hits.join(shared.hint("merge"), "h").groupBy("t1", "t2").agg(F.collect_set("h").alias("hits")), "hits")
        found = stored(windows(texts.join(hits, ["t1", "t2"])), "windows")
        twice = stored(found.groupBy("w1", "w2").agg(F.sum("n").alias("n")).filter("n > 1").select("w1", "w2"), "twice")
        return stored(found.join(twice.hint("merge"), ["w1", "w2"]).groupBy("t1", "t2").agg(F.collect_set("start").alias("starts")), "repeats")


def _kept(words: Words, starts: pa.Array) -> np.ndarray:
    """Which words stay: those of no repeated window, here or elsewhere. ``starts``: a list or null for each text."""
    text = np.repeat(np.arange(len(starts)), pc.fill_null(starts.value_lengths(), 0).to_numpy())
    elsewhere = starts.flatten().to_numpy() + words.first_word()[text]
    w, start = rolling(words, WINDOW)
    order, _, n = _distinct(words.text[start], w)
    here = start[order[np.repeat(n > 1, n)]]
    return ~_around(np.concatenate([elsewhere, here]), 0, WINDOW - 1, len(words.hash))


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, end, text = words.start[keep], words.end[keep], words.text[keep]
    later = np.append(False, text[1:] == text[:-1]) if len(text) else np.zeros(0, bool)
    data = words.data.copy()
    data[start[later] - 1] = 32  # before a later word stands white space, of which one byte stays
    inside = np.bincount(start - later, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
    inside = np.cumsum(inside[:-1]) > 0
    borders = np.append(0, np.cumsum(inside))[words.borders]
    return pa.Array.from_buffers(pa.large_string(), words.n_texts, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(data[inside])])


def dedup_substrings(df: DataFrame, text: str = "text", into: str = "dedup") -> DataFrame:
    """``df`` with the struct ``into``: ``n_words``, ``n_removed`` and ``kept``, the words left, joined by one space.

    A word goes if any window of 35 words over it also begins anywhere else, in this text or another row's; windows are
    judged on the input. Equal texts repeat each other whole; texts of fewer words stay. Null texts have no words. Words
    are runs without ASCII white space, and are compared as they are. All columns stay, whatever their names; one named
    ``into`` is replaced. An empty table gives an empty result.
    """
    keys = [F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2")]
    rows = df.drop(into)
    found = repeats(rows.filter(F.col(text).isNotNull()).select(*keys, F.col(text).alias("text"))).select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("starts").alias("__starts"))
    both = rows.withColumns({"__h1": keys[0], "__h2": keys[1]}).join(found, (F.col("__h1") == F.col("__t1")) & (F.col("__h2") == F.col("__t2")), "left").drop("__h1", "__h2", "__t1", "__t2")
    names, at = rows.columns, rows.columns.index(text)

    def run(batches):
        for b in batches:
            made, lists = [], b.column(len(names))
            for a, e, words in _texts(b.column(at)):
                first = words.first_word()
                keep = _kept(words, lists.slice(a, e - a))
                gone = np.append(0, np.cumsum(~keep))[first]
                cols = [pa.array(np.diff(first)), pa.array(np.diff(gone)), _joined(words, keep).cast(pa.string())]
                made.append(pa.StructArray.from_arrays(cols, names=["n_words", "n_removed", "kept"]))
            if made:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.concat_arrays(made)], names=[*names, into])

    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StructType.fromDDL("n_words long, n_removed long, kept string"))])
    return both.mapInArrow(tidy(run), schema)
