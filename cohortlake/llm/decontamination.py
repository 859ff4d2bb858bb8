"""Benchmark decontamination by winnowing.

Of each run of W k-grams the one of smallest hash is kept (the last of equals), on both sides. A span of W + k - 1
words that a document shares with an item holds such a run whole, so both keep the same k-gram in it: no shared span of
that length goes unseen. The two tables of fingerprints are joined, whatever their sizes; around each that is found on
both sides, all spans of that length are compared word for word with those of the items, by a second join. Items of
fewer words are one span each, with the hash of all their words as a fingerprint.

A bit table of fixed size, of the items' fingerprints, goes to all tasks first: it keeps most others of the documents
from becoming rows at all, and never one that is needed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import sent, stored, tidy
from cohortlake.llm.words import LETTERS, LOWER, Words, chunks, find_words, grams, mix

KEEP = 5  # words in a k-gram
#: Bits of the table of fingerprints (2 MB), whatever the benchmark's size.
TABLE_BITS = 24
#: Rows of fingerprints or spans (some 100 bytes each), and of documents with hits, that may be sent to every task.
BROADCAST_ROWS = 200_000
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def winnow(hashes: np.ndarray, at: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Which k-grams are kept. ``hashes`` at word numbers ``at`` of texts ``text``; texts of fewer grams keep none."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, arg = hashes[:n].copy(), np.arange(n)
    for j in range(1, window):
        h = hashes[j : j + n]
        less = h <= best
        best[less] = h[less]
        arg[less] = np.flatnonzero(less) + j
    whole = text[:n] == text[window - 1 :]
    keep = np.zeros(len(hashes), dtype=bool)
    keep[arg[whole]] = True
    return np.flatnonzero(keep)


def fingerprints(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-grams of all texts of ``window`` words and more: hash and number of the first word."""
    k = min(KEEP, window)
    h, at = grams(words, k)
    kept = winnow(h, at, words.text[at], window - k + 1)
    return h[kept], at[kept]


def whole_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, told apart from those of other lengths and from fingerprints."""
    h, at = grams(words, n)
    return mix(h + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)), at


def item_prints(items: DataFrame, window: int) -> DataFrame:
    """Distinct ``h`` and ``n``: fingerprints (n = window) and, of items of n < window words, the hash of them all."""

    def run(batches):
        for b in batches:
            for a, e in chunks(b.column(1)):
                words = find_words(b.column(1).slice(a, e - a), LETTERS, LOWER)
                first = words.first_word()
                count = np.diff(first)
                found = [(fingerprints(words, window)[0], window)]
                for n in np.unique(count[(count > 0) & (count < window)]).tolist():
                    h, at = whole_hashes(words, n)
                    found.append((h[np.isin(at, first[:-1][count == n])], n))
                h = np.concatenate([x for x, _ in found])
                n = np.repeat(np.array([n for _, n in found], np.int32), [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return items.mapInArrow(tidy(run), "h long, n int").distinct()


def bit_table(prints: DataFrame) -> np.ndarray:
    """One bit for each value of the hashes' low bits: at most 2^TABLE_BITS / 64 rows reach the driver."""
    place = F.col("h").bitwiseAND((1 << TABLE_BITS) - 1)
    bit = F.expr(f"shiftleft(1L, cast((h & {(1 << TABLE_BITS) - 1}) % 64 as int))")
    words = np.zeros((1 << TABLE_BITS) >> 6, dtype=np.uint64)
    for r in prints.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        words[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return words


def known(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places in ``h`` of hashes whose bit is set."""
    place = h & np.uint64((1 << TABLE_BITS) - 1)
    return np.flatnonzero(table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))


def candidates(texts: DataFrame, table: np.ndarray, lengths: list[int], window: int) -> DataFrame:
    """``texts`` (t1, t2, text) to a row for each fingerprint that the table knows: t1, t2, h, n, and the words around it
    that spans with it can reach (``words``, space-joined), of which the first is number ``start`` of its text."""

    def run(batches):
        for b in batches:
            for a, e in chunks(b.column(2)):
                part = b.slice(a, e - a)
                words = find_words(part.column(2), LETTERS, LOWER)
                first = words.first_word()
                h, at = fingerprints(words, window)
                rows = [_around(words, first, h, at, window, window - min(KEEP, window), table)]
                rows += [_around(words, first, *whole_hashes(words, n), n, 0, table) for n in lengths if n < window]
                t, h, n, start = (np.concatenate([r[i] for r in rows]) for i in range(4))
                text = [x for r in rows for x in r[4]]
                if len(t):
                    cols = [part.column(0).take(pa.array(t)), part.column(1).take(pa.array(t)), pa.array(h.view(np.int64)), pa.array(n), pa.array(start), pa.array(text, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["t1", "t2", "h", "n", "start", "words"])

    return texts.mapInArrow(tidy(run), "t1 long, t2 long, h long, n int, start long, words string")


def _around(words: Words, first: np.ndarray, h: np.ndarray, at: np.ndarray, n: int, reach: int, table: np.ndarray):
    near = known(table, h)
    h, at = h[near], at[near]
    text = words.text[at]
    low, high = np.maximum(first[text], at - reach), np.minimum(first[text + 1], at + n)
    held = [b" ".join(words.word(i) for i in range(x, y)).decode("utf-8", "replace") for x, y in zip(low.tolist(), high.tolist(), strict=True)]
    return text, h, np.full(len(h), n, np.int32), low - first[text], held


def _spans(words: Column, n: Column) -> Column:
    """Array of (place, span): all runs of n words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(i.alias("place"), F.array_join(F.slice(words, i + 1, n), " ").alias("span")))


def item_spans(items: DataFrame, window: int) -> DataFrame:
    """Distinct (span, item): the runs of ``window`` words of each item, or all its words where it has fewer."""
    low = F.translate("text", _UPPER, _UPPER.lower())
    rows = items.select("item", F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    rows = rows.select("item", F.explode(_spans(F.col("w"), F.least(F.size("w"), F.lit(window)))).alias("x"))
    return rows.select("item", F.col("x.span").alias("span")).distinct()


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, text: str, item_key: str, item_text: str, window: int) -> DataFrame:
    """``t1``, ``t2`` (hashes of a text), ``spans`` (merged) and ``items``, of each text that holds a span of an item."""
    items = benchmark.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    prints = stored(item_prints(items, window), "prints")
    lengths = [r["n"] for r in prints.select("n").distinct().collect()]  # `window` at most
    texts = docs.select(*text_hashes(text), F.col(text).alias("text")).filter("text is not null")
    near = candidates(texts, bit_table(prints), lengths, window).join(sent(prints, "prints", BROADCAST_ROWS), ["h", "n"], "left_semi")
    own = near.select("t1", "t2", "start", "n", F.explode(_spans(F.split("words", " "), F.col("n"))).alias("x"))
    own = own.select("t1", "t2", (F.col("start") + F.col("x.place")).alias("start"), "n", F.col("x.span").alias("span")).distinct()
    own = own.join(sent(item_spans(items, window), "spans", BROADCAST_ROWS), "span")
    found = own.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))

    def run(batches):
        for b in batches:
            merged = [[{"start": a, "end": z} for a, z in _merge([(x["start"], x["end"]) for x in own])] for own in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), b.column(3)], names=b.schema.names)

    return found.mapInArrow(tidy(run), "t1 long, t2 long, spans array<struct<start: long, end: long>>, items array<string>")


def text_hashes(text: str) -> list[Column]:
    """128 bits by which equal texts are known."""
    return [F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2")]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, into: str = "leaks") -> DataFrame:
    """``docs`` with the struct ``into``: ``n_words``, ``spans`` (of word numbers, merged), ``items`` (as strings, sorted).

    Null texts have no words, an item without words is never found, a null item key is left out. Repeated items and
    documents count as they stand; an empty benchmark finds nothing, an empty table gives an empty result. All columns
    of ``docs`` stay; one named ``into`` is replaced. Both sides are read once, whatever the benchmark's size, and what
    is found goes to the documents as rows for each text: in a broadcast while they are few, else by a shuffle.
    """
    found = sent(hits(docs, benchmark, text, item_key, item_text, window), "hits", BROADCAST_ROWS)
    found = found.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("spans").alias("__spans"), F.col("items").alias("__items"))
    rows = docs.drop(into)
    t1, t2 = text_hashes(text)
    out = rows.withColumns({"__h1": t1, "__h2": t2}).join(found, (F.col("__h1") == F.col("__t1")) & (F.col("__h2") == F.col("__t2")), "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    leaks = F.struct(F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"), none("__spans", "array<struct<start:bigint,end:bigint>>").alias("spans"), none("__items", "array<string>").alias("items"))
    return out.withColumn(into, leaks).drop("__h1", "__h2", "__t1", "__t2", "__spans", "__items")


def n_hit(into: str = "leaks"):
    return F.aggregate(F.col(f"{into}.spans"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def digest(items: list[str]) -> str:
    """What ``items_sha256`` is, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
