"""Words of whole Arrow string columns as numpy arrays: places and 64-bit hashes, without a Python loop over words.

A column's texts lie end to end in one byte buffer. A table of 256 entries says which bytes belong to words; runs of
such bytes inside one text are its words. All of UTF-8's lead and continuation bytes are above 0x7F, so a class given
by ASCII characters acts alike on bytes and on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; bounds what a task holds (about 60 bytes for each). Arrays of this size
#: stay in a core's cache: 256 KB is faster than 2 MB, and its workers are 90 MB smaller.
CHUNK_BYTES = 256 << 10

_ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_class(pattern_excludes: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(pattern_excludes, dtype=np.uint8)] = False
    return table


#: Words between white space: [^\x20\x09-\x0D]+
NON_SPACE = byte_class(b" \t\n\v\f\r")
#: Words of letters and digits, all beyond ASCII included: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after A-Z are lowered
LETTERS = byte_class(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit of a 64-bit hash over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """``data``: the bytes (case folded); ``ends_at``: text borders; per word its first byte, end, text and hash."""

    data: np.ndarray
    borders: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.borders) - 1

    def first_word(self) -> np.ndarray:
        """For each text the number of its first word, and the total at the end."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a string column; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    borders = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[borders[0] : borders[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, borders - borders[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of the column, each of about ``limit`` bytes, or of one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, borders = buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one prefix polynomial, scaled to the same origin, then mixed."""
    n = len(data)
    power = np.full(n + 1, _ODD, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    back = np.full(n + 1, inverse, dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))


def find_words(column: pa.Array, table: np.ndarray, fold: np.ndarray = SAME) -> Words:
    raw, borders = buffers(column)
    data = fold[raw]
    inside = table[data]
    n = len(data)
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = borders[(borders > 0) & (borders < n)]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(borders, start, "right") - 1
    return Words(data, borders, start, end, text, span_hash(data, start, end))


#: Code points of scripts written without spaces, and how many characters a gram of each has: Thai and Lao, Myanmar,
#: Khmer, kana, Han (with its compatibility forms, and the planes 2 and 3).
UNSPACED = ((0xE00, 0xF00, 4), (0x1000, 0x10A0, 4), (0x1780, 0x1800, 4), (0x3040, 0x3100, 2), (0x31F0, 0x3200, 2), (0x3400, 0x4DC0, 2), (0x4E00, 0xA000, 2), (0xF900, 0xFB00, 2), (0x20000, 0x40000, 2))


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, bytes and gram length of each character of an unspaced script."""
    at = np.flatnonzero(data >= 0xE0)
    size = np.where(data[at] >= 0xF0, 4, 3)
    tail = lambda i: data[np.minimum(at + i, len(data) - 1)].astype(np.int64) & 63
    three = (data[at].astype(np.int64) & 15) << 12 | tail(1) << 6 | tail(2)
    code = np.where(size == 3, three, (data[at].astype(np.int64) & 7) << 18 | tail(1) << 12 | tail(2) << 6 | tail(3))
    k = np.zeros(len(at), np.int64)
    for low, high, n in UNSPACED:
        k[(code >= low) & (code < high)] = n
    return at[k > 0], size[k > 0], k[k > 0]


def split_unspaced(words: Words) -> Words:
    """Words with each character of an unspaced script as a word of its own, hashed with those after it as a gram.

    A gram ends early where such characters end; what stands between them in a word is a word. Other words stay.
    """
    at, size, k = unspaced(words.data)
    if not len(at):
        return words
    after = np.searchsorted(words.start, at + size, "right") - 1
    inner = (at + size)[at + size < words.end[after]]
    start = np.unique(np.concatenate([words.start, at, inner]))
    word = np.searchsorted(words.start, start, "right") - 1
    end = np.minimum(words.end[word], np.append(start[1:], len(words.data)))
    n = np.ones(len(start), np.int64)
    n[np.searchsorted(start, at)] = k
    gram = np.zeros(len(start), bool)
    gram[np.searchsorted(start, at)] = True
    stop = np.append(~gram[1:] | (word[1:] != word[:-1]), True)  # nothing joins on to the right
    last = np.flatnonzero(stop)[np.searchsorted(np.flatnonzero(stop), np.arange(len(start)))]
    end = np.where(gram, end[np.minimum(np.arange(len(start)) + n - 1, last)], end)
    return Words(words.data, words.borders, start, end, words.text[word], span_hash(words.data, start, end))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words inside one text, and the number of each run's first word."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD1342543DE82EF95) + words.hash[j : j + n]
    whole = words.text[:n] == words.text[k - 1 :]
    return mix(h[whole]), np.flatnonzero(whole)
