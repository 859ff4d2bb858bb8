"""Best-two-fit packing of tokenised documents into sequences of a fixed number of tokens.

A bin is filled greedily, the longest piece that fits first; then its shortest piece gives way to two unpacked pieces
that fit the gap left by it more tightly. What that does depends on lengths alone, and there are at most ``capacity``
of those, so it runs on the table of counts by length, one pattern for many equal bins at once; the pieces are then
ranked within their length by Spark and take the places of their length in turn.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import ranked, stored, tidy

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level BPE of a tokenizers file, with its merges as ranks: the ids are the same, the speed fourfold."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, added = whole["model"]["vocab"], {t["content"]: t["id"] for t in whole.get("added_tokens") or []}
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token) and not token.startswith("<|")}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: one if they fit, else full ones after a shorter first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenised(df: DataFrame, key: str, text: str, capacity: int, end_id: int, vocabulary: str, with_ids: bool, special: bool) -> DataFrame:
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        import tiktoken  # noqa: F401

        enc = encoding(vocabulary)
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            kept = []
            for i, t in enumerate(b.column(1)):
                ids = enc.encode_to_numpy(t.as_py() or "", allowed_special="all" if special else set(), disallowed_special=()).astype("<u4")
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, (at, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[at : at + n]
                    rows.append((i, piece, at, n, zlib.crc32(part.tobytes())))
                    if with_ids:
                        kept.append(part)
            i, piece, at, n, crc = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
            cols = {"key": b.column(0).take(pa.array(i)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(at), "length": pa.array(n), "ids_crc32": pa.array(crc)}
            if with_ids:
                cols["ids"] = pa.array([p.astype(np.int32) for p in kept], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {key_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to how many of it) and how many bins have each, for ``counts`` pieces of each length.

    Each pattern uses up some length (but for fewer than one bin needs), so there are few patterns however many
    pieces there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        lengths = sorted(left)
        need: dict[int, int] = {}
        gap, at = capacity, len(lengths)
        while gap and (at := bisect_right(lengths, gap, 0, at) - 1) >= 0:
            n = lengths[at]
            take = min(left[n], gap // n)
            need[n] = take
            gap -= take * n
        if gap:
            low = min(need)
            room, free = gap + low, {n: left[n] - need.get(n, 0) for n in lengths}
            open_ = np.array([n for n in lengths if free[n] > 0 and n < room], dtype=np.int64)
            best = (low, 0, 0)
            if len(open_):
                other = np.searchsorted(open_, room - open_, "right") - 1
                for a, j in zip(open_.tolist(), other.tolist(), strict=True):
                    if j >= 0 and open_[j] == a and free[a] < 2:
                        j -= 1
                    if j >= 0:
                        best = max(best, (a + int(open_[j]), a, int(open_[j])))
            if best[1]:
                need[low] -= 1
                for n in best[1:]:
                    need[n] = need.get(n, 0) + 1
                need = {n: k for n, k in need.items() if k}
        bins = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
        out.append((need, bins))
    return out


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first bin, how many a bin, first offset), by rising rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    bin_at = 0
    for need, bins in plan:
        offset = 0
        for n in sorted(need, reverse=True):
            k = need[n]
            rows.setdefault(n, []).append((used.get(n, 0), bin_at, k, offset))
            used[n] = used.get(n, 0) + k * bins
            offset += k * n
        bin_at += bins
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY, with_ids: bool = False, special: bool = False) -> DataFrame:
    """Per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``).

    A document is its ids and ``end_id``; a null text is empty, so it is the end alone. Only documents of more than
    ``capacity`` ids are cut, the first piece being the shorter. Strings of the vocabulary's added tokens in a text
    are ordinary text, or with ``special`` those tokens, as tokenizers encode them. Repeated rows are packed each; a null key is a key; an empty table gives an empty result; other columns are
    ignored, whatever their names. To the driver go at most ``capacity`` counts.
    """
    pieces = stored(tokenised(df, key, text, capacity, end_id, vocabulary, with_ids, special), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(best_two_fit(counts, capacity))

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own, t = np.flatnonzero(length == n), table[int(n)]
                row = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                within = rank[own] - row[:, 0]
                seq[own] = row[:, 1] + within // row[:, 2]
                off[own] = row[:, 3] + within % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    cols = ["key", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    order = ranked(pieces, "length", ["key", "piece", "ids_crc32"], "rank").select(*cols, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in order.schema.fields[:-1]) + ", sequence_id long, offset long"
    out = order.mapInArrow(tidy(run), schema)
    return out.withColumnRenamed("key", key)
