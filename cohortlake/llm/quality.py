"""Quality rules from tokeniser fertility: how public vocabularies fit a text.

Whole texts, spacing and line breaks included, are encoded by two vocabularies, a sentencepiece one with byte fallback
and a byte-level one for many languages. Each gives three measures: characters per token, the share of byte-fallback
tokens (of a byte-level vocabulary: tokens that hold parts of characters), and the entropy of the token distribution as
a share of the most that so many tokens can have. Each language (or script, where the language is not given) has a band
for each measure, between fences far outside the middle half of all its texts; a text outside a band is rejected. Short
texts vary more, by one law for all lengths: a text of n words has fences sqrt(1 + NOISE / n) as far out.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import add_struct, stored
from cohortlake.llm.words import NON_SPACE, Words, buffers, chunks, find_words, grams, mix, span_hash

#: Name to file: sentencepiece models end in .model, byte-level ranks in .tiktoken.
VOCABULARIES = {"piece": public_tokenizers.path("piece_bpe_32k.model"), "multi": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
#: How many times the middle half's width the fences lie beyond it, and the least width of the middle half.
FENCE = 3.0
LEAST = {"chars_per_token": 0.02, "byte_share": 0.005, "entropy": 0.005}
#: Words from which on a text's own variation outweighs that of its few words.
NOISE = 100.0
#: Words from which a text's measures count towards the bands, as for the base rule.
MIN_WORDS = 20
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids, and for each id whether it is a byte-fallback token (or unknown)."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        fallback = np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.get_piece_size())])
        return (lambda text: np.array(sp.encode(text), dtype=np.int64)), fallback
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    fallback = np.zeros(max(ranks.values()) + 1, dtype=bool)
    for token, i in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            fallback[i] = True
    return (lambda text: enc.encode_to_numpy(text, disallowed_special=()).astype(np.int64)), fallback


def fertility(text: str, encode, fallback: np.ndarray) -> tuple[int, float | None, float | None, float | None]:
    """Tokens, characters per token, share of byte-fallback tokens, and entropy as a share of the most there can be."""
    ids = encode(text)
    n = len(ids)
    if not n:
        return 0, None, None, None
    count = np.unique(ids, return_counts=True)[1]
    share = count / n
    entropy = float(-(share * np.log2(share)).sum() / np.log2(n)) if n > 1 else 1.0
    return n, len(text) / n, float(fallback[ids].mean()), entropy


def repeats(words: Words, k: int = 8) -> np.ndarray:
    """For each word whether it lies in a run of ``k`` words that its text holds twice or more."""
    h, at = grams(words, k)
    inside = np.zeros(len(words.hash) + 1, dtype=np.int64)
    own = mix(h + words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    s = own[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = at[order[twice]]
    inside[first] += 1
    np.add.at(inside, first + k, -1)
    return np.cumsum(inside[:-1]) > 0


def repeated_lines(words: Words, data: np.ndarray) -> np.ndarray:
    """For each text the number of lines with a word that equal an earlier line of it."""
    borders = words.borders
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([borders[:-1][np.diff(borders) > 0], breaks + 1]))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(words.n_texts, dtype=np.int64)
    text = np.searchsorted(borders, start, "right") - 1
    end = np.append(start[1:], len(data))
    end = np.minimum(end, borders[text + 1])
    end -= (end > start) & (data[np.maximum(end - 1, 0)] == 10)
    held = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    text, h = text[held], span_hash(data, start[held], end[held])
    key = mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[once] = False
    return np.bincount(text[again], minlength=words.n_texts)


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string"


def _names(vocabularies: dict[str, str]) -> list[str]:
    return [f"{v}_{m}" for v in vocabularies for m in LEAST]


#: Code point ranges of the scripts told apart where a language is missing.
SCRIPTS = {"latin": (0x0041, 0x024F), "greek": (0x0370, 0x03FF), "cyrillic": (0x0400, 0x052F), "hebrew": (0x0590, 0x05FF), "arabic": (0x0600, 0x06FF), "indic": (0x0900, 0x0DFF), "kana": (0x3040, 0x30FF), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF)}


def _script(words: Words, data: np.ndarray) -> list[str]:
    """The script of most letters of each text, by the lead byte and the one after it; "other" without letters."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b0 = data[lead].astype(np.int64)
    nxt = [data[np.minimum(lead + j, len(data) - 1)].astype(np.int64) & 0x3F for j in (1, 2)] if len(data) else [b0, b0]
    code = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | nxt[0], (b0 & 0x0F) << 12 | nxt[0] << 6 | nxt[1]))
    text = np.searchsorted(words.borders, lead, "right") - 1
    names = [*SCRIPTS, "other"]
    votes = np.zeros((len(names), words.n_texts), dtype=np.int64)
    for k, (low, high) in enumerate(SCRIPTS.values()):
        is_in = (code >= low) & (code <= high) & ~((code > 0x5A) & (code < 0x61))
        votes[k] = np.bincount(text[is_in], minlength=words.n_texts)
    best = np.where(votes.sum(axis=0) > 0, votes.argmax(axis=0), len(names) - 1)
    return [names[k] for k in best]


def measures(docs: DataFrame, text: str = "text", vocabularies: dict[str, str] | None = None, into: str = "quality") -> DataFrame:
    """``docs`` with the struct ``into`` of the base counts and each vocabulary's measures of each whole text.

    A null text has no words; without tokens the measures are null. Repeated rows are measured alike; an empty table
    gives an empty result. All other columns stay, and one that is named ``into`` is replaced. No shuffle.
    """
    vocabularies = VOCABULARIES if vocabularies is None else vocabularies
    schema = ", ".join([_BASE, *[f"{v}_tokens long" for v in vocabularies], *[f"{n} double" for n in _names(vocabularies)]])

    def run(column):
        cols: dict[str, list] = {x.split()[0]: [] for x in schema.split(", ")}
        for a, b in chunks(column):
            part = column.slice(a, b - a)
            words = find_words(part, NON_SPACE)
            data, borders = buffers(part)
            n = words.n_texts
            letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
            for name, v in {
                "n_words": np.bincount(words.text, minlength=n), "word_chars": np.bincount(words.text, letters[words.end] - letters[words.start], n), "n_symbols": symbols[borders[1:]] - symbols[borders[:-1]],
                "n_dup_lines": repeated_lines(words, data), "n_repeat_words": np.bincount(words.text[repeats(words)], minlength=n),
            }.items():
                cols[name] += v.astype(np.int64).tolist()
            cols["script"] += _script(words, data)
            texts = [t or "" for t in part.to_pylist()]
            for name, path in vocabularies.items():
                for t in texts:
                    for c, v in zip([f"{name}_tokens", *[f"{name}_{m}" for m in LEAST]], fertility(t, *encoder(path)), strict=True):
                        cols[c].append(v)
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        return pa.StructArray.from_arrays([pa.array(cols[x.split()[0]], kinds[x.split()[1]]) for x in schema.split(", ")], names=list(cols))

    return add_struct(docs, run, [text], schema, into)


def bands(measured: DataFrame, group: str, names: list[str], into: str = "quality", min_words: int = MIN_WORDS) -> DataFrame:
    """Per language or script: the quartiles of each measure (columns ``<measure>_low``, ``_high``), at least so far apart as ``LEAST`` says.

    All texts of at least ``min_words`` words count; quartiles are Spark's mergeable sketches, so a group of any size
    costs a fixed amount. A group whose texts all are shorter has no band and rejects nothing.
    """
    rows = measured.filter(F.col(f"{into}.n_words") >= min_words)
    quart = rows.groupBy(F.col(group).alias("__group")).agg(*[F.percentile_approx(f"{into}.{m}", F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias(m) for m in names])
    ends = []
    for m in names:
        short = F.greatest(F.lit(LEAST[m.split("_", 1)[1]]) - (F.col(m)[1] - F.col(m)[0]), F.lit(0.0)) / 2
        ends += [(F.col(m)[0] - short).alias(f"{m}_low"), (F.col(m)[1] + short).alias(f"{m}_high")]
    return quart.select("__group", *ends)


def judged(docs: DataFrame, text: str = "text", language: str | None = "lang", vocabularies: dict[str, str] | None = None, into: str = "quality", min_words: int = MIN_WORDS, fence: float = FENCE) -> DataFrame:
    """``docs`` without ``text``, with ``into`` (the measures), ``base_failed`` and ``kept``.

    base_failed: fewer than 20 words, or over 30 of 100 words in repeated runs. kept: not base_failed and inside all
    bands of its language, or of its script where the language is null. The bands are few (one for each language and
    script), and their number is checked before they go to all tasks. Null texts have no words and fail. Repeated rows
    are judged alike and each count towards the bands; an empty table gives an empty result. Other columns stay; those
    named ``into``, ``base_failed`` or ``kept`` are replaced.
    """
    names = _names(VOCABULARIES if vocabularies is None else vocabularies)
    measured = measures(docs.drop(into), text, vocabularies, into)
    script = F.concat(F.lit("script:"), F.col(f"{into}.script"))
    measured = stored(measured.withColumn("__band", F.coalesce(F.col(language), script) if language else script).drop(text), "quality")
    ends = stored(bands(measured, "__band", names, into, min_words), "bands")
    out = measured.join(F.broadcast(ends) if ends.count() <= 10_000 else ends, F.col("__band") == F.col("__group"), "left")
    n, again = F.col(f"{into}.n_words"), F.col(f"{into}.n_repeat_words")
    failed = (n < 20) | (100 * again > 30 * n)
    inside = F.lit(True)
    for m in names:
        low, high = F.col(f"{m}_low"), F.col(f"{m}_high")
        reach = (high - low) * fence * F.sqrt(1 + NOISE / F.greatest(n, F.lit(1)))
        inside = inside & F.coalesce(F.col(f"{into}.{m}").between(low - reach, high + reach), F.lit(True))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & inside).drop("__band", "__group", *[f"{m}_{e}" for m in names for e in ("low", "high")])


__all__ = ["bands", "judged", "measures"]
