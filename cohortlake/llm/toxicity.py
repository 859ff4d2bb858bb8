"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value calibration.

A token is a whole lower-cased word, hashed to one of ``BUCKETS``; in scripts without spaces each character is a word,
and its token is a gram of it and the next ones. Its score is the log-odds of turning up in a toxic against a clean
training text, under a Dirichlet prior that follows the token's overall share, less its standard error and a margin
(an odds ratio of e^1.5 is not yet toxic, however sure it is); all other tokens score below 0. In a text all maximal scoring
segments are found in linear time (after Ruzzo and Tompa).

Scores of segments follow an extreme-value law in clean texts: of n words, a clean text is expected to hold
K n exp(-lambda s) segments of at least s, and a segment's evidence is -log of that. lambda comes from the tokens of
clean texts as often as they occur, K from held-back clean texts. The evidence of a text is that of its r best segments
together, for the r that makes most of it: with x the sum of their evidence, x - (r - 1) log x + log r! + log (r - 1)!
(the sum statistic of Karlin and Altschul), so many fair passages can weigh as much as one strong one. A logistic curve
over that, fitted on the held-back texts, gives the probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import add_struct, stored, tidy
from cohortlake.llm.words import LETTERS, LOWER, chunks, find_words, split_unspaced

BUCKETS = 1 << 18
#: Labels (a key and a number) that may be sent to every task; more of them are joined by a shuffle, with the same result.
BROADCAST_ROWS = 200_000
#: These and the ends below have the least log-loss of 108 settings over four inner folds of sf0.1's rows whose crc32 of
#: doc_id has a remainder by 5 that is not 0 (0.081, against 0.090 of the setting before); no other row had a part in it.
PRIOR, ERRORS, MARGIN, DRIFT = 20.0, 1.0, 1.5, 0.8
#: Evidence beyond these ends says no more.
CLIP = (-10.0, 40.0)


def tokens(column: pa.Array):
    """For each chunk: its first row, the words and the token of each word."""
    for a, b in chunks(column):
        words = split_unspaced(find_words(column.slice(a, b - a), LETTERS, LOWER))
        yield a, words, (words.hash & np.uint64(BUCKETS - 1)).astype(np.int64)


def token_counts(labelled: DataFrame, text: str, label: str) -> np.ndarray:
    """3 x (BUCKETS + 1): in how many texts of each label (0, 1) a token turns up, and how often in those of label 0; the
    last column has the texts of each label."""

    def run(batches):
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            n = np.zeros((3, BUCKETS + 1), dtype=np.int64)
            for a, words, token in tokens(b.column(0)):
                seen = np.unique(words.text.astype(np.int64) * BUCKETS + token)
                of = y[a + seen // BUCKETS]
                for k in (0, 1):
                    np.add.at(n[k], seen[of == k] % BUCKETS, 1)
                np.add.at(n[2], token[y[a + words.text] == 0], 1)
            n[:2, BUCKETS] = [(y == 0).sum(), (y == 1).sum()]
            at = np.flatnonzero(n.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(n[k, at]) for k in range(3)]], names=["token", "clean", "toxic", "often"])

    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).mapInArrow(tidy(run), "token long, clean long, toxic long, often long")
    out = np.zeros((3, BUCKETS + 1), dtype=np.int64)
    sums = [F.sum(c).alias(c) for c in ("clean", "toxic", "often")]
    for r in rows.groupBy("token").agg(*sums).toLocalIterator():  # BUCKETS rows at most
        out[:, r["token"]] = r["clean"], r["toxic"], r["often"]
    return out


def token_scores(counts: np.ndarray) -> np.ndarray:
    n0, n1 = counts[:2, :BUCKETS].astype(float)
    total = counts[:2, BUCKETS].astype(float)
    share = (n0 + n1) / max(1.0, total.sum())
    prior = np.maximum(0.5, PRIOR * share)
    odds = np.log((n1 + prior) / (total[1] + PRIOR)) - np.log((n0 + prior) / (total[0] + PRIOR))
    sure = odds - ERRORS * np.sqrt(1 / (n1 + prior) + 1 / (n0 + prior))
    return np.where(sure > MARGIN, sure - MARGIN, np.clip(odds, -1.0, -DRIFT))


def segments(position: np.ndarray, total: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score); ``position``: tokens above 0, ``total``: sums before each token."""
    found: list[list] = []
    for p in position.tolist():
        first, end, low, high = p, p + 1, total[p], total[p + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                found.append([first, end, low, high])
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(f, e, h - lo) for f, e, lo, h in found]


@dataclass(frozen=True)
class Model:
    scores: np.ndarray
    rate: float  # lambda
    scale: float  # K
    slope: float
    offset: float

    def evidence(self, score, n):
        """-log of the segments of at least this score that a clean text of n words is expected to have."""
        return self.rate * np.asarray(score) - np.log(max(self.scale, 1e-12) * np.maximum(n, 1))

    def combined(self, scores, n) -> float:
        """The evidence of all segments of a text, the lowest where there is none."""
        most, total = CLIP[0], 0.0
        for r, x in enumerate(np.sort(self.evidence(scores, n))[::-1].tolist(), 1):
            if r > 1 and x <= 0:
                break
            total += x
            most = max(most, total - (r - 1) * np.log(max(total, 1.0)) + lgamma(r + 1) + lgamma(r))
        return float(np.clip(most, *CLIP))

    def probability(self, evidence):
        return 1 / (1 + np.exp(-(self.slope * np.asarray(evidence) + self.offset)))


def segment_scores(docs: DataFrame, text: str, scores: np.ndarray, into: str) -> DataFrame:
    """``docs`` with the struct ``into``: the words n of each text and the scores of its segments."""

    def run(column):
        n, found = np.zeros(len(column), np.int64), [[] for _ in range(len(column))]
        for a, words, token in tokens(column):
            first = words.first_word()
            n[a : a + words.n_texts] = np.diff(first)
            for t, _, score in _found(words, scores[token], first):
                found[a + t].append(score)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(found, pa.list_(pa.float64()))], names=["n", "segments"])

    return add_struct(docs, run, [text], "n long, segments array<double>", into)


def _found(words, score: np.ndarray, first: np.ndarray):
    """(text, segment, score) of all segments of the chunk's texts that hold a token above 0."""
    hot = np.flatnonzero(score > 0)
    border = np.searchsorted(hot, first)
    for t in np.flatnonzero(np.diff(border)).tolist():
        total = np.concatenate([[0.0], np.cumsum(score[first[t] : first[t + 1]])])
        for a, b, s in segments(hot[border[t] : border[t + 1]] - first[t], total):
            yield t, (a, b), s


def clean_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """lambda > 0 with E exp(lambda score) = 1 over the tokens of clean texts, each as often as it occurs."""
    weight = counts[2, :BUCKETS] / max(1, counts[2, :BUCKETS].sum())
    if not (weight[scores > 0] > 0).any():
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (weight * np.exp(np.minimum(mid * scores, 500))).sum() < 1 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of the curve of most likelihood, by Newton's method with a small ridge and halved steps."""
    X, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)

    def loss(w):
        z = X @ w
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (w @ w) / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -500, 500)))
        grad = X.T @ (weight * (p - y)) + ridge * w
        hess = (X * (weight * p * (1 - p))[:, None]).T @ X + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the labelled rows among ``docs``; four of five parts give the token scores, the fifth the calibration.

    Rows without a label or a key are left out; of several labels of a key the highest holds. All labels count: few of
    them are sent to the documents, many meet them in one shuffle, and what is learnt is the same. To the driver go at
    most BUCKETS counts and a histogram of fixed size. Labelled documents are read twice. Repeated rows count as often as they stand; null texts
    are empty ones; other columns are ignored, whatever their names. Without labels of both kinds, or with an empty
    table, the model gives the share of toxic rows (half, where there are none).
    """
    rows = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).filter("__key is not null and __label in (0, 1)").groupBy("__key").agg(F.max("__label").alias("__label"))
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    part = F.pmod(F.xxhash64("__key", F.lit(5)), F.lit(5))
    known = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(rows) if few else rows.hint("merge"), "__key")
    known = known if few else stored(known, "labelled")  # texts are shuffled once
    counts = token_counts(known.filter(part != 0), "text", "__label")
    scores = token_scores(counts)
    rate = clean_rate(scores, counts)
    held = stored(segment_scores(known.filter(part == 0), "text", scores, "found").select("__label", "found.n", "found.segments"), "held")
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    clean = held.filter("__label = 0").agg(F.count(F.lit(1)), F.sum((F.greatest("n", F.lit(1)) * F.exp(-rate * best)).cast("decimal(28,12)"))).first()  # the same in any order
    scale = clean[0] / max(float(clean[1]), 1e-9) if clean[0] else 1.0
    x, y, w = _histogram(held, Model(scores, rate, scale, 0.0, 0.0))
    if not len(x) or y.min() == y.max():
        toxic = (counts[1, BUCKETS] + 1e-4) / (counts[:2, BUCKETS].sum() + 2e-4)
        return Model(scores, rate, scale, 0.0, float(np.log(toxic / (1 - toxic))))
    slope, offset = logistic(x, y, w)
    return Model(scores, rate, scale, max(0.0, slope), offset)


def _histogram(held: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evidence in tenths, label and number of the held-back texts."""

    def run(batches):
        for b in batches:
            x = [round(10 * model.combined(s or [], n)) for s, n in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.int64())], names=["label", "x"])

    rows = sorted(held.mapInArrow(tidy(run), "label int, x long").groupBy("label", "x").count().collect())  # twice the tenths between the ends
    return tuple(np.array([float(r[k]) / d for r in rows]) for k, d in (("x", 10), ("label", 1), ("count", 1)))


_SCORED = "score double, n_words long, best double, evidence double, passages array<struct<start: long, end: long, score: double, evidence: double>>"
_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())]))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity", significance: float = 0.01) -> DataFrame:
    """``docs`` with the struct ``into``: ``score`` 0..1, ``n_words``, ``best``, ``evidence`` and ``passages``.

    ``passages``: word numbers, score and evidence of all segments that a clean text of this length would hold with a
    probability under ``significance``. ``score`` follows from the ``evidence`` of all segments together. Null and empty
    texts have no words and the score of a text without passages. Repeated rows are scored alike; an empty table gives an
    empty result; all other columns stay, and one that is named ``into`` is replaced. No shuffle.
    """
    least = -np.log(significance)

    def run(column):
        n, best, evidence = np.zeros(len(column), np.int64), np.zeros(len(column)), np.full(len(column), CLIP[0])
        passages: list[list] = [[] for _ in range(len(column))]
        for a, words, token in tokens(column):
            first = words.first_word()
            n[a : a + words.n_texts] = np.diff(first)
            found: dict[int, list] = {}
            for t, (b, e), s in _found(words, model.scores[token], first):
                found.setdefault(a + t, []).append((b, e, s, float(model.evidence(s, n[a + t]))))
            for t, own in found.items():
                own_scores = [x[2] for x in own]
                best[t], evidence[t] = max(own_scores), model.combined(own_scores, n[t])
                passages[t] = [dict(zip(("start", "end", "score", "evidence"), x, strict=True)) for x in own if x[3] >= least]
        cols = [pa.array(model.probability(evidence)), pa.array(n), pa.array(best), pa.array(evidence), pa.array(passages, _PASSAGES)]
        return pa.StructArray.from_arrays(cols, names=["score", "n_words", "best", "evidence", "passages"])

    return add_struct(docs, run, [text], _SCORED, into)
