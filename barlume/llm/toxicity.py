"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, a sample of all documents is the
unlabelled set. With the class prior p, the risk of a classifier g is

    p R_P(g, +) + max(0, R_U(g, -) - p R_P(g, -)),

the term under max being the estimated risk on negatives; where it falls below
zero in a step, the step climbs back along it (non-negative risk estimator).
The classifier is linear on counts and densities of words and of their
beginnings, fitted in numpy. A form is taken up as a feature where it is far
more frequent among positives than among unlabelled texts.

Letters are those of the Unicode property. Samples are bounded (``SAMPLE_POSITIVE``,
``SAMPLE_UNLABELLED``); in them, of copies and near copies one counts (``unlike``).

Edge cases: null and empty texts get a score from the bias alone; texts of any
length are read whole; repeated rows score alike; without positives every score
is the prior's; an empty table gives an empty table; further columns are not
read, and ``keep_clean`` returns them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm.common import LETTERS, crc_remainder, filter_texts, hash_below, map_texts, texts_of
from barlume.llm.jaccard import shingles

SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 3000, 6000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray  # of [count, density] for each word, then n hits, density of hits, bias
    bias: float


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def forms(word: str) -> tuple[str, ...]:
    """A word and its beginnings: inflected and compounded words share those."""
    n = len(word)
    return (word,) if n < 5 else (word, word[:4] + "*") if n == 5 else (word, word[:4] + "*", word[:5] + "*")


@dataclass
class _Rows:
    """Feature rows, of which few values aren't zero: a row, a column and a value each."""

    n: int
    width: int
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.col], self.n)

    def sums(self, of_rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * of_rows[self.row], self.width)


def _features(words: dict[str, int], texts: list[str]) -> _Rows:
    """log(1 + count) of each feature form, then three squashed measures of the words with any, then a one."""
    row, col, value = [], [], []
    known: dict[str, tuple[int, ...]] = {}
    k = len(words)
    for i, text in enumerate(texts):
        found = words_of(text)
        hits, counts = 0, Counter()
        for w in found:
            at = known.get(w)
            if at is None:
                at = known[w] = tuple(words[f] for f in forms(w) if f in words)
            if at:
                hits += 1
                counts.update(at)
        row += [i] * (len(counts) + 4)
        col += [*counts, k, k + 1, k + 2, k + 3]
        value += [*map(log1p, counts.values()), log1p(hits), min(1.0, hits / 2), log1p(100 * hits / max(10, len(found))), 1.0]
        if len(known) > 200_000:
            known.clear()
    return _Rows(len(texts), k + 4, np.array(row, np.int64), np.array(col, np.int64), np.array(value, float))


def choose_words(positive: list[str], unlabelled: list[str]) -> dict[str, int]:
    """Forms in many more positives than chance brings: two at least, lift over 3, and 8 standard errors."""
    p, u = Counter(), Counter()
    for texts, counts in ((positive, p), (unlabelled, u)):
        for text in texts:
            counts.update({f for w in set(words_of(text)) for f in forms(w)})
    n, m = max(1, len(positive)), max(1, len(unlabelled))
    found = []
    for w, c in p.items():
        rate, base = c / n, (u[w] + 1) / (m + 1)
        z = (rate - base) / np.sqrt(base * (1 - min(base, 0.999)) / n)
        if c >= 2 and rate > 3 * base and z > 8:
            found.append((-z, w))
    return {w: i for i, (_, w) in enumerate(sorted(found))}


def unlike(texts: list[str], keep: int = 8) -> list[str]:
    """One text of each group of copies and near copies, or a large group would set the features.

    A text goes where half of its smallest shingle hashes have been met before.
    """
    seen: set[int] = set()
    out = []
    for text in sorted(set(texts)):
        least = shingles(text, 4)[:keep].tolist()
        if len(least) < keep or 2 * sum(h in seen for h in least) < keep:
            out.append(text)
        seen.update(least)
    return out


def risk_and_slope(x_p: _Rows, x_u: _Rows, theta: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk of positives and the estimated risk of negatives (may be below zero), and the slopes of both."""
    s_p, s_u = 1 / (1 + np.exp(-x_p.times(theta))), 1 / (1 + np.exp(-x_u.times(theta)))
    pull = prior * x_p.sums(s_p - 1) / len(s_p)
    push = x_u.sums(s_u) / len(s_u) - prior * x_p.sums(s_p) / len(s_p)
    kept = -prior * np.log(s_p + 1e-12).mean()
    risk = -np.log(1 - s_u + 1e-12).mean() + prior * np.log(1 - s_p + 1e-12).mean()
    return float(kept), float(risk), pull, push


def fit_texts(positive: list[str], unlabelled: list[str], prior: float, rounds: int = 600, rate: float = 0.05, penalty: float = 1e-3) -> Model:
    prior = min(0.99, max(1e-4, prior))
    positive, unlabelled = unlike(positive), unlike(unlabelled)
    words = choose_words(positive, unlabelled)
    bias = float(np.log(prior / (1 - prior)))
    weights = np.zeros(len(words) + 3)
    if not positive or not unlabelled or not words:
        return Model(words, weights, bias)
    x_p, x_u = _features(words, positive), _features(words, unlabelled)
    theta = np.append(weights, bias)
    mean, square, held = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, risk, pull, push = risk_and_slope(x_p, x_u, theta, prior)
        slope = pull + push if risk >= 0 else -push
        slope[:-1] += penalty * theta[:-1]
        mean += 0.1 * (slope - mean)
        square += 0.001 * (slope * slope - square)
        theta -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        if 2 * step > rounds:  # steps that climb back make it swing: the mean of the second half is the model
            held += theta / (rounds - rounds // 2)
    return Model(words, held[:-1], float(held[-1]))


def score_texts(model: Model, texts: list[str]) -> np.ndarray:
    return 1 / (1 + np.exp(-_features(model.words, texts).times(np.append(model.weights, model.bias))))


def fit(docs: DataFrame, labels: DataFrame, sample_positive: int = SAMPLE_POSITIVE, sample_unlabelled: int = SAMPLE_UNLABELLED) -> Model:
    """Train on bounded samples of rows that aren't held out (crc32(doc_id) mod 5 is 0).

    The prior is the share of toxic rows among those labels.
    """
    marked = labels.select("doc_id", "toxic").filter(crc_remainder("doc_id", 5) != 0).filter("toxic IS NOT NULL")
    n, toxic = marked.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    sure = marked.filter("toxic = 1").filter(hash_below(min(1.0, sample_positive / max(1, toxic)), "doc_id", 7)).limit(2 * sample_positive)
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    share = min(1.0, sample_unlabelled / max(1, docs.count()))
    seen = texts.filter(crc_remainder("doc_id", 5) != 0).filter(hash_below(share, "doc_id", 77)).limit(2 * sample_unlabelled)
    pulled = [x.toArrow().sort_by("doc_id").column("text").to_pylist() for x in (texts.join(F.broadcast(sure.select("doc_id").distinct()), "doc_id").limit(2 * sample_positive), seen)]
    return fit_texts(*pulled, prior=toxic / max(1, n))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; see the module."""

    def make():
        def work(chunk: pa.Table) -> pa.Table:
            score = score_texts(model, texts_of(chunk.column("text")))
            return pa.table({"doc_id": chunk.column("doc_id").cast(pa.int64()), "held_out": chunk.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

        return work

    return map_texts(docs.select("doc_id", "text", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")), make, SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    return filter_texts(docs, lambda: lambda texts: score_texts(model, texts) < 0.5)
