"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of word pieces; a probability of each piece in each
language, learned by expectation-maximisation on a bounded sample of labelled
documents. A word's probability in a language is the sum over all its
segmentations into pieces (forward algorithm); a text's is the product over
its words, since pieces never cross a word's edge. The language with the
largest sum of logarithms is predicted; the score is its posterior under even
priors.

Text is lower-cased; words are runs of letters of any length (in learning only,
those of over 64 letters are cut into stretches). Letters outside the vocabulary
have one small probability in every language.

Edge cases: a null text, and one without letters (digits, fractions and Roman
numerals are none), gives ``und`` with score 0, as does every text where there
was nothing to learn from; ties go to the first language in alphabetical order;
repeated rows are judged alike; an empty table gives an empty table; further
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm.common import LETTERS, crc_remainder, map_texts, texts_of

PIECES = "piece_bpe_32k.model"
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 300, 256
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
EDGE = "▁"
_STRETCH, _LIFT, _FLOOR, _KEPT_WORDS, _BATCH = 64, 16.0, 1e-5, 200_000, 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a public vocabulary file that lower-cased letters can match."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if p == p.lower() and LETTERS.fullmatch(p.removeprefix(EDGE) or "a")})


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def stretches(words: list[str]) -> list[str]:
    """The words to learn from: long ones are cut, so that sums neither over- nor underflow."""
    if max(map(len, words), default=0) > _STRETCH:
        words = [w[i : i + _STRETCH] for w in words for i in range(0, len(w), _STRETCH)]
    return words


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rolling 64-bit hashes of all beginnings of the words, [longest + 1, words], and the lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    longest = int(sizes.max(initial=0))
    code = np.zeros((len(words), longest), np.uint64)
    code[np.arange(longest) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((longest + 1, len(words)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(longest):
            out[j + 1] = out[j] * _BASE + (code[:, j] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out, sizes


class Lattice:
    """Finds the pieces in words: their places in the segmentation lattice."""

    def __init__(self, pieces: list[str]) -> None:
        found, sizes = _hashes(pieces)
        key = found[sizes, np.arange(len(pieces))] if pieces else np.zeros(0, np.uint64)
        self._order = np.argsort(key)
        self._key = key[self._order]
        self.longest = int(sizes.max(initial=1))
        self.n = len(pieces)  # the piece after the last is any single letter that isn't one
        self._mark = np.zeros(1 << 20, bool)
        self._mark[key >> np.uint64(44)] = True
        with np.errstate(over="ignore"):
            self._power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.longest + 1, _BASE))))

    def matches(self, word: str) -> list[np.ndarray]:
        """For each size of piece from 1 on: the piece that begins at each place of an edge and the word, -1 for none."""
        found, _ = _hashes([EDGE + word])
        out = []
        for size in range(1, min(self.longest, len(word) + 1) + 1):
            with np.errstate(over="ignore"):
                key = found[size:, 0] - found[:-size, 0] * self._power[size]
            place = np.minimum(np.searchsorted(self._key, key), max(0, self.n - 1))
            hit = self._key[place] == key if self.n else np.zeros(len(key), bool)
            out.append(np.where(hit, self._order[place] if self.n else 0, self.n if size == 1 else -1))
        return out

    def edges(self, words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, int]:
        """(to, from, piece) of the lattice's edges by length within rising ends; each word's first node; how many nodes."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        found, sizes = _hashes([EDGE + words[i] for i in order])
        node = np.zeros(len(words), np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(words) else node
        node[order] = first
        out = []
        for j in range(1, int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(-sizes, -j, side="right"))  # words with that many letters
            for size in range(1, min(self.longest, j) + 1):
                with np.errstate(over="ignore"):
                    key = found[j, :n] - found[j - size, :n] * self._power[size]
                if size == 1:
                    at = np.arange(n)
                else:
                    at = np.flatnonzero(self._mark[key >> np.uint64(44)])
                    if not len(at):
                        continue
                    key = key[at]
                place = np.minimum(np.searchsorted(self._key, key), max(0, self.n - 1))
                hit = self._key[place] == key if self.n else np.zeros(len(key), bool)
                piece = np.where(hit, self._order[place] if self.n else 0, self.n)
                if size > 1:
                    at, piece = at[hit], piece[hit]
                if len(at):
                    out.append((first[at] + j, first[at] + j - size, piece))
        return out, node, int((sizes + 1).sum())


@dataclass
class Model:
    pieces: list[str]
    langs: list[str]
    prob: np.ndarray  # [pieces + 1, languages], each lifted by _LIFT a letter


def _lifted(pieces: list[str], prob: np.ndarray) -> np.ndarray:
    lift = _LIFT ** np.array([len(p) for p in pieces] + [1.0])
    return prob * lift[:, None]


def long_word_score(lattice: Lattice, prob: np.ndarray, word: str) -> np.ndarray:
    """The same for one word of any length: sums are kept in range by a factor that goes along as a logarithm."""
    pieces = lattice.matches(word)
    n, width = len(word) + 1, len(pieces)
    total, log = np.zeros((width, prob.shape[1])), np.zeros(prob.shape[1])  # of the last places, the nearest last
    total[-1] = 1
    for j in range(1, n + 1):
        now = np.zeros(prob.shape[1])
        for size in range(1, min(width, j) + 1):
            piece = pieces[size - 1][j - size]
            if piece >= 0:
                now += total[-size] * prob[piece]
        total[:-1] = total[1:]
        total[-1] = now
        if j % 16 == 0 or j == n:
            top = np.maximum(total.max(0), 1e-300)
            total /= top
            log += np.log(top)
    return np.log(np.maximum(total[-1], 1e-300)) + log - n * np.log(_LIFT)


def word_scores(lattice: Lattice, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word in each language, summed over all segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    long = [i for i, w in enumerate(words) if len(w) > _STRETCH]
    if long:
        for i in long:
            out[i] = long_word_score(lattice, prob, words[i])
        rest = [i for i, w in enumerate(words) if len(w) <= _STRETCH]
        out[rest] = word_scores(lattice, prob, [words[i] for i in rest])
        return out
    for start in range(0, len(words), _BATCH):
        part = words[start : start + _BATCH]
        edges, node, n = lattice.edges(part)
        total = np.zeros((n, prob.shape[1]))
        total[node] = 1
        for to, begin, piece in edges:
            total[to] += total[begin] * prob[piece]
        size = np.array([len(w) + 1 for w in part])
        out[start : start + len(part)] = np.log(np.maximum(total[node + size], 1e-300)) - size[:, None] * np.log(_LIFT)
    return out


def learn(lattice: Lattice, pieces: list[str], counts: Counter, rounds: int = 4, smooth: float = 0.1) -> np.ndarray:
    """Piece probabilities of one language from its words, by expectation-maximisation."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], float)
    n = len(pieces) + 1
    prob = np.full(n, 1 / n)
    lattices = [(lattice.edges(words[i : i + _BATCH]), words[i : i + _BATCH], weight[i : i + _BATCH]) for i in range(0, len(words), _BATCH)]
    for _ in range(rounds):
        p = _lifted(pieces, prob[:, None])[:, 0]
        p[-1] = _FLOOR * _LIFT
        seen = np.zeros(n)
        for (edges, node, size), part, times in lattices:
            a, b = np.zeros(size), np.zeros(size)
            a[node] = 1
            for to, begin, piece in edges:
                a[to] += a[begin] * p[piece]
            end = node + np.array([len(w) + 1 for w in part])
            b[end] = times / np.maximum(a[end], 1e-300)
            for to, begin, piece in reversed(edges):
                b[begin] += b[to] * p[piece]
                seen += np.bincount(piece, weights=a[begin] * p[piece] * b[to], minlength=n)
        prob = (seen + smooth) / (seen.sum() + smooth * n)
    return prob


def fit_texts(samples: dict[str, list[str]], path: str | None = None) -> Model:
    """Learn from some texts of each language."""
    pieces, langs = vocabulary(path), sorted(samples)
    lattice = Lattice(pieces)
    columns = [learn(lattice, pieces, Counter(chain.from_iterable(stretches(words_of(t)) for t in samples[x]))) for x in langs]
    prob = np.stack(columns, 1) if columns else np.zeros((len(pieces) + 1, 0))
    prob[-1] = _FLOOR
    return Model(pieces, langs, _lifted(pieces, prob))


class Judge:
    """Predicts the languages of texts; keeps the scores of words that it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, Lattice(model.pieces)
        self._forget()

    def _forget(self) -> None:
        self._code: dict[str, int] = {}
        self._score = np.zeros((0, len(self.model.langs)))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        split = [words_of(t) for t in texts]
        if len(self._code) > _KEPT_WORDS:
            self._forget()
        known = self._code
        fresh = list({w: None for words in split for w in words if w not in known})
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self._score = np.concatenate((self._score, word_scores(self.lattice, self.model.prob, fresh)))
        langs = self.model.langs
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        sizes = np.array([len(w) for w in split], np.int64)
        some = np.flatnonzero(sizes)
        if not langs or not len(some):
            return pred, score
        code = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        total = np.add.reduceat(self._score[code], (np.cumsum(sizes) - sizes)[some])
        best = total.argmax(1)
        score[some] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        for i, b in zip(some.tolist(), best.tolist(), strict=True):
            pred[i] = langs[b]
        return pred, score


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, path: str | None = None, most_languages: int = MOST_LANGUAGES) -> Model:
    """Learn from about ``sample_per_language`` documents of each language, none of them held out.

    Held out are documents whose crc32(doc_id) mod 4 is 2. Languages are the
    ``most_languages`` with the most documents, so what comes to the driver is bounded.
    """
    rows = docs.select("doc_id", "lang", "text").filter(crc_remainder("doc_id", 4) != 2).filter("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return fit_texts({}, path)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, sample_per_language / n) * (1 << 20)) + 1)))
    chosen = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang"))
    found = rows.filter(chosen).filter("text IS NOT NULL").limit(2 * sample_per_language * len(sizes)).toArrow().sort_by("doc_id")
    samples: dict[str, list[str]] = {lang: [] for lang in sizes}
    for lang, text in zip(found.column("lang").to_pylist(), found.column("text").to_pylist(), strict=True):
        samples[lang].append(text)
    return fit_texts(samples, path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; see the module."""

    def make():
        judge = Judge(model)

        def work(chunk: pa.Table) -> pa.Table:
            pred, score = judge.predict(texts_of(chunk.column("text")))
            return pa.table({"doc_id": chunk.column("doc_id").cast(pa.int64()), "held_out": chunk.column("held_out"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

        return work

    return map_texts(docs.select("doc_id", "text", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")), make, SCHEMA)
