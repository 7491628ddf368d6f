"""Quality rules by line sequence labelling.

Base rules count words, symbols, repeated lines and repeated three-word
windows. Then a linear-chain conditional random field labels each line with a
word as content or boilerplate (Viterbi), from the shapes of the lines: case,
symbols, bars, exclamation marks, word lengths, repetition, place. A document
passes where at least half of its word characters stand in content lines.

The field is trained on a bounded sample of labelled documents
(``sample_docs``); a line's training label is its document's.

Edge cases: a null or empty text has no words, so it fails the base rules; a
document without doc_id is judged like any other; repeated rows are judged
alike; an empty table gives an empty table; without labelled documents every
line counts as content; further columns are not read, and ``keep_good`` returns
them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.llm import crf
from barlume.llm.common import WORD, filter_texts, hash_below, map_texts, texts_of

CONTENT, BOILERPLATE = 0, 1
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT_SHARE = 50, 50, 0.5
SAMPLE_DOCS = 3000
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"

_SPACES = [0x20, *range(0x09, 0x0E)]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_TABLE = 0x2500
_UPPER = np.array([chr(i).isupper() for i in range(_TABLE)] + [False])
_LETTER = np.array([chr(i).isalpha() for i in range(_TABLE)] + [True])
_DIGIT = np.array([chr(i).isdigit() for i in range(_TABLE)] + [False])
_SPACE = np.isin(np.arange(_TABLE + 1), _SPACES)
_SYMBOL = np.isin(np.arange(_TABLE + 1), _SYMBOLS)
_END = np.isin(np.arange(_TABLE + 1), [ord(c) for c in ".!?\"'"])


class Lines:
    """Counts of all lines of some texts; ``doc`` tells whose line each is."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\n".join(texts) + "\n"
        code = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), _TABLE).astype(np.uint16)
        stops = np.flatnonzero(code == 10)
        starts = np.concatenate(([0], stops[:-1] + 1))
        text_starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])) if texts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(text_starts, starts, side="right") - 1
        self.n_docs = len(texts)

        def per_line(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate((np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)))
            return (total[stops] - total[starts]).astype(np.int64)

        solid = ~_SPACE[code]
        self.chars = per_line(solid)
        self.symbols = per_line(_SYMBOL[code])
        self.upper, self.letters, self.digits = per_line(_UPPER[code]), per_line(_LETTER[code]), per_line(_DIGIT[code])
        self.shouts, self.bars = per_line(code == ord("!")), per_line(code == ord("|"))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid)).astype(np.int8)))
        begins, ends = edge[0::2], edge[1::2]  # the text ends with a line break, so each word ends
        line = np.searchsorted(starts, begins, side="right") - 1
        self.words = np.bincount(line, minlength=len(starts))
        self.short = np.bincount(line[ends - begins <= 3], minlength=len(starts))
        last = np.zeros(len(starts), np.int64)
        last[line] = ends - 1
        self.ended = _END[code[last]] & (self.words > 0)
        self.repeated = np.zeros(len(starts), bool)
        k = 0
        for text in texts:
            lines = text.split("\n")
            if len(lines) > 1:
                seen: set[str] = set()
                for i, x in enumerate(lines, k):
                    if x in seen:
                        self.repeated[i] = True
                    else:
                        seen.add(x)
            k += len(lines)
        self.repeated &= self.words > 0

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=self.n_docs).astype(np.int64)


def features(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of the lines with a word, those lines' places, the lengths of the sequences."""
    at = np.flatnonzero(lines.words > 0)
    doc, words = lines.doc[at], lines.words[at]
    ratio = lambda a, b: a[at] / np.maximum(1, b[at])
    symbols, shouts, bars = (ratio(x, lines.words) for x in (lines.symbols, lines.shouts, lines.bars))
    upper, digits = ratio(lines.upper, lines.letters), ratio(lines.digits, lines.chars)
    length, short = ratio(lines.chars, lines.words), ratio(lines.short, lines.words)
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(at) else np.zeros(0, bool)
    final = np.concatenate((first[1:], [True])) if len(at) else first
    columns = [
        np.ones(len(at)), symbols > 0, symbols > 0.25, symbols > 0.75, shouts > 0.2, shouts > 0.6, bars > 0.1, bars > 0.3,
        upper > 0.15, upper > 0.4, upper > 0.8, lines.repeated[at], words == 1, (words > 1) & (words < 4), (words >= 4) & (words < 8),
        (words >= 8) & (words < 16), (words >= 16) & (words < 64), words >= 64, lines.ended[at], digits > 0.1, digits > 0.3,
        length > 7, length > 9, length < 3, short < 0.1, short < 0.2, short > 0.5, first, final,
    ]
    rows = np.stack(columns, 1).astype(float)
    return rows, at, np.bincount(np.unique(doc, return_inverse=True)[1]) if len(at) else np.zeros(0, np.int64)


def repeat_words(text: str) -> tuple[int, int]:
    """The number of words, and of words in three-word windows that occur twice or more."""
    ids: dict[str, int] = {}
    of = ids.setdefault
    word = np.array([of(w, len(ids)) for w in WORD.findall(text)], np.int64)
    n = len(word)
    if n < 4:
        return n, 0
    size = len(ids)
    window = word[:-2] * size + word[1:-1]
    if size > 1_000_000:  # so that the third factor can't overflow
        window = np.unique(window, return_inverse=True)[1]
    window = window * size + word[2:]
    if size == n:
        return n, 0
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return n, 0
    twice = np.zeros(n + 2, bool)
    hit = np.concatenate((order[1:][same], order[:-1][same]))
    for shift in range(3):
        twice[hit + shift] = True
    return n, int(twice.sum())


def judge(chain: crf.Chain, texts: list[str]) -> dict[str, np.ndarray]:
    """The counts and the verdict of every text."""
    lines = Lines(texts)
    repeats = np.array([repeat_words(t) for t in texts], np.int64).reshape(-1, 2)
    rows, at, lengths = features(lines)
    content = np.zeros(len(lines.words), bool)
    content[at] = crf.viterbi(chain, rows, lengths) == CONTENT
    chars = lines.per_doc(lines.chars)
    share = lines.per_doc(lines.chars * content) / np.maximum(1, chars)
    failed = (repeats[:, 0] < MIN_WORDS) | (100 * repeats[:, 1] > MAX_REPEAT_PERCENT * repeats[:, 0])
    return {
        "n_words": repeats[:, 0], "word_chars": chars, "n_symbols": lines.per_doc(lines.symbols), "n_dup_lines": lines.per_doc(lines.repeated),
        "n_repeat_words": repeats[:, 1], "base_failed": failed, "kept": ~failed & (share >= MIN_CONTENT_SHARE), "content_share": share,
    }


def fit_texts(texts: list[str], good: list[bool]) -> crf.Chain:
    lines = Lines(texts)
    rows, at, lengths = features(lines)
    labels = np.where(np.array(good, bool)[lines.doc[at]], CONTENT, BOILERPLATE) if len(at) else np.zeros(0, int)
    return crf.train(rows, labels, lengths)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> crf.Chain:
    """Train on about ``sample_docs`` labelled documents, at most twice as many."""
    marked = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    share = min(1.0, sample_docs / max(1, marked.count()))
    sample = marked.filter(hash_below(share, "doc_id", 10)).limit(2 * sample_docs)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality").limit(2 * sample_docs).toArrow()
    rows = rows.sort_by("doc_id")  # the same model whatever the order in which tasks end
    return fit_texts(texts_of(rows.column("text")), [q == 1 for q in rows.column("quality").to_pylist()])


def quality_rules(docs: DataFrame, chain: crf.Chain) -> DataFrame:
    """One row per document with its counts and the verdict; see the module."""

    def make():
        def work(chunk: pa.Table) -> pa.Table:
            found = judge(chain, texts_of(chunk.column("text")))
            return pa.table({"doc_id": chunk.column("doc_id").cast(pa.int64())} | {k: pa.array(v) for k, v in found.items()})

        return work

    return map_texts(docs.select("doc_id", "text"), make, SCHEMA)


def keep_good(docs: DataFrame, chain: crf.Chain) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return filter_texts(docs, lambda: lambda texts: judge(chain, texts)["kept"])
