"""Byte-pair encoding and decoding by a pair occurrence index.

A partition is read in chunks of bounded size. The distinct words of a chunk that
are new to the task become one array of symbols; an index maps each mergeable
pair to all its positions in that array. (Words that the task has met keep
their tokens, so no pair of the partition is merged twice; one index over a whole
partition would grow with it.) Ranks that are
present are applied in ascending order, each to all its positions at once, and
the lists of the pairs that a merge makes are extended. A pair made by a merge
always ranks after it, because every merge makes a symbol of its own, so one
ascending pass is exact.

Normalisation, word pattern, word ends and special tokens are those of the
tokenizer file: NFC, white space to one space, lower case; the file's pattern;
byte-level symbols with an end-of-word mark; strings of special tokens inside
a text give those tokens.

Edge cases: a null or empty text gives no tokens and an empty decoded text;
repeated rows are encoded alike; texts of any length are encoded whole; a null
doc_id stays null; an empty table gives an empty table; further columns are not
read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barlume.llm.common import map_texts, texts_of

TOKENIZER = "word_bpe_49k.json"
SCHEMA = "doc_id long, ids array<int>, decoded string"
NONE = np.iinfo(np.int32).max
# Code points of Unicode 17 that the regex module takes for letters or numbers and the library does not.
YOUNG = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
# Small letters of capitals younger than this Python.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_KEPT_WORDS = 120_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@dataclass
class Spec:
    """What the encoder needs of a tokenizer file."""

    tokens: list[str]
    first: np.ndarray  # of merge r: left and right symbol, and what they make
    second: np.ndarray
    made: np.ndarray
    inner: np.ndarray  # symbol of each byte inside a word, and at its end
    final: np.ndarray
    pattern: str
    special: dict[str, int]


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load(path: str | None = None) -> Spec:
    """Read a tokenizer file of the kind described in the module."""
    raw = json.loads(Path(path or default_path()).read_text())
    model = raw["model"]
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    special = {x["content"]: x["id"] for x in raw["added_tokens"]}
    tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in chain(vocab.items(), special.items()):
        tokens[i] = token
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    alphabet = byte_alphabet()
    column = lambda values: np.array([vocab[v] for v in values], np.int64)
    return Spec(
        tokens, column(a for a, _ in merges), column(b for _, b in merges), column(a + b for a, b in merges),
        column(alphabet), column(c + suffix for c in alphabet), raw["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], special,
    )


class Encoder:
    """Splits texts to words and encodes each distinct word once per chunk."""

    def __init__(self, spec: Spec) -> None:
        self.spec = spec
        keys = spec.first << 20 | spec.second
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        # \s of the file's pattern is the Unicode property; the library does not know Unicode 17
        pattern = spec.pattern.replace(r"\s", r"\p{White_Space}")
        self._find = regex.compile(pattern).findall
        young = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in YOUNG)
        self._young = regex.compile(f"[{young}{''.join(map(chr, LOWER))}]").search
        self._find_young = regex.compile(pattern.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]||[{young}]]").replace(r"[\p{L}]", f"[\\p{{L}}--[{young}]]").replace(r"[\p{N}]", f"[\\p{{N}}--[{young}]]"), regex.V1).findall
        # most texts are Latin-1: there the classes are short lists, which the standard module searches faster
        kind = lambda c: unicodedata.category(c)[0]
        latin = [chr(i) for i in range(256)]
        letters, numbers = ("".join(re.escape(c) for c in latin if kind(c) == k) for k in "LN")
        spaces = "".join(re.escape(c) for c in latin if regex.fullmatch(r"\p{White_Space}", c))
        self._find_latin = re.compile(spec.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")).findall
        self._parts = regex.compile("(" + "|".join(map(regex.escape, spec.special)) + ")").split if spec.special else None
        self._forget()

    def _forget(self) -> None:
        self._code: dict[str, int] = {x: i for i, x in enumerate(self.spec.special)}
        self._ids = np.array(list(self.spec.special.values()), np.int32)
        self._lengths = np.ones(len(self.spec.special), np.int64)

    def _plain(self, text: str) -> list[str]:
        """The words; white space is in none of them, so its runs need no shortening."""
        try:
            text.encode("latin-1")
            return self._find_latin(text.lower())
        except UnicodeEncodeError:
            pass
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower case by code point: no final sigma
        text = text.replace("Σ", "σ").lower()
        return self._find_young(text.translate(LOWER)) if self._young(text) else self._find(text)

    def words(self, text: str) -> list[str]:
        if self._parts is None or "<|" not in text:
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self._parts(text)):
            out += [part] if i % 2 else self._plain(part)
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, one after another, and how many each has."""
        data = [w.encode() for w in words]
        sizes = np.array([len(d) for d in data], np.int64)
        code = np.frombuffer(b"".join(data), np.uint8)
        n = len(code)
        if not n:
            return np.zeros(0, np.int32), sizes
        last = np.cumsum(sizes) - 1
        symbol = self.spec.inner[code]
        symbol[last] = self.spec.final[code[last]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last] = -1
        before[np.concatenate(([0], last[:-1] + 1))] = -1
        alive, rank = np.ones(n, bool), np.full(n, NONE, np.int64)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def index(at: np.ndarray) -> None:
            """Rank the pairs that begin at these positions and enter them into the index."""
            follow = after[at]
            some = follow >= 0
            found = np.full(len(at), NONE, np.int64)
            found[some] = self._rank(symbol[at[some]], symbol[follow[some]])
            rank[at] = found
            good = found < NONE
            at, found = at[good], found[good]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cut = np.flatnonzero(np.diff(found)) + 1
            for r, part in zip(found[np.concatenate(([0], cut))].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
                if r in places:
                    places[r].append(part)
                else:
                    places[r] = [part]
                    heapq.heappush(waiting, r)

        index(np.arange(n))
        while waiting:
            r = heapq.heappop(waiting)
            lists = places.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.spec.first[r] == self.spec.second[r] and len(at) > 1:  # in a run every other pair, from the left
                at = np.sort(at)
                fresh = np.concatenate(([True], after[at[:-1]] != at[1:]))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.spec.made[r]
            after[at] = beyond
            some = beyond >= 0
            before[beyond[some]] = at[some]
            rank[gone], alive[gone] = NONE, False
            left = before[at]
            left = left[left >= 0]
            index(np.unique(np.concatenate((left, at))) if len(left) else at)
        counts = np.add.reduceat(alive.astype(np.int64), last - sizes + 1)
        return symbol[alive].astype(np.int32), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin and end."""
        split = [self.words(t) for t in texts]
        if len(self._code) > _KEPT_WORDS:
            self._forget()
        known = self._code
        fresh = list({w: None for words in split for w in words if w not in known})
        if fresh:
            ids, counts = self.encode_words(fresh)
            base = len(known)
            known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            self._ids = np.concatenate((self._ids, ids))
            self._lengths = np.concatenate((self._lengths, counts))
        total = sum(map(len, split))
        code = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, total)
        begin = np.cumsum(self._lengths) - self._lengths
        sizes = self._lengths[code]
        ends = np.cumsum(sizes)
        flat = self._ids[np.arange(int(ends[-1]) if total else 0) + np.repeat(begin[code] - ends + sizes, sizes)]
        words = np.cumsum([len(w) for w in split])
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], words)).astype(np.int64)]
        return flat, bounds

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: what a file without a decoder gives."""
        return " ".join(map(self.spec.tokens.__getitem__, ids))


def encode_decode(docs: DataFrame, spec: Spec | None = None) -> DataFrame:
    """One row per document: doc_id, the ids of its whole text, the text decoded from them."""
    spec = spec or load()

    def make():
        encoder = Encoder(spec)

        def work(chunk: pa.Table) -> pa.Table:
            flat, bounds = encoder.encode(texts_of(chunk.column("text")))
            ids = flat.tolist()
            decoded = [encoder.decode(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
            return pa.table({"doc_id": chunk.column("doc_id").cast(pa.int64()), "ids": lists, "decoded": pa.array(decoded, pa.string())})

        return work

    return map_texts(docs.select("doc_id", "text"), make, SCHEMA, chars=2_000_000)
