"""Ids of whole texts in the vocabularies of public tokenizers, as numpy arrays.

A byte-level file names its merges in the order of their ids, so a rank encoder
over the file's own entries gives the ids that the tokenizers library gives, at a
fraction of its time. The two part ways only on characters that one of their
Unicode tables doesn't know: a text that holds one goes to the library itself, as
does one that the rank encoder refuses.
"""

from __future__ import annotations

import json
import os
from functools import cache
from pathlib import Path

import numpy as np
import regex

from barlume.llm.bpe import LOWER, YOUNG, byte_alphabet

# Fixed value: the pattern that splits a text before the merges of byte-level files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_YOUNG = regex.compile(f"[{''.join(f'\\U{a:08x}-\\U{b:08x}' for a, b in YOUNG)}{''.join(map(chr, LOWER))}\\U00020000-\\U0010ffff]").search


def _unknown(text: str) -> bool:
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return _YOUNG(text) is not None


def joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one text after another, and where each text's begin and end."""
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))).astype(np.int64)
    return (np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)), bounds


class ByteLevel:
    """A byte-level file; ``special``: strings of special tokens inside texts give those tokens, else they are plain text."""

    def __init__(self, path: str, special: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        import tiktoken
        from tokenizers import Tokenizer

        raw = json.loads(Path(path).read_text())
        back = {c: b for b, c in enumerate(byte_alphabet())}
        added = {x["content"]: x["id"] for x in raw["added_tokens"]}
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in raw["model"]["vocab"].items() if t not in added}
        self.entries = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for entry, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.entries[i] = entry
        self.sizes = np.array([len(e) for e in self.entries], np.int64)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special
        self._ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added if special else {})
        self._special = set(added) if special else set()

    def _one(self, text: str) -> np.ndarray:
        if not _unknown(text):
            try:
                return self._ranked.encode_to_numpy(text, allowed_special=self._special, disallowed_special=())
            except ValueError:  # a run of white space beyond its stack
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined([self._one(t) for t in texts])


class Pieces:
    """A sentencepiece model; ``entries`` are the bytes of its pieces, U+2581 a space, <0xHH> the byte."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.entries = [bytes([int(n[3:-1], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.sizes = np.array([len(e) for e in self.entries], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined([np.array(x, np.int32) for x in self.library.encode(texts, num_threads=1)])


@cache
def byte_level(path: str, special: bool) -> ByteLevel:
    """One for each worker: reused tasks don't read the file again."""
    return ByteLevel(path, special)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)
