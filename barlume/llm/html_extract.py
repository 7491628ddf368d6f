"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

Blocks have features of their ancestors' tags and class, id and role words,
and of their text: length, links, marks, place. The field is trained on
labelled pages (``html_pages``: made from a seed, in many layouts) and decoded
by Viterbi; the blocks that it marks as article are joined by line breaks.

Scripts, styles, comments, the head, form controls and markup are never
blocks. Edge cases: a null or empty page gives an empty text, as does one
without an article; repeated rows are read alike; pages of any length are read
whole; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barlume.llm import crf
from barlume.llm.common import map_texts, texts_of
from barlume.llm.html_blocks import ANCESTORS, TAGS, WORDS, Block, blocks
from barlume.llm.html_pages import labelled

TRAIN_PAGES = 700
SCHEMA = "page_id long, url string, text string, n_chars long"
# bits by kind: some names are both a tag and a word
_bits = lambda tags, words: sum(1 << TAGS.index(t) for t in tags.split()) | sum(1 << len(TAGS) + list(WORDS).index(w) for w in words.split())
_OFF = _bits("nav footer aside form dialog", "navigation side foot advert notice comment form share hidden")
_IN = _bits("article main", "content")
_BITS = np.arange(len(ANCESTORS), dtype=np.uint64)


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row for each block."""
    flat = [b for page in pages for b in page]
    if not flat:
        return np.zeros((0, len(ANCESTORS) + 21))
    mask = np.array([b.mask for b in flat], np.uint64)
    above = (mask[:, None] >> _BITS & np.uint64(1)).astype(float)
    off, in_ = (mask & np.uint64(_OFF)) > 0, (mask & np.uint64(_IN)) > 0
    size = np.array([len(b.text) for b in flat])
    words = np.array([b.text.count(" ") + 1 for b in flat])
    linked = np.array([b.linked for b in flat]) / np.maximum(1, size)
    ended = np.array([b.text[-1] in ".!?:\"'”»" for b in flat])
    marked = np.array(["©" in b.text or "·" in b.text for b in flat])
    heading = np.array([b.tag in ("h1", "h2", "h3") for b in flat])
    prose = np.array([b.tag in ("p", "h1", "h2", "blockquote", "pre") for b in flat])
    place = np.concatenate([(np.arange(len(p)) + 0.5) / len(p) for p in pages if p])
    more = [
        np.ones(len(flat)), off, in_, in_ & ~off, ~in_ & ~off, words <= 2, (words > 2) & (words <= 6), (words > 6) & (words <= 20), words > 20,
        linked > 0.3, linked > 0.8, ended, marked, heading, prose, prose & ~off & ~in_, off & in_, off & prose, off & ended, place < 0.15, place > 0.85,
    ]
    return np.concatenate((above, np.stack(more, 1).astype(float)), 1)


def fit(pages: list[tuple[list[Block], list[bool]]]) -> crf.Chain:
    pages = [p for p in pages if p[0]]
    labels = np.array([m for _, marks in pages for m in marks], int)
    return crf.train(features([p for p, _ in pages]), labels, np.array([len(p) for p, _ in pages], np.int64), rounds=300, penalty=1e-4)


@cache
def trained() -> crf.Chain:
    """The field that the query uses."""
    return fit(labelled(TRAIN_PAGES))


def main_texts(chain: crf.Chain, pages: list[str]) -> list[str]:
    read = [blocks(p) for p in pages]
    lengths = np.array([len(p) for p in read if p], np.int64)
    marks = crf.viterbi(chain, features(read), lengths).tolist()
    out, at = [], 0
    for page in read:
        out.append("\n".join(b.text for b, m in zip(page, marks[at : at + len(page)], strict=True) if m))
        at += len(page)
    return out


def extract(pages: DataFrame, chain: crf.Chain | None = None) -> DataFrame:
    """One row per page: page_id, url, text of its article, n_chars; see the module."""
    chain = chain or trained()

    def make():
        def work(chunk: pa.Table) -> pa.Table:
            texts = main_texts(chain, texts_of(chunk.column("html")))
            return pa.table({"page_id": chunk.column("page_id").cast(pa.int64()), "url": chunk.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

        return work

    return map_texts(pages.select("page_id", "url", "html"), make, SCHEMA, text_column="html")


assert len(TAGS) < len(ANCESTORS) <= 64
