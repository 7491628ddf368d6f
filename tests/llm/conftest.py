"""Small tables with every edge case: nulls, empty and long texts, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

import pytest

EXTRA = "score double, block int, copies string, place string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(rng: random.Random, n: int, stems: str = "ka lo mi ru te so va ne") -> str:
    return " ".join("".join(rng.choices(stems.split(), k=rng.randint(1, 3))) for _ in range(n))


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    """Documents in two languages: copies, near copies, shared passages, and the edge cases."""
    rng = random.Random(seed)
    shared = words(rng, 30)
    out = []
    for i in range(n):
        lang = "xx" if i % 2 else "yy"
        text = words(rng, rng.randint(20, 120), "ka lo mi ru te" if lang == "xx" else "öst ber ung ein sch")
        if i % 5 == 0:
            text = shared + "\n" + text
        out.append((i, text, lang, f"s{i % 3}"))
    for i in range(n, n + 12):  # copies and near copies of the first twelve
        text = out[i - n][1]
        if i % 2:
            parts = text.split(" ")
            for k in range(rng.randint(1, 3)):
                parts[rng.randrange(len(parts))] = f"neu{k}"
            text = " ".join(parts)
        out.append((i, text, out[i - n][2], "s0"))
    long = words(rng, 20_000)
    out += [(200, None, "xx", "s0"), (201, "", None, None), (202, " \t\n ", "xx", "s1"), (203, long, "xx", "s1"), (204, long + " ende", "xx", "s2"), (205, "eins", "yy", "s2"), (206, "EINS", "yy", None), (None, "ohne nummer", "yy", "s1")]
    out += [out[3], out[3]]
    return [(i, t, lang, s, len(t or ""), 1.0, 2, "x", "y") for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
