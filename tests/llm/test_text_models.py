"""Quality rules, toxicity and language identification: brute force and held-out accuracy."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from barlume.llm import crf, langid, quality, toxicity
from barlume.llm.common import WORD
from tests.llm.conftest import DOCS, rows, words


def plain_counts(text: str | None) -> tuple:
    """The base counts, word by word."""
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {j for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    repeated = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered), failed


def junk(rng: random.Random) -> str:
    return "\n".join(" ".join(w + rng.choice(["###", "%%%", " |"]) for w in words(rng, 9).split()) for _ in range(9))


@pytest.fixture(scope="module")
def chain():
    rng = random.Random(5)
    good = [("\n".join(words(rng, 12) + "." for _ in range(7)), True) for _ in range(60)]
    bad = [(junk(rng), False) for _ in range(40)]
    return quality.fit_texts([t for t, _ in good + bad], [g for _, g in good + bad])


def test_quality_counts_and_verdict(spark, docs, none, chain):
    found = quality.quality_rules(docs, chain).collect()
    texts = {r[0]: r[1] for r in rows()}
    assert len(found) == docs.count()
    for r in found:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_counts(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    odd = ["a\nb\na\n\n a", "x y z x y z", "a a a a a", "#|<>", "\x0b\x0c \r\n", "ü ß x 😀", "a b c\n" * 60, None]
    for text, *want in zip(odd, *(quality.judge(chain, [t or "" for t in odd])[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), strict=True):
        assert tuple(want) == plain_counts(text), text
    rng = random.Random(6)
    good, bad = ["\n".join(words(rng, 12) + "." for _ in range(7)) for _ in range(30)], [junk(rng) for _ in range(30)]
    assert quality.judge(chain, good)["kept"].all() and not quality.judge(chain, bad)["kept"].any()
    assert quality.keep_good(docs, chain).columns == docs.columns
    assert quality.keep_good(none, chain).count() == 0 and quality.quality_rules(none, chain).count() == 0
    assert quality.judge(quality.fit_texts([], []), good)["kept"].all()


def test_fit_reads_labels(spark, docs):
    labels = spark.createDataFrame([(i, i % 3 > 0, 0, "t") for i in range(60)] + [(None, True, 1, "t"), (3, None, None, "t")], "doc_id long, quality boolean, toxic int, text string").selectExpr("doc_id", "cast(quality as int) quality", "toxic", "text")
    assert isinstance(quality.fit(docs, labels), crf.Chain)
    assert isinstance(quality.fit(docs, labels.limit(0)), crf.Chain)
    assert isinstance(toxicity.fit(docs, labels), toxicity.Model)


def test_viterbi_and_gradient_against_enumeration():
    rng = np.random.default_rng(2)
    model = crf.Chain(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = np.array([1, 4, 2, 5])
    x = rng.normal(size=(12, 3))
    labels = crf.viterbi(model, x, lengths)
    prob, pairs, _ = crf._forward_backward(model, x @ model.emit, lengths)
    at, expected = 0, np.zeros((2, 2))
    for n in lengths:
        part = x[at : at + n] @ model.emit
        score = {y: model.start[y[0]] + sum(part[t, y[t]] for t in range(n)) + sum(model.move[y[t - 1], y[t]] for t in range(1, n)) for y in itertools.product((0, 1), repeat=int(n))}
        assert tuple(labels[at : at + n]) == max(score, key=score.get)
        total = np.logaddexp.reduce(list(score.values()))
        for t in range(n):
            assert prob[at + t, 1] == pytest.approx(sum(np.exp(s - total) for y, s in score.items() if y[t]))
        for y, s in score.items():
            for t in range(1, n):
                expected[y[t - 1], y[t]] += np.exp(s - total)
        at += n
    np.testing.assert_allclose(pairs, expected)


def test_toxicity_learns_from_positives_and_unlabelled(spark, docs, none):
    rng = random.Random(8)
    bad = "grumpf snarlo".split()

    def text(toxic: bool) -> str:
        parts = words(rng, 60).split()
        for _ in range(3 if toxic else 0):
            parts.insert(rng.randrange(60), rng.choice(bad) + rng.choice(["", "a", "en"]))
        return " ".join(parts)

    positive, unlabelled = [text(True) for _ in range(80)], [text(i % 8 == 0) for i in range(400)]
    model = toxicity.fit_texts(positive, unlabelled, 1 / 8)
    held = [text(True) for _ in range(50)] + [text(False) for _ in range(200)]
    score = toxicity.score_texts(model, held)
    assert (score[:50] >= 0.5).mean() > 0.95 and (score[50:] < 0.5).all()
    assert ((0 <= score) & (score <= 1)).all()
    found = toxicity.toxicity(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert toxicity.toxicity(none, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert (toxicity.score_texts(toxicity.fit_texts([], [], 0.1), ["x", ""]) == pytest.approx(0.1))


def test_toxicity_of_a_small_source():
    rng = random.Random(3)
    word = lambda k: "".join(rng.choices("abcdefgh", k=k))
    plain, large, small = [word(6) for _ in range(2000)], [f"zz{word(6)}" for _ in range(10)], [f"yy{word(6)}" for _ in range(300)]

    def text(kind: str) -> str:
        return " ".join(rng.choices(plain, k=25) + rng.sample({"large": large, "small": small}.get(kind, plain), 3))

    positive = [text("small" if i % 20 == 0 else "large") for i in range(2000)]
    unlabelled = [text("plain") for _ in range(3000)]
    words = toxicity.choose_words(positive, unlabelled)
    assert {f"{w[:4]}*" for w in large} <= set(words)
    model = toxicity.fit_texts([f"{t} {small[0]}" if i < 20 else t for i, t in enumerate(positive)], unlabelled, 0.2)
    assert small[0] in model.words
    assert (toxicity.score_texts(model, [" ".join(rng.choices(plain, k=25) + [small[0], small[0]]) for _ in range(50)]) >= 0.5).mean() > 0.9
    assert "zzbad" in toxicity.choose_words(["zzbad a", "zzbad b", "c"], unlabelled)


def test_risk_and_slopes_against_plain_sums():
    """The non-negative risk and its gradient, term by term, and a step that climbs back."""
    rng = np.random.default_rng(4)

    def made(n: int) -> toxicity._Rows:
        dense = np.where(rng.random((n, 4)) < 0.5, rng.normal(size=(n, 4)), 0)
        row, col = np.nonzero(dense)
        return toxicity._Rows(n, 4, row, col, dense[row, col])

    def plain(x: toxicity._Rows) -> list[list[float]]:
        out = [[0.0] * 4 for _ in range(x.n)]
        for i, j, v in zip(x.row, x.col, x.value, strict=True):
            out[i][j] = v
        return out

    x_p, x_u, prior = made(7), made(11), 0.3
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def risks(theta) -> tuple[float, float]:
        g = lambda rows: [sum(a * b for a, b in zip(r, theta, strict=True)) for r in rows]
        p, u = g(plain(x_p)), g(plain(x_u))
        as_positive = sum(-np.log(sigmoid(z)) for z in p) / len(p)
        as_negative = sum(-np.log(1 - sigmoid(z)) for z in p) / len(p)
        return prior * as_positive, sum(-np.log(1 - sigmoid(z)) for z in u) / len(u) - prior * as_negative

    for theta in (rng.normal(size=4), np.zeros(4), np.array([3.0, -3.0, 2.0, 4.0])):
        kept, negative, pull, push = toxicity.risk_and_slope(x_p, x_u, theta, prior)
        assert (kept, negative) == pytest.approx(risks(theta))
        for j in range(4):
            step = np.eye(4)[j] * 1e-6
            up, down = risks(theta + step), risks(theta - step)
            assert (pull[j], push[j]) == (pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-5), pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-5))


def test_toxicity_of_empty_and_very_long_texts():
    model = toxicity.fit_texts([f"grumpf {i}" + "a" * i for i in range(30)], ["ab cd ef " + "b" * i for i in range(300)], 0.2)
    assert "grumpf" in model.words
    long = "ab cd ef " * 100_000
    score = toxicity.score_texts(model, ["", "½ 12", long, long + "grumpf"])
    assert ((0 <= score) & (score <= 1)).all() and score[0] == score[1] and score[3] > score[2]


def test_expectation_maximisation_against_enumeration():
    """Piece probabilities from all segmentations of each word, weighed by their probability."""
    pieces = sorted(["▁ab", "▁a", "b", "bc", "c", "▁", "abc"])
    counts = Counter({"abc": 3, "ab": 2, "xb": 1})

    def segmentations(text: str) -> list[list[int]]:
        if not text:
            return [[]]
        out = []
        for n in range(1, len(text) + 1):
            if text[:n] in pieces or n == 1:
                piece = pieces.index(text[:n]) if text[:n] in pieces else len(pieces)
                out += [[piece, *rest] for rest in segmentations(text[n:])]
        return out

    n, prob = len(pieces) + 1, np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
    for _ in range(4):
        p, seen = prob.copy(), np.zeros(n)
        p[-1] = langid._FLOOR
        for word, times in counts.items():
            ways = segmentations("▁" + word)
            weight = np.array([np.prod(p[w]) for w in ways])
            for w, share in zip(ways, weight / weight.sum(), strict=True):
                for x in w:
                    seen[x] += times * share
        prob = (seen + 0.1) / (seen.sum() + 0.1 * n)
    np.testing.assert_allclose(langid.learn(langid.Lattice(pieces), pieces, counts), prob)


def test_word_probability_sums_all_segmentations():
    pieces = sorted(["▁ab", "▁a", "b", "bc", "c", "▁", "abc"])
    prob = np.random.default_rng(1).uniform(0.01, 0.2, (len(pieces) + 1, 2))
    lattice = langid.Lattice(pieces)
    found = langid.word_scores(lattice, langid._lifted(pieces, prob), ["abc", "b", "x", "ab" * 20])

    def total(text: str, k: int) -> float:
        if not text:
            return 1.0
        out = 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in pieces:
                out += prob[pieces.index(text[:n]), k] * total(text[n:], k)
            elif n == 1:
                out += prob[-1, k] * total(text[n:], k)
        return out

    for i, w in enumerate(["abc", "b", "x"]):
        for k in range(2):
            assert found[i, k] == pytest.approx(np.log(total("▁" + w, k)))


def test_language_id(spark, docs, none):
    model = langid.fit(docs)
    assert model.langs == ["xx", "yy"]
    found = langid.identify(docs, model).collect()
    assert len(found) == docs.count()
    truth = {r[0]: (r[1], r[2]) for r in rows()}
    for r in found:
        text, lang = truth[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not (text or "").strip():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None and r["doc_id"] < 200:
            assert r["lang_pred"] == lang
    assert langid.identify(none, model).count() == 0
    assert langid.Judge(langid.fit(none)).predict(["abc"])[0] == ["und"]
    pred, score = langid.Judge(model).predict(["123 !?", "kalomi" * 2000])
    assert pred == ["und", "xx"] and 0.5 < score[1] <= 1
    assert langid.Judge(model).predict(["½ ² Ⅷ ٣ _ 😀", "½kalomi"])[0] == ["und", "xx"]
    lattice = langid.Lattice(model.pieces)
    for word in ("kalomi", "k", "öst" * 20):  # whole words of any length, in one way as in the other
        np.testing.assert_allclose(langid.long_word_score(lattice, model.prob, word), langid.word_scores(lattice, model.prob, [word])[0])
    long = langid.word_scores(lattice, model.prob, ["ka", "kalomi" * 3000, "lo"])
    assert np.isfinite(long).all() and (long[1] < 1000 * long[0]).all()
    odd = spark.createDataFrame([(i, None if i % 2 else f"sprache{i}", "wort", "x") for i in range(40)], "doc_id long, lang string, text string, score string")
    assert len(langid.fit(odd, most_languages=3).langs) == 3
    assert DOCS.startswith("doc_id")
