"""Exact top-k against a full scan."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from barlume.llm import topk


def brute(vectors: list[tuple[int, list[int]]], k: int) -> Counter:
    """Every row whose id is divisible by 50 against all other rows."""
    out = Counter()
    for r, (q, mine) in enumerate(vectors):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(mine, v, strict=False)), i) for c, (i, v) in enumerate(vectors) if c != r)[:k]
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1))
    return out


@pytest.mark.parametrize("block_rows", [10_000, 150, 40])
def test_against_a_full_scan(spark, block_rows, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_ROWS", 10)
    rng = np.random.default_rng(3)
    values = rng.normal(0, 0.2, (600, 16))
    values[100:300] = values[7]  # a large group of equal vectors, so ties
    rows = [(int(i), [float(np.float32(x)) for x in v], 0, "x") for i, v in enumerate(values)]
    rows += [(904, [0.5, -0.5], 0, "x"), rows[8], (8, rows[9][1], 0, "x"), rows[50], (50, rows[51][1], 0, "x"), (100, rows[52][1], 0, "x")]  # repeated rows, ids with several vectors
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows]
    rows += [(900, None, 0, "x"), (901, [1.0, None] + [0.0] * 14, 0, "x"), (902, [float("nan")] * 16, 0, "x"), (903, [float("inf")] * 16, 0, "x"), (None, [0.5] * 16, 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")
    found = topk.to_integers(df)
    assert sorted((r["vec_id"], r["v"]) for r in found.collect()) == sorted(ints)
    got = topk.nra_top_k(found, found.filter("vec_id % 50 = 0"), 5, block_rows).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(ints, 5)


def test_all_vectors_of_an_id_are_candidates(spark):
    rows = [(0, [1.0]), (3, [2.0]), (3, [9.0]), (4, [5.0])]
    found = topk.to_integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.nra_top_k(found, found.filter("vec_id % 50 = 0"), 5).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 589824), (0, 2, 4, 327680), (0, 3, 3, 131072)]


def watched(lists: topk.SortedLists) -> list:
    """(depth, lower, upper bounds) whenever a search looks at them."""
    seen, upper = [], lists._upper
    lists._upper = lambda low, ends, met, depth: seen.append((depth, low.copy(), upper(low, ends, met, depth))) or seen[-1][2]
    return seen


@pytest.mark.parametrize("scale", [1, 10_000, 100_000_000])
def test_bounds_hold(scale):
    """Upper and lower bounds enclose the scores at every depth, for each type of sum, and know of what was read only."""
    rng = np.random.default_rng(1)
    values = rng.integers(-9 * scale, 9 * scale, (200, 11))
    lists = topk.SortedLists(np.arange(200), np.arange(200), values)
    seen = watched(lists)
    queries = np.concatenate([values[7:9], rng.integers(-9 * scale, 9 * scale, (3, 11))])
    found = list(lists.search(np.array([7, 8, 990, 991, 992]), queries, 5))
    for c, ids, scores in found:
        score = values @ queries[c]
        score[7 + c if c < 2 else []] = -(1 << 62)
        assert ids.tolist() == np.argsort(-score, kind="stable")[:5].tolist() and scores.tolist() == score[ids].tolist()
    place = np.empty((200, 11), int)
    np.put_along_axis(place, lists.down, np.arange(200)[:, None], 0)
    down = lists.sorted
    assert seen
    for depth, low, high in seen:
        others = np.ones(200, bool)
        others[7:9] = False
        for c, q in enumerate(queries):
            met = np.where(q > 0, place < depth, place >= 200 - depth)
            least, next_one = np.where(q > 0, down[-1], down[0]), np.where(q > 0, down[depth], down[-1 - depth])
            assert (low[others, c] == (np.where(met, values, least) @ q)[others]).all() and (high[others, c] == (np.where(met, values, next_one) @ q)[others]).all()
            assert (low[others, c] <= (values @ q)[others]).all() and (high[others, c] >= (values @ q)[others]).all()


def test_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    empty = topk.to_integers(spark.createDataFrame([], schema))
    assert topk.nra_top_k(empty, empty).count() == 0
    two = topk.to_integers(spark.createDataFrame([(0, [1.0], 0), (50, [2.0], 0)], schema))
    assert [tuple(r) for r in topk.nra_top_k(two, two).orderBy("query_id").collect()] == [(0, 1, 50, 131072), (50, 1, 0, 131072)]


def test_reading_stops_early():
    """Clear winners are found without reading the lists to their ends."""
    rng = np.random.default_rng(0)
    values = rng.integers(-3, 4, (5000, 4))
    values[:6] = [[90, 80, 70, 60]] * 6
    lists = topk.SortedLists(np.arange(5000), np.arange(5000), values)
    seen = watched(lists)
    (_, ids, scores), = lists.search(np.array([9999]), np.array([[9, 8, 7, 6]]), 5)
    assert [depth for depth, *_ in seen] == [2500] and lists.read == values.size  # half of each list, from either end
    assert ids.tolist() == [0, 1, 2, 3, 4] and len(set(scores.tolist())) == 1


def test_entries_are_read_once():
    """Whatever the values, each end of a list is read at most once."""
    rng = np.random.default_rng(2)
    values = rng.normal(0, 40, (700, 24)).round().astype(int)
    lists = topk.SortedLists(np.arange(700), np.arange(700), values)
    list(lists.search(np.arange(64), values[:64], 5))
    assert values.size <= lists.read <= 2 * values.size
