"""Searches against random draws, layers against all pairs, attributions against enumeration over subsets."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array

from barlume.operators import attribution as A
from barlume.operators import searching as S

SPACE = (S.Setting("a", 0, 100, True), S.Setting("b", -2, 2), S.Setting("c", 0, 1))


def gain(p: dict) -> float:
    return -(((p["a"] - 71) / 30) ** 2) - (p["b"] - 0.7) ** 2 - 3 * (p["c"] - 0.2) ** 2 + 0.1 * math.cos(9 * p["b"])


def aims(p: dict) -> tuple[float, float]:
    """A bent front: gain grows with a, cost too; b and c off their places only harm."""
    off = (p["b"] - 0.5) ** 2 + 2 * abs(p["c"] - 0.3)
    return p["a"] / 100 - off, (p["a"] / 100) ** 2 + off


def at_random(seed: int, n: int) -> list[dict]:
    r = random.Random(f"{seed}/plain")
    return [{s.name: s.draw(r) for s in SPACE} for _ in range(n)]


def area(found: list[tuple[float, float]]) -> float:
    """What lies below and right of the front, down to gain -1 and up to cost 2."""
    total, least = 0.0, 2.0
    for g, c in sorted(found, key=lambda x: (-x[0], x[1])):
        if c < least and g > -1:
            total += (least - c) * (g + 1)
            least = c
    return total


def test_density_search_beats_random_draws():
    better, means = 0, [0.0, 0.0]
    for seed in range(20):
        told = S.density_search(SPACE, lambda points: [gain(p) for p in points], 60, seed=seed)
        assert len(told) == 60 and all(s.low <= p[s.name] <= s.high for p, _ in told for s in SPACE) and all(isinstance(p["a"], int) for p, _ in told)
        own, plain = max(g for _, g in told), max(map(gain, at_random(seed, 60)))
        better += own > plain
        means = [means[0] + own / 20, means[1] + plain / 20]
    assert better >= 16 and means[0] > means[1] + 0.02, (better, means)
    again = [S.density_search(SPACE, lambda points: [gain(p) for p in points], 30, seed=3) for _ in "ab"]
    assert again[0] == again[1]


def test_search_survives_gains_that_are_no_numbers():
    told = S.density_search(SPACE, lambda points: [float("nan") if p["a"] < 50 else gain(p) for p in points], 40, seed=1)
    assert len(told) == 40 and sum(p["a"] >= 50 for p, _ in told[10:]) > 20
    assert len(S.front_search(SPACE, lambda points: [(float("nan"), 1.0)] * len(points), 20, size=8, seed=1)) == 20
    assert S.density_search(SPACE, lambda points: [1.0] * len(points), 3)[0][1] == 1.0


def test_front_search_beats_random_draws():
    better = 0
    for seed in range(20):
        told = S.front_search(SPACE, lambda points: [aims(p) for p in points], 96, size=16, seed=seed)
        assert len(told) == 96
        better += area([a for _, a in told]) > area([aims(p) for p in at_random(seed, 96)])
    assert better >= 18, better


@pytest.mark.parametrize("seed", range(8))
def test_layers_against_all_pairs(seed):
    r = random.Random(seed)
    found = [(float(r.randrange(6)), float(r.randrange(6))) for _ in range(40)]
    left, want, k = set(range(40)), {}, 0
    while left:
        top = {i for i in left if not any(found[j][0] >= found[i][0] and found[j][1] <= found[i][1] and found[j] != found[i] for j in left)}
        want |= dict.fromkeys(top, k)
        left -= top
        k += 1
    assert S.layers(found) == [want[i] for i in range(40)]


def test_loneliness():
    room = S.loneliness([(0.0, 0.0), (1.0, 1.0), (4.0, 4.0), (2.0, 2.0)], [0, 0, 0, 0])
    assert room[0] == room[2] == math.inf and room[1] == 1.0 and room[3] == 1.5


# --- attributions

def by_subsets(leaves: list[A.Leaf], x: np.ndarray, n: int) -> np.ndarray:
    """Shapley values from the margin with each subset of the features known."""
    def value(known: tuple[int, ...]) -> float:
        return sum(leaf.value * math.prod((float(low < x[f] <= high) if f in known else share) for f, (low, high, share) in leaf.path.items()) for leaf in leaves)

    out = np.zeros(n)
    for i in range(n):
        others = [f for f in range(n) if f != i]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            out[i] += weight * sum(value((*s, i)) - value(s) for s in combinations(others, size))
    return out


def test_attributions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)).round(2)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    df = spark.createDataFrame([(i, *map(float, row), float(label)) for i, (row, label) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, label double").repartition(3)
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=6, maxDepth=4, seed=1).fit(VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df))
    scored = model.transform(VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)).withColumn("own", vector_to_array("rawPrediction")[1])
    rows = A.explain(model, scored, list("abcd"), ["id", "own"]).collect()
    leaves = A.leaves_of(model)
    assert len(rows) == 400
    for r in rows:
        assert abs(r["margin"] - r["own"]) < 1e-9 and abs(r["base"] + sum(r[f"phi_{c}"] for c in "abcd") - r["margin"]) < 1e-9
    for r in rows[:40]:
        assert np.allclose([r[f"phi_{c}"] for c in "abcd"], by_subsets(leaves, x[r["id"]], 4), atol=1e-9)
