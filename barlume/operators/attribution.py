"""What each feature adds to a boosted model's margin for a row: Shapley values over the trees' paths.

A feature's part is its mean effect over all orders in which features become known,
where a split on an unknown one goes both ways by the shares of the training rows. A
leaf's value is reached with the product, over the features on its path, of 1 or 0 if
the feature is known, and of those shares if not; so each leaf gives its features closed
sums, by polynomials in the number of known ones, for a whole batch of rows at a time.
The parts of a row and the model's mean add up to its margin.

The model's nodes are a few numbers a node and go to the executors once; the rows pass
through an Arrow map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """A leaf's weighted value, and of each feature on its path the interval (low, high] that leads here and the share of rows that the splits on it let through."""

    value: float
    path: dict[int, tuple[float, float, float]]


def leaves_of(model) -> list[Leaf]:
    """The leaves of a fitted gradient-boosted model's trees, values weighted as in the margin."""
    out: list[Leaf] = []

    def walk(node, weight: float, path: dict[int, tuple[float, float, float]]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "LeafNode":
            out.append(Leaf(weight * node.prediction(), path))
            return
        split = node.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("only splits of continuous features are attributed")
        f, at = split.featureIndex(), split.threshold()
        rows = [float(n.impurityStats().count()) for n in (node, node.leftChild(), node.rightChild())]
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        walk(node.leftChild(), weight, path | {f: (low, min(high, at), share * rows[1] / rows[0])})
        walk(node.rightChild(), weight, path | {f: (max(low, at), high, share * rows[2] / rows[0])})

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        walk(tree._call_java("rootNode"), float(weight), {})
    return out


def mean_margin(leaves: Sequence[Leaf]) -> float:
    """The margin with no feature known."""
    return float(sum(leaf.value * np.prod([share for *_, share in leaf.path.values()]) for leaf in leaves))


def attributions(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """[rows, features]: each feature's part of the margin."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        names = list(leaf.path)
        m = len(names)
        known = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (low, high, _) in leaf.path.items()]
        shares = [share for *_, share in leaf.path.values()]
        weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
        for i, f in enumerate(names):
            # coefficients, by how many of the others are known, of the product of (share + known t)
            poly = np.zeros((m, len(x)))
            poly[0] = 1.0
            for j in range(m):
                if j != i:
                    poly[1:] = poly[1:] * shares[j] + poly[:-1] * known[j]
                    poly[0] = poly[0] * shares[j]
            out[:, f] += leaf.value * (known[i] - shares[i]) * (weights @ poly)
    return out


def explain(model, rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep…, base, margin, one column phi_<feature> each) for each row; base and all parts add up to the margin."""
    leaves = leaves_of(model)
    sent, base = rows.sparkSession.sparkContext.broadcast(leaves), mean_margin(leaves)  # as large as the model
    chosen = rows.select(*keep, *(F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(features)))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[: len(keep)]]
    schema = ", ".join([*kept, "base double", "margin double", *(f"`phi_{c}` double" for c in features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(features))]).astype(float)
            phi = attributions(sent.value, x)
            names = [*keep, "base", "margin", *(f"phi_{c}" for c in features)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.full(len(x), base)), pa.array(base + phi.sum(1)), *map(pa.array, phi.T)], names=names)

    return chosen.mapInArrow(run, schema)
