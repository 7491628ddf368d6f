"""A linear-chain conditional random field on dense feature rows, in numpy.

Sequences are runs of consecutive rows. Training maximises the penalised
conditional log-likelihood by Adam with exact gradients from a scaled
forward-backward pass; decoding is Viterbi. Both passes walk positions and
treat all sequences of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Emission weights [features, labels], transitions [from, to], start scores."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray


def _by_position(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from long to short, their first rows, and how many reach each position."""
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    long = lengths[order]
    reach = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")
    return order, first[order], reach


def viterbi(chain: Chain, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of every row. ``lengths`` are those of the sequences, all at least 1."""
    labels = np.zeros(len(rows), np.int8)
    if not len(rows):
        return labels
    score = rows @ chain.emit
    _, first, reach = _by_position(lengths)
    back = np.zeros(score.shape, np.int8)
    best = score[first] + chain.start
    for t in range(1, len(reach)):
        n = reach[t]
        paths = best[:n, :, None] + chain.move
        back[first[:n] + t] = paths.argmax(1)
        best[:n] = paths.max(1) + score[first[:n] + t]
    now = best.argmax(1)
    for t in range(len(reach) - 1, -1, -1):
        n = reach[t]
        at = first[:n] + t
        labels[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return labels


def _forward_backward(chain: Chain, score: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities of the rows, expected transitions, expected starts."""
    _, first, reach = _by_position(lengths)
    k = score.shape[1]
    local = np.exp(score - score.max(1, keepdims=True))
    move = np.exp(chain.move - chain.move.max())
    alpha, beta = np.zeros_like(local), np.ones_like(local)
    a = local[first] * np.exp(chain.start - chain.start.max())
    alpha[first] = a / a.sum(1, keepdims=True)
    for t in range(1, len(reach)):
        at = first[: reach[t]] + t
        a = (alpha[at - 1] @ move) * local[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(len(reach) - 1, 0, -1):
        at = first[: reach[t]] + t
        after = local[at] * beta[at]
        joint = alpha[at - 1][:, :, None] * move * after[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = after @ move.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    prob = alpha * beta
    prob /= prob.sum(1, keepdims=True)
    return prob, pairs, prob[first].sum(0)


def train(rows: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_labels: int = 2, rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Chain:
    """Fit a chain. Without rows all weights are zero."""
    chain = Chain(np.zeros((rows.shape[1], n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    n = len(rows)
    if not n:
        return chain
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    gold = np.eye(n_labels)[labels]
    gold_emit = rows.T @ gold
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    gold_move = np.zeros((n_labels, n_labels))
    np.add.at(gold_move, (labels[at - 1], labels[at]), 1)
    gold_start = gold[first].sum(0)
    params = [chain.emit, chain.move, chain.start]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        prob, pairs, begun = _forward_backward(chain, rows @ chain.emit, lengths)
        slopes = [(gold_emit - rows.T @ prob) / n, (gold_move - pairs) / n, (gold_start - begun) / n]
        for p, g, m, v in zip(params, slopes, mean, square, strict=True):
            g -= penalty * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return chain
