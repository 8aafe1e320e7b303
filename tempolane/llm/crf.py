"""A linear-chain conditional random field with two labels (0 bad, 1 good) over many sequences at once.

Weights give a line's log odds of being good from its features; a 2 x 2 table scores neighbouring labels. Sequences are laid
out as in :mod:`tempolane.llm.hmm`: at each step the ones still running are a prefix.
"""

from __future__ import annotations

import numpy as np

from tempolane.llm.hmm import Layout


#: Stronger than the penalty of the weights: lines of one text share a label in the training data, which must not excuse weak weights.
TABLE_PENALTY = 0.03


def marginals(odds: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line the probability of good; expected numbers of neighbouring labels; first labels; log partition sums."""
    layout = Layout(np.arange(len(odds)), starts)
    good = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
    local = np.stack([1 - good, good], 1)
    # Each line's potentials are scaled to sum to one; the sum of these scales comes back into the partition sum.
    move = np.exp(table)
    alphas, scales, pairs = [], [], np.zeros((2, 2))
    logs = np.zeros(len(layout.order))
    for t in range(layout.steps):
        n = layout.active[t]
        alpha = local[layout.at(t)] * (0.5 if t == 0 else alphas[-1][:n] @ move)
        scale = alpha.sum(1)
        alphas.append(alpha / scale[:, None])
        scales.append(scale)
        logs[:n] += np.log(scale)
    out, beta = np.zeros(len(odds)), np.zeros((0, 2))
    for t in range(layout.steps - 1, -1, -1):
        now = np.ones((layout.active[t], 2))
        if len(beta):
            ahead = beta * local[layout.at(t + 1)] / scales[t + 1][:, None]
            now[: len(beta)] = ahead @ move.T
            pairs += alphas[t][: len(beta)].T @ ahead
        out[layout.at(t)] = alphas[t][:, 1] * now[:, 1]
        beta = now
    partition = np.zeros_like(logs)
    partition[layout.order] = logs
    return out, pairs * move, good, partition


def fit(features: np.ndarray, starts: np.ndarray, label: np.ndarray, rounds: int, penalty: float, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and label table that maximise the mean conditional likelihood of the sequences less an L2 penalty (Adam)."""
    weights, table = np.zeros(features.shape[1]), np.zeros((2, 2))
    line_label = np.repeat(label, np.diff(starts))
    inner = np.maximum(np.diff(starts) - 1, 0)
    seen = np.diag([float(inner[label == 0].sum()), float(inner[label == 1].sum())])
    n = max(1, len(features))
    moment = [np.zeros_like(weights), np.zeros_like(table)]
    square = [np.zeros_like(weights), np.zeros_like(table)]
    for turn in range(1, rounds + 1):
        good, pairs, _, _ = marginals(features @ weights, starts, table)
        for k, grad in enumerate((features.T @ (line_label - good) / n - penalty * weights, (seen - pairs) / n - TABLE_PENALTY * table)):
            moment[k] = 0.9 * moment[k] + 0.1 * grad
            square[k] = 0.99 * square[k] + 0.01 * grad**2
            step = rate * (moment[k] / (1 - 0.9**turn)) / (np.sqrt(square[k] / (1 - 0.99**turn)) + 1e-9)
            if k:
                table = table + step
            else:
                weights = weights + step
    return weights, table
