"""Linear-chain conditional random fields in numpy: fitting, forward-backward and Viterbi over many chains at once."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Features:
    """Feature numbers of many items, one after the other; item i has those from ``first[i]`` on, at least one."""

    flat: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(grid: np.ndarray) -> Features:
        """From one row per item, where -1 is no feature; the first column has none of those."""
        used = grid >= 0
        return Features(grid[used].astype(np.int64), np.concatenate([[0], np.cumsum(used.sum(1))[:-1]]).astype(np.int64))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.flat], self.first, axis=0) if len(self.first) else np.zeros((0, weights.shape[1]))


@dataclass
class Chain:
    """Weights of features per label, transition scores and scores of the first label."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray


def _padded(first: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each chain's items as rows, and which of them exist."""
    lengths = np.diff([*first, total])
    steps = np.arange(max(lengths, default=0))
    real = steps[None, :] < lengths[:, None]
    return np.where(real, first[:, None] + steps[None, :], 0), real


def fit(features: Features, items: np.ndarray, first: np.ndarray, labels: np.ndarray, n_labels: int, n_features: int, rounds: int = 60, rate: float = 0.08, ridge: float = 1e-5) -> Chain:
    """Maximum likelihood by Adam over all chains; expected counts come from forward-backward.

    ``items`` gives the features of each position, ``first`` where chains start.
    """
    size, total = n_features * n_labels, len(items)
    theta = np.zeros(size + n_labels * n_labels + n_labels)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    at, real = _padded(first, total)
    chains, length = at.shape
    truth = np.eye(n_labels)[labels]
    begins = np.zeros(total, bool)
    begins[first] = True
    follow = np.flatnonzero(~begins)
    moved = np.bincount(labels[follow - 1] * n_labels + labels[follow], minlength=n_labels**2).reshape(n_labels, n_labels)
    counts = np.diff([*features.first, len(features.flat)])
    for step in range(1, rounds + 1):
        weights = theta[:size].reshape(n_features, n_labels)
        moves = np.exp(theta[size:-n_labels].reshape(n_labels, n_labels))
        scores = features.sums(weights)[items]
        local = np.exp(scores - scores.max(1, keepdims=True))[at]
        alpha, beta = np.empty((2, chains, length, n_labels))
        alpha[:, 0] = np.exp(theta[-n_labels:]) * local[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            alpha[:, t] = (alpha[:, t - 1] @ moves) * local[:, t]
            alpha[:, t] /= alpha[:, t].sum(1, keepdims=True)
        beta[:, -1] = 1
        expected = np.zeros((n_labels, n_labels))
        for t in range(length - 2, -1, -1):
            ahead = local[:, t + 1] * beta[:, t + 1]
            beta[:, t] = np.where(real[:, t + 1, None], ahead @ moves.T, 1)
            beta[:, t] /= beta[:, t].sum(1, keepdims=True)
            joint = alpha[:, t, :, None] * moves * ahead[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True))[real[:, t + 1]].sum(0)
        gamma = (alpha * beta)[real]
        gamma /= gamma.sum(1, keepdims=True)
        off = truth - gamma
        by_item = np.column_stack([np.bincount(items, off[:, k], len(counts)) for k in range(n_labels)])
        spread = np.repeat(by_item, counts, axis=0)
        pull = np.column_stack([np.bincount(features.flat, spread[:, k], n_features) for k in range(n_labels)])
        grad = np.concatenate([pull.ravel(), (moved - expected).ravel(), off[first].sum(0)]) / total - ridge * theta
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad**2 - square)
        theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Chain(theta[:size].reshape(n_features, n_labels), theta[size:-n_labels].reshape(n_labels, n_labels), theta[-n_labels:])


def posteriors(chain: Chain, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label probabilities of every position by forward-backward, exact for chains of any length.

    All chains lie one behind the other; a chain's start forgets what stands
    before it. The row is cut into about its square root of strips, whose
    transfer matrices give the messages at the cuts, so that every step of
    the recursions runs over all strips at once. Messages are scaled every
    few steps, which is often enough: the largest factor of a step is one.
    """
    n, k = scores.shape
    if not n:
        return scores
    strips = max(1, int(2 * np.sqrt(n)))
    length = -(-n // strips)
    local = np.ones((strips * length, k))
    local[:n] = np.exp(scores - scores.max(1, keepdims=True))
    local[first] *= np.exp(chain.start - chain.start.max())
    begins = np.arange(strips * length) >= n
    begins[first] = True
    # Time comes first: what a step touches lies together.
    local = np.ascontiguousarray(local.reshape(strips, length, k).transpose(1, 0, 2))
    starts = [np.flatnonzero(row) for row in begins.reshape(strips, length).T]
    moves = np.exp(chain.moves - chain.moves.max())

    def scaled(message: np.ndarray, t: int) -> np.ndarray:
        return message / message.max(-1, keepdims=True) if t % 4 == 0 else message

    def forward(state: np.ndarray, t: int) -> np.ndarray:
        """``state``: (strips, k) messages."""
        out = state @ moves
        if len(starts[t]):
            out[starts[t]] = state[starts[t]].sum(1, keepdims=True)
        return out * local[t]

    # One message per strip and label at its start gives the rows of its transfer matrix; rows share their scale.
    transfer = np.tile(np.eye(k)[:, None, :], (1, strips, 1))
    for t in range(length):
        transfer = np.stack([forward(row, t) for row in transfer])
        if t % 4 == 0:
            transfer /= transfer.max((0, 2), keepdims=True)
    into, back = np.ones((strips, k)), np.ones((strips, k))
    for s in range(1, strips):
        into[s] = into[s - 1] @ transfer[:, s - 1]
        into[s] /= into[s].sum()
    for s in range(strips - 2, -1, -1):
        back[s] = transfer[:, s + 1] @ back[s + 1]
        back[s] /= back[s].sum()
    gamma = np.empty((length, strips, k))
    for t in range(length):
        into = scaled(forward(into, t), t)
        gamma[t] = into
    for t in range(length - 1, -1, -1):
        gamma[t] *= back
        ahead = local[t] * back
        back = ahead @ moves.T
        if len(starts[t]):
            back[starts[t]] = ahead[starts[t]].sum(1, keepdims=True)
        back = scaled(back, t)
    gamma = gamma.transpose(1, 0, 2).reshape(-1, k)[:n]
    return gamma / gamma.sum(1, keepdims=True)


def viterbi(chain: Chain, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Most likely labels of every position; of equally likely ones the lower label.

    Chains run side by side, those of similar length together, so that short
    chains are not padded to the longest one.
    """
    out = np.zeros(len(scores), np.int64)
    lengths = np.diff([*first, len(scores)])
    order = np.argsort(lengths, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 64)):
        part = part[lengths[part] > 0]
        if not len(part):
            continue
        steps = np.arange(lengths[part].max())
        real = steps[None, :] < lengths[part][:, None]
        local = np.where(real[..., None], scores[np.where(real, first[part][:, None] + steps, 0)], 0)
        best = chain.start + local[:, 0]
        back = np.zeros((*real.shape, scores.shape[1]), np.int64)
        for t in range(1, len(steps)):
            reach = best[:, :, None] + chain.moves
            back[:, t] = np.where(real[:, t, None], reach.argmax(1), np.arange(scores.shape[1]))
            best = np.where(real[:, t, None], reach.max(1) + local[:, t], best)
        label = best.argmax(1)
        for t in range(len(steps) - 1, -1, -1):
            rows = np.flatnonzero(real[:, t])
            out[first[part[rows]] + t] = label[rows]
            label = back[np.arange(len(part)), t, label]
    return out
