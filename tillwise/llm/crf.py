"""Linear-chain conditional random fields over many sequences at once.

A position has a fixed number of feature slots, each with a feature id; its
emission is the sum of the weights of its ids. Sequences stand one after the
other; all of them advance together, a step per position, so numpy works on
whole columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    weights: np.ndarray  # (feature ids, labels)
    moves: np.ndarray  # (labels, labels): from, to
    starts: np.ndarray  # (labels,)

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        out = self.weights[slots[:, 0]]
        for k in range(1, slots.shape[1]):
            out = out + self.weights[slots[:, k]]
        return out

    def decode(self, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels; ``first`` holds the borders of the sequences. Ties
        go to the smaller label."""
        n, labels = emissions.shape
        out = np.zeros(n, np.int8)
        order, base, active = _layout(first)
        if not len(active):
            return out
        back = np.zeros((n, labels), np.int8)
        now = self.starts + emissions[base]
        last = now.copy()
        for t in range(1, len(active)):
            m = active[t]
            at = base[:m] + t
            ways = now[:m, :, None] + self.moves[None]
            back[at] = ways.argmax(1)
            now = ways.max(1) + emissions[at]
            last[:m] = now
        label = last.argmax(1)
        length = np.diff(first)[order]
        end = base + length - 1
        out[end] = label
        # Walk back: sequences join as the step count reaches their length.
        for t in range(len(active) - 1, 0, -1):
            m = active[t]
            at = base[:m] + t
            out[at - 1] = back[at, out[at]]
        return out


def _layout(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty sequences, longest first; their first positions; how many
    sequences reach each step."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[: np.count_nonzero(length)]
    if not len(order):
        return order, first[:0], np.zeros(0, np.int64)
    longest = length[order]
    steps = np.arange(longest[0])
    active = np.searchsorted(-longest, -steps, side="left")
    return order, first[:-1][order], active


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _marginals(chain: Chain, emissions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities per position, expected moves and starts (forward-backward)."""
    n, labels = emissions.shape
    order, base, active = _layout(first)
    alpha, beta = np.zeros((n, labels)), np.zeros((n, labels))
    alpha[base] = chain.starts + emissions[base]
    for t in range(1, len(active)):
        at = base[: active[t]] + t
        alpha[at] = _log_sum(alpha[at - 1][:, :, None] + chain.moves[None], 1) + emissions[at]
    moves = np.zeros((labels, labels))
    end = base + np.diff(first)[order] - 1
    total = np.zeros(n)
    z = _log_sum(alpha[end], 1)
    total[base] = z
    for t in range(len(active) - 1, 0, -1):
        m = active[t]
        at = base[:m] + t
        ahead = (emissions[at] + beta[at])[:, None, :] + chain.moves[None]
        beta[at - 1] = _log_sum(ahead, 2)
        moves += np.exp(alpha[at - 1][:, :, None] + ahead - z[:m, None, None]).sum(0)
    whole = np.zeros(n)
    whole[np.concatenate([np.arange(b, e + 1) for b, e in zip(base, end, strict=True)])] = np.repeat(z, end - base + 1)
    marginal = np.exp(alpha + beta - whole[:, None])
    return marginal, moves, marginal[base].sum(0)


def fit(slots: np.ndarray, labels: np.ndarray, first: np.ndarray, n_ids: int, n_labels: int, epochs: int = 40, rate: float = 0.3, penalty: float = 1e-3, forbidden: tuple[tuple[int, int], ...] = (), not_first: tuple[int, ...] = ()) -> Chain:
    """Maximise the conditional log-likelihood (L2 penalty) with adaptive
    full-batch gradient steps. Forbidden moves keep a weight of -1e6. Without
    positions, all weights are zero, which decodes to label 0."""
    chain = Chain(np.zeros((n_ids, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    for a, b in forbidden:
        chain.moves[a, b] = -1e6
    for a in not_first:
        chain.starts[a] = -1e6
    if not len(labels):
        return chain
    sequences = np.count_nonzero(np.diff(first))
    gold = np.zeros((len(labels), n_labels))
    gold[np.arange(len(labels)), labels] = 1
    inner = np.ones(len(labels), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    gold_moves = np.zeros((n_labels, n_labels))
    at = np.flatnonzero(inner)
    np.add.at(gold_moves, (labels[at - 1], labels[at]), 1)
    gold_starts = np.bincount(labels[~inner], minlength=n_labels).astype(float)
    parts = [chain.weights, chain.moves, chain.starts]
    first_moment, second_moment = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    for epoch in range(1, epochs + 1):
        marginal, moves, starts = _marginals(chain, chain.emissions(slots), first)
        surplus = gold - marginal
        gradient = np.zeros_like(chain.weights)
        for k in range(slots.shape[1]):
            for c in range(n_labels):
                gradient[:, c] += np.bincount(slots[:, k], surplus[:, c], n_ids)
        slopes = [gradient / sequences - penalty * chain.weights, (gold_moves - moves) / sequences, (gold_starts - starts) / sequences]
        for a, b in forbidden:
            slopes[1][a, b] = 0
        for a in not_first:
            slopes[2][a] = 0
        for value, slope, m, v in zip(parts, slopes, first_moment, second_moment, strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return chain
