"""Linear-chain conditional random fields on dense features, for many sequences at once.

Sequences lie one after another in an array; work goes through them step by step over all sequences that are still running, so it
takes as many numpy calls as the longest sequence has items, and time in proportion to the number of items.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


class Batch:
    """Which items stand at step 0, 1, ... of the sequences of the given lengths, longest first."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        self.lengths, self.starts = lengths, starts
        self.heads = starts[order]
        longest = int(lengths.max()) if len(lengths) else 0
        self.running = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        self.total = int(lengths.sum())

    def steps(self):
        for t, k in enumerate(self.running.tolist()):
            yield t, self.heads[:k] + t

    def back(self):
        for t in range(len(self.running) - 1, -1, -1):
            yield t, self.heads[: int(self.running[t])] + t

    def last(self) -> np.ndarray:
        out = np.zeros(self.total, bool)
        out[(self.starts + self.lengths - 1)[self.lengths > 0]] = True
        return out


@dataclass
class Chain:
    weights: np.ndarray  # features x states
    moves: np.ndarray  # states x states
    first: np.ndarray  # states

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.weights.astype(x.dtype, copy=False)).astype(np.float64, copy=False)


def marginals(e: np.ndarray, chain: Chain, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward: state marginals, scaled forward and backward values, and the sum of the log partition functions."""
    top = e.max(1, keepdims=True) if len(e) else e
    p = np.exp(e - top)
    shift = chain.moves.max()
    moves = np.exp(chain.moves - shift)
    forward, scale = np.empty_like(p), np.ones(len(p))
    for t, at in batch.steps():
        a = p[at] * (np.exp(chain.first)[None, :] if t == 0 else forward[at - 1] @ moves)
        s = a.sum(1)
        scale[at] = s
        forward[at] = a / s[:, None]
    backward = np.ones_like(p)
    ends = batch.last()
    for _, at in batch.back():
        at = at[~ends[at]]
        if len(at):
            backward[at] = (p[at + 1] * backward[at + 1]) @ moves.T / scale[at + 1][:, None]
    both = forward * backward
    total = both.sum(1, keepdims=True)
    np.divide(both, total, out=both, where=total > 0)
    n_moves = batch.total - int((batch.lengths > 0).sum())
    return both, forward, backward * p / scale[:, None], float(np.log(scale).sum() + top.sum() + shift * n_moves)


def viterbi(e: np.ndarray, chain: Chain, batch: Batch) -> np.ndarray:
    """The best state of every item; of equal scores the lower state."""
    score, came = np.empty_like(e), np.zeros(e.shape, np.int64)
    for t, at in batch.steps():
        if t == 0:
            score[at] = e[at] + chain.first
        else:
            by = score[at - 1][:, :, None] + chain.moves[None]
            came[at] = by.argmax(1)
            score[at] = e[at] + by.max(1)
    state = np.zeros(len(e), np.int64)
    ends = batch.last()
    for _, at in batch.back():
        end = ends[at]
        stop, go = at[end], at[~end]
        state[stop] = score[stop].argmax(1)
        state[go] = came[go + 1, state[go + 1]]
    return state


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 80, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    value, grad = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.abs(grad).sum()))
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        slope, step = float(grad @ q), 1.0
        if slope <= 0:
            q, slope = grad.copy(), float(grad @ grad)
        while True:
            new = x - step * q
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - new_value < tolerance * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


def fit(x: np.ndarray, states: np.ndarray, lengths: np.ndarray, n_states: int, l2: float = 1.0, weight: np.ndarray | None = None) -> Chain:
    """Maximum likelihood with an l2 penalty. The same rows in the same order give the same chain."""
    batch = Batch(lengths)
    n, f = x.shape
    ends = batch.last()
    inner = np.nonzero(~ends)[0]
    heads = batch.starts[batch.lengths > 0]
    hot = np.zeros((n, n_states))
    hot[np.arange(n), states] = 1
    seen_moves = np.zeros((n_states, n_states))
    np.add.at(seen_moves, (states[inner], states[inner + 1]), 1)
    seen_first = hot[heads].sum(0)

    def unpack(v: np.ndarray) -> Chain:
        a, b = f * n_states, f * n_states + n_states**2
        return Chain(v[:a].reshape(f, n_states), v[a:b].reshape(n_states, n_states), v[b:])

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        c = unpack(v)
        e = c.emissions(x)
        m, forward, ahead, logz = marginals(e, c, batch)
        got = float(e[np.arange(n), states].sum() + (seen_moves * c.moves).sum() + seen_first @ c.first)
        pair = forward[inner][:, :, None] * np.exp(c.moves - c.moves.max())[None] * ahead[inner + 1][:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
        grad = np.concatenate([(x.T @ (m - hot).astype(x.dtype, copy=False)).ravel(), (pair.sum(0) - seen_moves).ravel(), m[heads].sum(0) - seen_first])
        return logz - got + l2 / 2 * float(v @ v), grad + l2 * v

    return unpack(minimise(loss, np.zeros(f * n_states + n_states**2 + n_states)))
