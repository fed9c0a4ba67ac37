"""Forward and backward passes over many label chains at once, in lock step.

Chains of one call are sorted by length and laid out by time, so that step t is one matrix
product over all chains that are still running: a chain of n symbols costs n steps, whole, and
no chain is cut into windows.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Time-major order of chains with the given lengths (all at least 1)."""

    def __init__(self, lengths: np.ndarray):
        self.rank = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.rank]
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][self.rank]
        n = int(lengths.sum())
        first = np.concatenate([[0], np.cumsum(ordered)])[:-1]
        within = np.arange(n) - np.repeat(first, ordered)
        flat = np.repeat(starts, ordered) + within
        longest = int(ordered[0]) if len(ordered) else 0
        by_time = np.argsort(within.astype(np.uint16) if longest <= 65536 else within, kind="stable")
        self.order = flat[by_time]  # position t of every chain, then t + 1, ...
        self.active = np.bincount(within, minlength=longest).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        self.last = self.offset[ordered - 1] + np.arange(len(ordered)) if len(ordered) else np.zeros(0, np.int64)


def log_likelihood(layout: Layout, symbols: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Scaled forward recursion: log10 of each chain's probability, in the chains' own order."""
    total = np.zeros(len(layout.rank))
    seen = symbols[layout.order]
    a = None
    block = 1 << 16
    held, low = None, 0
    for t, m in enumerate(layout.active):
        o = layout.offset[t]
        if held is None or o + m > low + len(held):
            low, held = o, emit[seen[o : o + max(block, m)]]
        e = held[o - low : o - low + m]
        a = (start * e) if a is None else (a[:m] @ move) * e
        scale = a.sum(axis=1)
        a /= scale[:, None]
        total[:m] += np.log10(scale)
    out = np.empty(len(total))
    out[layout.rank] = total
    return out


def posteriors(layout: Layout, e: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: state posteriors (time-major) and expected moves.

    `e` holds the emission weights of each position in time-major order.
    """
    n, k = e.shape
    alpha = np.empty_like(e)
    scale = np.empty(n, e.dtype)
    a = None
    for t, m in enumerate(layout.active):
        o = layout.offset[t]
        a = start * e[o : o + m] if a is None else (a[:m] @ move) * e[o : o + m]
        c = a.sum(axis=1)
        a /= c[:, None]
        alpha[o : o + m] = a
        scale[o : o + m] = c
    moves = np.zeros((k, k))
    back = np.ascontiguousarray(move.T)
    steps = len(layout.active)
    if steps:
        b = np.ones((int(layout.active[-1]), k), e.dtype)
        for t in range(steps - 2, -1, -1):
            o, p, m, q = layout.offset[t], layout.offset[t + 1], int(layout.active[t]), int(layout.active[t + 1])
            w = e[p : p + q] * b
            w /= scale[p : p + q, None]
            moves += alpha[o : o + q].T @ w
            alpha[p : p + q] *= b
            b = np.ones((m, k), e.dtype)
            b[:q] = w @ back
        alpha[: len(b)] *= b
    return alpha, moves * move
