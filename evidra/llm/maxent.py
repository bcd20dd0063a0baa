"""Hashed logistic regression (maximum entropy with two classes), fitted in numpy on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit(rows: list[np.ndarray], y: np.ndarray, dim: int, *, strength: float = 1.0, rounds: int = 80, times: np.ndarray | None = None) -> np.ndarray:
    """Weights of length ``dim``. ``rows``: the indices of each example's active features (repeats count); index 0 is the bias.
    ``times``: how often each example counts, once if not given.

    Mean logistic loss plus ``strength / (2 n)`` times the squared weights, minimised by L-BFGS: the
    result depends on nothing but the examples. Without examples of both classes only the bias is set.
    """
    w = np.zeros(dim)
    y = np.asarray(y, dtype=float)
    n = len(y)
    if not n:
        return w
    if y.min() == y.max():
        w[0] = 5.0 if y[0] else -5.0
        return w
    times = np.ones(n) if times is None else np.asarray(times, dtype=float)
    whole = times.sum()
    sizes = np.fromiter((len(r) for r in rows), dtype=np.int64, count=n)
    flat, owner = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(n), sizes)
    used, local = np.unique(np.concatenate([[0], flat]), return_inverse=True)
    local, m = local[1:], len(used)

    def value(v: np.ndarray) -> tuple[float, np.ndarray]:
        z = v[0] + np.bincount(owner, weights=v[local], minlength=n)
        loss = float(times @ (np.logaddexp(0, z) - y * z)) / whole + strength / (2 * whole) * float(v[1:] @ v[1:])
        d = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * times / whole
        g = np.bincount(local, weights=d[owner], minlength=m) + strength / whole * v
        g[0] = d.sum()
        return loss, g

    v, steps, turns = np.zeros(m), [], []
    loss, g = value(v)
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, t in zip(reversed(steps), reversed(turns)):
            a = (s @ q) / (t @ s)
            q -= a * t
            kept.append(a)
        if steps:
            q *= (steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
        else:
            q *= 1 / max(1e-12, float(np.abs(g).max()))
        for s, t, a in zip(steps, turns, reversed(kept)):
            q += (a - (t @ q) / (t @ s)) * s
        rate, slope = 1.0, float(g @ q)
        while rate > 1e-6:
            new = v - rate * q
            new_loss, new_g = value(new)
            if new_loss <= loss - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, t = new - v, new_g - g
        if t @ s > 1e-14:
            steps, turns = [*steps[-7:], s], [*turns[-7:], t]
        done = loss - new_loss < 1e-7
        v, loss, g = new, new_loss, new_g
        if done:
            break
    w[used] = v
    return w
