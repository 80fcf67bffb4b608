"""A dense linear program solver with capped variables, and the mean-CVaR book it is for. Sizes: some names times scenarios, on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def primal_dual(c: np.ndarray, a: np.ndarray, b: np.ndarray, caps: np.ndarray = np.zeros(0), rounds: int = 100, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """min c.x with a x = b, x >= 0 and its first variables at most ``caps``, by an interior point method with predictor and corrector: x and the prices of the rows of ``a``.

    Caps are rows with a slack each. They are eliminated from every system, so memory and time grow with the variables, not with their square.
    """
    m, n, k = *a.shape, len(caps)
    capped = a[:, :k]

    def times(x: np.ndarray) -> np.ndarray:
        return np.concatenate([a @ x[:n], x[:k] + x[n:]])

    def back(y: np.ndarray) -> np.ndarray:
        out = np.concatenate([a.T @ y[:m], y[m:]])
        out[:k] += y[m:]
        return out

    def normal(d: np.ndarray, ridge: float = 0.0) -> Callable[[np.ndarray], np.ndarray]:
        """What solves (A D A') y = r for the rows of ``a`` and the caps."""
        top, whole = d[:k], d[:k] + d[n:]
        core = d[:n].copy()
        core[:k] *= d[n:] / whole
        factor = (a * core) @ a.T
        factor[np.diag_indices(m)] = factor[np.diag_indices(m)] * (1 + 1e-12) + ridge

        def solved(r: np.ndarray) -> np.ndarray:
            y = np.linalg.solve(factor, r[:m] - capped @ (top / whole * r[m:]))
            return np.concatenate([y, (r[m:] - top * (capped.T @ y)) / whole])

        def refined(r: np.ndarray) -> np.ndarray:
            y = solved(r)
            for _ in range(3):
                y = y + solved(r - times(d * back(y)))
            return y

        return refined

    c, b = np.concatenate([c, np.zeros(k)]), np.concatenate([b, caps])
    gram = normal(np.ones(n + k), 1e-12)
    x = back(gram(b))
    y = gram(times(c))
    s = c - back(y)
    x += max(-1.5 * x.min(), 0) + 1e-2
    s += max(-1.5 * s.min(), 0) + 1e-2
    x += 0.5 * (x @ s) / s.sum()
    s += 0.5 * (x @ s) / x.sum()

    def longest(v: np.ndarray, dv: np.ndarray) -> float:
        down = dv < 0
        return min(1.0, float((-v[down] / dv[down]).min())) if down.any() else 1.0

    best = (np.inf, x, y)
    for _ in range(rounds):
        primal, dual, gap = b - times(x), c - back(y) - s, x @ s / len(x)
        off = max(np.abs(primal).max(), np.abs(dual).max(), 100 * gap)
        if off < best[0]:
            best = off, x, y
        if off < tolerance or off > 1e6 * best[0]:  # found, or lost again where rounding stops a flat program
            break
        d = x / s
        system = normal(d)

        def step(centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            dy = system(primal + times(d * dual - centre / s))  # noqa: B023
            ds = dual - back(dy)  # noqa: B023
            return (centre - x * ds) / s, dy, ds  # noqa: B023

        dx, dy, ds = step(-x * s)
        after = (x + longest(x, dx) * dx) @ (s + longest(s, ds) * ds) / len(x)
        dx, dy, ds = step(-x * s - dx * ds + (after / gap) ** 3 * gap)
        x = x + 0.99995 * longest(x, dx) * dx
        t = 0.99995 * longest(s, ds)
        y, s = y + t * dy, s + t * ds
        x, s = np.maximum(x, 1e-14), np.maximum(s, 1e-14)
    off, x, y = best
    if np.abs(b - times(x)).max() > 1e-6:
        raise ValueError("the linear program has no feasible solution")
    return x[:n], y[:m]


def solve(c: np.ndarray, a: np.ndarray, b: np.ndarray, rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """min c.x with a x = b, x >= 0."""
    return primal_dual(c, a, b, rounds=rounds, tolerance=tolerance)[0]


def priced_cvar(
    returns: np.ndarray, mean: np.ndarray, *, beta: float = 0.95, risk_aversion: float = 1.0, max_position: float = 0.05, max_gross: float = 1.0, neutral: bool = True
) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Weights minimising CVaR less ``risk_aversion`` times expected return (scenarios in rows, names in columns), and the prices of the
    scenarios, of gross and of net exposure."""
    n_scenarios, n = returns.shape
    # x: long, short, alpha above its least value, tail losses, their slacks, gross slack
    width = 2 * n + 1 + 2 * n_scenarios + 1
    long, short, alpha, loss = slice(0, n), slice(n, 2 * n), 2 * n, slice(2 * n + 1, 2 * n + 1 + n_scenarios)
    unit = max_gross * float(np.abs(returns).max()) + 1e-6
    returns = returns / unit  # so that all rows are of one size; alpha and the losses are in units, alpha's least value is -1
    c = np.zeros(width)
    c[long], c[short] = -risk_aversion * mean, risk_aversion * mean
    c[alpha], c[loss] = unit, unit / ((1 - beta) * n_scenarios)
    a = np.zeros((n_scenarios + 1 + neutral, width))
    b = np.zeros(len(a))
    k = np.arange(n_scenarios)
    a[:n_scenarios, long], a[:n_scenarios, short] = returns, -returns
    a[:n_scenarios, alpha], b[:n_scenarios] = 1, 1
    a[k, loss.start + k], a[k, loss.stop + k] = 1, -1
    gross = n_scenarios
    a[gross, : 2 * n], a[gross, -1], b[gross] = 1, 1, max_gross
    if neutral:
        a[gross + 1, long], a[gross + 1, short] = 1, -1
    x, y = primal_dual(c, a, b, np.full(2 * n, max_position))
    w = x[long] - x[short]
    return np.where(np.abs(w) < 1e-9, 0.0, w), y[:n_scenarios] / unit, float(y[gross]), float(y[gross + 1]) if neutral else 0.0


def mean_cvar(returns: np.ndarray, mean: np.ndarray, **limits) -> np.ndarray:
    """The weights of ``priced_cvar``."""
    return priced_cvar(returns, mean, **limits)[0]
