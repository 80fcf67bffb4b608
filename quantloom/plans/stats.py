"""Scalar statistics and calendars that run on the driver: p-values, the multiple-testing guard, splits."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if abs(c * d - 1) < 3e-12:
            break
    return front * (value - 1)


def two_sided_t(t: float, df: float) -> float:
    """Two-sided p-value of Student's t; 1 without degrees of freedom."""
    if df <= 0 or t == 0:
        return 1.0
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_statistic(mean: float, std: float, n: int) -> tuple[float, float]:
    """t and p of a mean; without deviation t is infinite (its sign the mean's, minus for 0) and p 0."""
    if n < 2:
        return 0.0, 1.0
    if std == 0:
        return (math.inf if mean > 0 else -math.inf), 0.0
    t = mean / (std / math.sqrt(n))
    return t, two_sided_t(t, n - 1)


def expected_max_normal(n: int) -> float:
    """About the largest of n standard normal draws; 0 for one."""
    if n < 1:
        raise ValueError(f"n must be at least 1, got {n}")
    if n == 1:
        return 0.0
    root = math.sqrt(2 * math.log(n))
    return root - (math.log(math.log(n)) + math.log(4 * math.pi)) / (2 * root)


def multiple_testing_guard(mean_ic: float, ic_std: float, n: int, p: float, n_trials: int, alpha: float = 0.05) -> dict:
    """Bonferroni, and the mean against the best that chance would give among the trials; all must hold."""
    adjusted = min(1.0, p * n_trials)
    chance = ic_std / math.sqrt(n) * expected_max_normal(n_trials) if n else 0.0
    reasons = []
    if not adjusted < alpha:
        reasons.append(f"adjusted p {adjusted:.4g} not under {alpha}")
    if not mean_ic > chance:
        reasons.append(f"mean IC {mean_ic:.4g} not over {chance:.4g} by chance")
    if not mean_ic > 0:
        reasons.append("mean IC not positive")
    return {"adjusted_p": adjusted, "expected_max_ic": chance, "passed": not reasons, "reason": "; ".join(reasons)}


class SplitError(ValueError):
    """Dates that give no valid train and test windows."""


LEAST_WINDOW_DAYS = 21


@dataclass(frozen=True)
class Split:
    train: tuple[dt.date, dt.date]
    test: tuple[dt.date, dt.date]
    embargo_days: int


def train_test_split(start: dt.date, end: dt.date, test_fraction: float = 0.3, embargo_days: int = 30) -> Split:
    """The last part of the span for testing, an embargo before it, the rest for training."""
    if not 0 < test_fraction < 1 or embargo_days < 0 or end <= start:
        raise SplitError("fraction, embargo or dates out of range")
    test_start = end - dt.timedelta(days=round((end - start).days * test_fraction))
    train_end = test_start - dt.timedelta(days=embargo_days + 1)
    for a, b in ((start, train_end), (test_start, end)):
        if (b - a).days < LEAST_WINDOW_DAYS:
            raise SplitError(f"window {a} to {b} is under {LEAST_WINDOW_DAYS} days")
    return Split((start, train_end), (test_start, end), embargo_days)


def out_of_sample(train_max: dt.date | None, test_min: dt.date | None, embargo_days: int = 0) -> bool:
    """Whether testing starts after training with so many days between; an empty side passes."""
    if train_max is None or test_min is None:
        return True
    return test_min > train_max and (test_min - train_max).days - 1 >= embargo_days


def optimal_weights(names: list[str], mean: np.ndarray, covariance: np.ndarray, n_days: int) -> dict[str, float]:
    """covariance^-1 mean, scaled to absolute sum 1; equal weights when that isn't defined."""
    if not names:
        return {}
    equal = dict.fromkeys(names, 1 / len(names))
    if n_days < 2:
        return equal
    try:
        w = np.linalg.solve(covariance, mean)
    except np.linalg.LinAlgError:
        return equal
    size = np.abs(w).sum()
    return dict(zip(names, (w / size).tolist(), strict=True)) if size > 0 and np.isfinite(size) else equal


def select_signals(priority: list[str], correlation: dict[tuple[str, str], float], most: float = 0.5) -> tuple[list[str], dict[str, str]]:
    """Greedy by priority: a signal is dropped when it correlates by ``most`` or more with one that is kept."""
    kept, dropped = [], {}
    for name in priority:
        clash = next((k for k in kept if abs(correlation.get((min(k, name), max(k, name)), 0.0)) >= most), None)
        if clash is None:
            kept.append(name)
        else:
            dropped[name] = clash
    return kept, dropped
