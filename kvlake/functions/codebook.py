"""Codebooks for normally distributed values: the tables in use, and the design they come from."""

from __future__ import annotations

from math import erfc, exp, pi, sqrt

#: Reconstruction levels, to which stored codes refer.
LEVELS8 = (-2.1513, -1.34326, -0.755526, -0.244919, 0.244919, 0.755526, 1.34326, 2.1513)
LEVELS16 = (-2.7326, -2.0690, -1.6180, -1.2562, -0.9423, -0.6568, -0.3880, -0.1284, 0.1284, 0.3880, 0.6568, 0.9423, 1.2562, 1.6180, 2.0690, 2.7326)
#: Keys are clamped before their residual is taken.
CLAMP_K, CLAMP_V = 2.5, 2.75
FLOOR = 1e-8


def midpoints(levels: tuple[float, ...]) -> tuple[float, ...]:
    """The thresholds between codes: a value above m of them has code m."""
    return tuple((a + b) / 2 for a, b in zip(levels, levels[1:]))


def density(x: float) -> float:
    return exp(-x * x / 2) / sqrt(2 * pi)


def distribution(x: float) -> float:
    return erfc(-x / sqrt(2)) / 2


def truncated_mean(a: float, b: float) -> float:
    """The mean of a normal value known to lie between a and b; their middle where that is too unlikely."""
    mass = distribution(b) - distribution(a)
    return (density(a) - density(b)) / mass if mass > 1e-15 else (a + b) / 2


def quantile(p: float) -> float:
    """The inverse of `distribution`, by halving [-10, 10]; p is kept 1e-12 away from 0 and 1."""
    p = min(max(p, 1e-12), 1 - 1e-12)
    lo, hi = -10.0, 10.0
    for _ in range(120):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if distribution(mid) < p else (lo, mid)
    return (lo + hi) / 2


def lloyd_max(n: int, rounds: int = 50, tolerance: float = 1e-12, support: float = 6.0) -> tuple[float, ...]:
    """Levels that each are the mean of the values nearest to them, from the quantiles of n equal parts. Eight levels after
    50 rounds give LEVELS8; sixteen give LEVELS16 when run until they stand still."""
    levels = [quantile((i + 0.5) / n) for i in range(n)]
    for _ in range(rounds):
        edges = [-support, *midpoints(tuple(levels)), support]
        new = [truncated_mean(a, b) for a, b in zip(edges, edges[1:])]
        moved = max(abs(a - b) for a, b in zip(levels, new))
        levels = new
        if moved < tolerance:
            break
    return tuple(levels)
