"""Quantiles of the Poisson and binomial laws (plain numbers, used for parameters)."""

from __future__ import annotations

import math


def _quantile(p: float, masses) -> int:
    total = 0.0
    k = 0
    for k, mass in masses:
        total += mass
        if total >= p * (1.0 - 1e-12):
            break
    return k


def poisson_quantile(p: float, rate: float) -> int:
    """Smallest k with P(X <= k) >= p."""
    if rate == 0:
        return 0
    bound = int(rate + 40.0 * math.sqrt(rate) + 40)
    log_rate = math.log(rate)
    return _quantile(p, ((k, math.exp(k * log_rate - rate - math.lgamma(k + 1))) for k in range(bound)))


def binomial_quantile(p: float, n: int, prob: float) -> int:
    log_q, log_p = math.log1p(-prob), math.log(prob)
    choose = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return _quantile(p, ((k, math.exp(choose(k) + k * log_p + (n - k) * log_q)) for k in range(n + 1)))


def min_insertion_reads(coverage: float, floor: int = 6) -> int:
    """Reads an insertion call needs at this coverage."""
    return max(binomial_quantile(0.1, poisson_quantile(0.2, coverage), 0.5), floor)
