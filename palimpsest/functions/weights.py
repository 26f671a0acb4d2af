"""Weights of ranking, reinforcement and decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
ACTIVATION_DECAY, SUPERSEDED_FACTOR, HUB_DEGREE = 0.7, 0.5, 10
REINFORCE_RATE, STRENGTH_FLOOR, DECAY_RATE = 0.1, 0.1, 0.05
DECAY_PEAK_DAYS, DECAY_SIGMA_DAYS = 30.0, 15.0


def rrf(rank: Column, weight: Column | float = 1.0, k: int = RRF_K) -> Column:
    """Reciprocal rank with ranks from 0 (MATH-5)."""
    return F.lit(weight) / (F.lit(k) + rank + 1) if not isinstance(weight, Column) else weight / (F.lit(k) + rank + 1)


def hub_inhibition(degree: Column, hub: int = HUB_DEGREE) -> Column:
    """1 up to the hub degree, then 1 / (1 + 0.5 ln(1 + degree - hub)) (MATH-4)."""
    return F.when(degree <= hub, F.lit(1.0)).otherwise(1 / (1 + 0.5 * F.log1p(degree - hub)))


def mention_salience(mentions: Column) -> Column:
    """1 + 0.1 ln(1 + mentions - 1), 1 for none (MATH-6)."""
    return 1 + 0.1 * F.log1p(F.greatest(mentions - 1, F.lit(0)))


def reinforced(weight: Column, rate: Column | float = REINFORCE_RATE, floor: float = STRENGTH_FLOOR) -> Column:
    """A bounded step towards 1 (MATH-7)."""
    r = rate if isinstance(rate, Column) else F.lit(rate)
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), weight + r * (1 - weight)))


def staleness(days: Column, peak: float = DECAY_PEAK_DAYS, sigma: float = DECAY_SIGMA_DAYS) -> Column:
    """A Gaussian bell around the peak age (MATH-8)."""
    return F.exp(-((days - peak) * (days - peak)) / (2 * sigma * sigma))


def decayed(weight: Column, days: Column, rate: float = DECAY_RATE, floor: float = STRENGTH_FLOOR) -> Column:
    return F.greatest(F.lit(floor), weight * (1 - rate * staleness(days)))


def backoff(attempts: Column, base: float, cap: float) -> Column:
    """base, then doubled with each attempt, up to cap (MATH-12)."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempts - 1), F.lit(cap))


def decades(cost: Column) -> Column:
    """Divisor that grows by one with each power of ten of the cost (MATH-11)."""
    return 1 + F.log10(F.greatest(cost, F.lit(1.0)))


def bridge_score(coherence: Column, size_a: Column, size_b: Column, crossing: Column, isolation: Column) -> Column:
    """coherence x balance x (1 - overlap) x isolation, where overlap is the crossing edges over the smaller size (MATH-10)."""
    small, large = F.least(size_a, size_b), F.greatest(size_a, size_b)
    return coherence * (small / large) * (1 - F.least(F.lit(1.0), crossing / small)) * isolation


def seed_budget(population: Column, base: float = 10, growth: float = 2, cap: float = 32) -> Column:
    """Seeds by the logarithm of the population, between 1 and cap (AGG-21)."""
    return F.greatest(F.lit(1), F.least(F.lit(int(cap)), F.round(F.lit(float(base)) + growth * F.log(F.greatest(population, F.lit(1)))).cast("int")))
