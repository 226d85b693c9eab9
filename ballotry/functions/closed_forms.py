"""Closed forms of majority accuracy and operating points as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tail(pmf: Column, k: int) -> Column:
    """Probability of more than half of k, half of the tie, from an array of k + 1 probabilities."""
    weighed = F.transform(pmf, lambda p, i: F.when(2 * i > k, p).when(2 * i == k, 0.5 * p).otherwise(F.lit(0.0)))
    return F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x)


def _from_ratios(first: Column, ratio, k: int) -> Column:
    """Probabilities p0, p0 r0, p0 r0 r1, ... as one array."""
    step = lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) * ratio(i.cast("double"))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array(first), step)


def binomial_majority(k: int, p: Column) -> Column:
    """Majority accuracy of k independent votes; null outside (0, 1)."""
    ratio = lambda i: (F.lit(float(k)) - i) / (i + 1) * p / (1 - p)
    return F.when((p > 0) & (p < 1), _tail(_from_ratios(F.pow(1 - p, F.lit(float(k))), ratio, k), k))


def beta_binomial_majority(k: int, p: Column, c: Column) -> Column:
    """Majority accuracy of k votes with accuracy p and pair correlation c; null outside (0, 1)."""
    a, b = p * (1 - c) / c, (1 - p) * (1 - c) / c
    # P(0) = prod (b + i) / (a + b + i)
    first = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda s, i: s * (b + i) / (a + b + i))
    ratio = lambda i: (F.lit(float(k)) - i) / (i + 1) * (a + i) / (b + F.lit(float(k)) - i - 1)
    return F.when((p > 0) & (p < 1) & (c > 0) & (c < 1), _tail(_from_ratios(first, ratio, k), k))


def k_star(c: Column, eps: Column) -> Column:
    """Votes after which more gain less than eps: ceil((sqrt((1 - c) / eps) - 1) / c + 1); 1 where c isn't in (0, 1)."""
    value = F.ceil(F.round((F.sqrt((1 - c) / eps) - 1) / c + 1, 9))  # rounding noise adds no vote
    return F.when((c > 0) & (c < 1), F.greatest(value, F.lit(1))).otherwise(F.lit(1)).cast("long")


def k_star_clipped(c: Column, eps: Column, most: int = 32) -> Column:
    """The same with c clipped to [0.05, 0.99] and the result to 1..most; null c gives 1."""
    x = F.greatest(F.lit(0.05), F.least(F.lit(0.99), c))
    value = F.ceil(F.round((F.sqrt((1 - x) / eps) - 1) / x + 1, 9))
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(most), value)), F.lit(1)).cast("long")


def repay_queries(k: Column, pilot: int = 400, most: int = 32) -> Column:
    """Queries after which a pilot of so many samples pays; null if nothing is saved."""
    return F.when(k < most, F.ceil(F.lit(float(pilot)) / (most - k))).cast("long")
