"""Costs, rates, estimates and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dollars per million tokens in, out, read from and written to the cache.
PRICE_IN, PRICE_OUT, PRICE_READ, PRICE_WRITE = 5.0, 25.0, 0.5, 6.25
Z95 = 1.96


def usage_cost(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, digits: int = 5) -> Column:
    parts = ((tokens_in, PRICE_IN), (tokens_out, PRICE_OUT), (cache_read, PRICE_READ), (cache_write, PRICE_WRITE))
    total = F.lit(0.0)
    for tokens, price in parts:
        total = total + F.coalesce(tokens, F.lit(0)) * F.lit(price)
    return F.round(total / F.lit(1e6), digits)


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of hits / n, within 0 to 1; (0, 0) for n = 0."""
    p = hits / n
    scale = 1 + F.lit(z * z) / n
    middle = p + F.lit(z * z / 2) / n
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z / 4) / (n * n))
    return (
        F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (middle - half) / scale)),
        F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (middle + half) / scale)),
    )


def daily_pay(salary: Column, least: float, most: float, digits: int = 2) -> Column:
    """Three months' salary over 90 days within bounds; null for none."""
    return F.when(salary > 0, F.round(F.least(F.greatest(salary * F.lit(3.0) / F.lit(90.0), F.lit(least)), F.lit(most)), digits))


def estimate(rate: Column, months: Column) -> Column:
    return F.when((months > 0) & rate.isNotNull(), F.bround(rate * months, 0))


def term_weight(df: Column, n: Column) -> Column:
    """Rarity weight: ln(1 + n / (1 + df)) / ln 21, at most 1.5, on a grid of 0.25 (half to even)."""
    raw = F.least(F.log(1 + n / (1 + df)) / F.log(F.lit(21.0)), F.lit(1.5))
    return F.bround(raw / F.lit(0.25), 0) * F.lit(0.25)
