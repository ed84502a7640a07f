"""Scoring formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed normal quantiles; any other confidence level uses the first.
Z_VALUES = {0.95: 1.96, 0.90: 1.645, 0.99: 2.576}


def wilson_bounds(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; (0, 1) where nothing was seen."""
    z = Z_VALUES.get(round(confidence, 2), 1.96)
    total = n.cast("double")
    share = successes / total
    spread = F.lit(z * z) / total
    middle = share + spread / 2
    half = F.lit(z) * F.sqrt(share * (1 - share) / total + F.lit(z * z) / (4 * total * total))
    low = F.greatest(F.lit(0.0), (middle - half) / (1 + spread))
    high = F.least(F.lit(1.0), (middle + half) / (1 + spread))
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 1.0).otherwise(high)


def decay(age_days: Column, half_life_days: float) -> Column:
    return F.exp(-F.lit(math.log(2) / half_life_days) * age_days)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def frequency(n: Column, n_largest: Column) -> Column:
    return F.log1p(n.cast("double")) / F.log1p(F.greatest(n_largest, F.lit(2)).cast("double"))


def severity_prior(rating: Column, sentiment: Column) -> Column:
    """Severity of one item in [0, 1]: low stars dominate, else negative mood."""
    gloom = F.greatest(F.lit(0.0), -F.coalesce(sentiment, F.lit(0.0)))
    return F.when(rating.isNotNull(), 0.7 * (5 - rating) / 4 + 0.3 * gloom).otherwise(gloom)


def badge(n: Column, insufficient: int = 5, low: int = 15) -> Column:
    return (
        F.when(n < insufficient, "insufficient_evidence").when(n < low, "low_sample").otherwise("ok")
    )
