"""Shape statistics.  Moments use the sample standard deviation (n - 1)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def excess_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    return (F.kurtosis(x) + 3.0) * F.pow((n - 1.0) / n, F.lit(2.0)) - 3.0


def sample_skewness(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.skewness(x) * F.pow((n - 1.0) / n, F.lit(1.5))


def entropy_term(p: Column) -> Column:
    """One summand of -sum(p ln p); empty classes contribute nothing."""
    return F.when(p > 0, -p * F.log(p)).otherwise(0.0)
