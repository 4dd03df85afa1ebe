"""Likelihood terms of the scan as columns, and the numeric tables behind them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import SCORE_SCALE

MAX_TABLE_ROWS = 1_000_000


def _number(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def shifted_ratio(z: Column, w: float, mu: Column | float, sigma: Column | float, cap: float | None = None) -> Column:
    """f(z - w) / f(z) for the normal density f; ``cap`` bounds the ratio from above.  The model may be columns."""
    var = _number(sigma) * _number(sigma)
    ratio = F.exp((z.cast("double") - _number(mu)) * (F.lit(float(w)) / var) - F.lit(float(w * w)) / (F.lit(2.0) * var))
    return F.least(ratio, F.lit(float(cap))) if cap is not None else ratio


def mixture_term(ratio: Column, r: float) -> Column:
    """ln((1 - r) + r * ratio)."""
    return F.log(F.lit(1.0 - r) + F.lit(float(r)) * ratio)


def scaled(term: Column) -> Column:
    """A score as an integer number of 1/SCORE_SCALE units."""
    return F.round(term * F.lit(float(SCORE_SCALE))).cast("long")


def unscaled(total: Column) -> Column:
    return total.cast("double") / F.lit(float(SCORE_SCALE))


def right_tail(x: float, mu: float, sigma: float) -> float:
    """1 - Phi((x - mu) / sigma)."""
    return 0.5 * math.erfc((x - mu) / (sigma * math.sqrt(2.0)))


def right_tail_column(x: Column, mu: Column | float, sigma: Column | float) -> Column:
    """1 - Phi((x - mu) / sigma) as a column: a power series near the mean, a continued fraction in the tails.

    Both are carried far enough for about twelve exact digits.
    """
    z = (x.cast("double") - _number(mu)) / _number(sigma)
    size = F.abs(z)
    peak = F.exp(-z * z / 2.0) / F.lit(math.sqrt(2.0 * math.pi))
    # sum of z**(2k + 1) / (1 * 3 * ... * (2k + 1)), each term from the one before
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(size.alias("term"), size.alias("sum")),
        lambda at, k: F.struct((at["term"] * size * size / (k * 2 + 1)).alias("term"), (at["sum"] + at["term"] * size * size / (k * 2 + 1)).alias("sum")),
        lambda at: at["sum"])
    # z + 1 / (z + 2 / (z + 3 / ...)), from the inside out
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), size, lambda at, k: size + k / at)
    upper = F.when(size < 4.0, F.lit(0.5) - peak * series).otherwise(peak / fraction)
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)


def hanging_term(distance: float, mu: float, sigma: float, r: float, p: float) -> float:
    """ln(1 + r (1 - p) / p * F(distance))."""
    return math.log(1.0 + r * (1.0 - p) / p * right_tail(distance, mu, sigma))


def hanging_table(spark: SparkSession, delta: int, mu: float, sigma: float, r: float, p: float) -> DataFrame:
    """``dist, term`` for dist = 1 .. delta - 1, term in score units.

    The table has ``delta - 1`` rows whatever the size of the reads, so it may be broadcast.
    """
    if not 1 < delta <= MAX_TABLE_ROWS:
        raise ValueError(f"delta must lie in 2..{MAX_TABLE_ROWS}")
    rows = [(d, round(hanging_term(d, mu, sigma, r, p) * SCORE_SCALE)) for d in range(1, delta)]
    return spark.createDataFrame(rows, "dist long, term long")


def hanging_term_column(distance: Column, mu: Column, sigma: Column, r: float, p: Column) -> Column:
    """``hanging_term`` with the model in columns."""
    return F.log(F.lit(1.0) + F.lit(float(r)) * (F.lit(1.0) - p) / p * right_tail_column(distance, mu, sigma))
