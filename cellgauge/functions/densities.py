"""Log-densities as column expressions.

``ln(0)`` is null in Spark, so values outside a support give -inf explicitly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgauge.functions.draws import _column, lognormal_shape

MINUS_INFINITY = float("-inf")


def _inside(condition: Column, density: Column) -> Column:
    return F.when(condition, density).otherwise(F.lit(MINUS_INFINITY))


def uniform_log(x, lo, hi) -> Column:
    x, lo, hi = _column(x), _column(lo), _column(hi)
    return _inside((x >= lo) & (x <= hi), -F.log(hi - lo))


def normal_log(x, mean, sd) -> Column:
    """Normal; a spread of 0 is a point mass, written as +inf at the mean."""
    x, mean, sd = _column(x), _column(mean), _column(sd)
    safe = F.when(sd > 0, sd)
    z = (x - mean) / safe
    return (
        F.when(sd > 0, -0.5 * z * z - F.log(safe) - 0.5 * math.log(2.0 * math.pi))
        .when((sd == 0) & (x == mean), F.lit(float("inf")))
        .otherwise(F.lit(MINUS_INFINITY))
    )


def truncated_normal_log(x, mean, sd) -> Column:
    """Normal cut off below at 0, with the lost mass put back."""
    x, mean, sd = _column(x), _column(mean), _column(sd)
    kept = normal_cdf(mean / F.when(sd > 0, sd))
    return _inside(x >= 0, normal_log(x, mean, sd) - F.coalesce(F.log(kept), F.lit(0.0)))


def half_cauchy_log(x, scale) -> Column:
    x, scale = _column(x), _column(scale)
    return _inside(x >= 0, F.log(2.0 / (math.pi * scale * (1.0 + (x / scale) * (x / scale)))))


def log_density(dist: str, x, a, b) -> Column:
    """Log-density of a named distribution with parameters ``a`` and ``b``."""
    return {
        "uniform": lambda: uniform_log(x, a, b),
        "normal": lambda: normal_log(x, a, b),
        "half_cauchy": lambda: half_cauchy_log(x, b),
    }[dist]()


def log_density_by_name(dist: Column, x, a, b) -> Column:
    """The same with the distribution named in a column, as in a prior table."""
    chosen = F.lit(None).cast("double")
    for name in ("uniform", "normal", "half_cauchy"):
        chosen = F.when(dist == name, log_density(name, x, a, b)).otherwise(chosen)
    return chosen


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error below 8e-8.

    Spark SQL has no error function; this is the rational approximation 26.2.17 of
    Abramowitz and Stegun. Fixed values: their coefficients.
    """
    p = 0.2316419
    b = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    k = 1.0 / (1.0 + p * F.abs(z))
    series = F.lit(0.0)
    for coefficient in reversed(b):
        series = (series + coefficient) * k
    upper = F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi) * series
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0 by Stirling's series, shifted up by eight.

    The shift keeps the argument above 8, where the series is good to 1e-13.
    """
    shift = 8
    product = F.lit(1.0)
    for i in range(shift):
        product = product * (x + i)
    y = x + shift
    y2 = y * y
    series = (1.0 / 12.0 - (1.0 / 360.0 - (1.0 / 1260.0 - 1.0 / (1680.0 * y2)) / y2) / y2) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2.0 * math.pi) + series - F.log(product)


def lognormal_density(x, mean, sd) -> Column:
    """Density of the lognormal of :func:`draws.lognormal_by_moments`; 0 for x <= 0."""
    x = _column(x)
    mu, s = lognormal_shape(mean, sd)
    safe = F.when(x > 0, x)
    z = (F.log(safe) - mu) / s
    return F.coalesce(F.exp(-z * z / 2.0) / (safe * s * math.sqrt(2.0 * math.pi)), F.lit(0.0))


def gamma_density(x, mean, sd, skew) -> Column:
    """Density of the shifted gamma of :func:`draws.gamma_by_moments`."""
    x, mean, sd, skew = _column(x), _column(mean), _column(sd), _column(skew)
    flat = F.abs(skew) < 1e-3
    shape = 4.0 / F.when(flat, F.lit(1.0)).otherwise(skew * skew)
    z = (x - mean) / sd
    g = shape + F.signum(skew) * z * F.sqrt(shape)
    safe = F.when(g > 0, g)
    log_gamma_density = (shape - 1.0) * F.log(safe) - safe - log_gamma(shape)
    skewed = F.coalesce(F.exp(log_gamma_density), F.lit(0.0)) * F.sqrt(shape) / sd
    return F.when(flat, F.exp(-z * z / 2.0) / (sd * math.sqrt(2.0 * math.pi))).otherwise(skewed)
