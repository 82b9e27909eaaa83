"""Random draws as keyed column expressions.

A draw is a function of (seed, stream, key columns), so a retried task, another
partitioning or a second run gives the same row. ``method="md5"`` can be repeated
in any SQL engine; ``method="xxhash64"`` is several times cheaper and is the
default where tables are expanded to many cells.

Keys must be integer or string columns: the text of a double differs by engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIES = 40  # keyed attempts of a truncated normal; each succeeds with p >= 1/2 for mean >= 0
GAMMA_TRIES = 12  # keyed attempts of a gamma draw; each succeeds with p > 0.95


def uniforms(seed: int, stream: str | Column, keys: list, count: int, method: str = "md5") -> list[Column]:
    """Up to four independent uniforms on (0, 1) from one key.

    Thirty-two bits each with md5 and fifty-three with xxhash64; never 0 or 1. The
    stream may be a column.
    """
    if not 1 <= count <= 4:
        raise ValueError("one key gives one to four uniforms")
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    stream = stream if isinstance(stream, Column) else F.lit(stream)
    if method == "md5":
        text = F.concat_ws("|", F.lit(str(seed)), stream, *[k.cast("string") for k in keys])
        digest = F.md5(text)
        return [
            (F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") + 0.5) / 2.0**32
            for i in range(count)
        ]
    if method == "xxhash64":
        return [
            (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.concat(stream, F.lit(str(i))), *keys), 11) + 0.5)
            / 2.0**53
            for i in range(count)
        ]
    raise ValueError(f"unknown draw method {method!r}")


def uniform(seed, stream, keys, lo=0.0, hi=1.0, method="md5") -> Column:
    """Uniform on (lo, hi); the bounds may be columns."""
    (u,) = uniforms(seed, stream, keys, 1, method)
    lo, hi = _column(lo), _column(hi)
    return lo + (hi - lo) * u


def box_muller(u1: Column, u2: Column) -> Column:
    """A standard normal from two uniforms."""
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def normal(seed, stream, keys, mean=0.0, sd=1.0, method="md5") -> Column:
    """R2: normal with the given mean and spread."""
    return _column(mean) + _column(sd) * box_muller(*uniforms(seed, stream, keys, 2, method))


def truncated_normal(seed, stream, keys, mean, sd, method="md5", tries=TRIES) -> Column:
    """Normal cut off below at 0, by the first of ``tries`` keyed draws that is >= 0.

    Spread 0 returns the mean. Exhausted tries give null; callers flag those rows.
    """
    mean, sd = _column(mean), _column(sd)
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]

    def attempt(i: Column) -> Column:
        draw = mean + sd * box_muller(*uniforms(seed, stream, [*keys, i], 2, method))
        return F.get(F.filter(F.array(draw), lambda x: x >= 0), F.lit(0))

    # a try is only evaluated when those before it failed: under two on average for mean >= 0
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(tries)),
        F.lit(None).cast("double"),
        lambda found, i: F.coalesce(found, attempt(i)),
    )
    return F.when(sd == 0, F.when(mean >= 0, mean)).otherwise(found)


def half_cauchy(seed, stream, keys, scale, method="md5") -> Column:
    """Positive half of a Cauchy with the given scale."""
    (u,) = uniforms(seed, stream, keys, 1, method)
    return _column(scale) * F.tan(math.pi / 2.0 * u)


def lognormal_shape(mean, sd) -> tuple[Column, Column]:
    """Log-scale mean and spread of the lognormal with the given mean and sd."""
    mean, sd = _column(mean), _column(sd)
    s2 = F.log1p((sd / mean) * (sd / mean))
    return F.log(mean) - s2 / 2.0, F.sqrt(s2)


def lognormal_by_moments(seed, stream, keys, mean, sd, method="md5") -> Column:
    """Lognormal with the given mean and standard deviation (our definition).

    Null where the mean is not positive: no lognormal has such a mean.
    """
    mean, sd = _column(mean), _column(sd)
    safe = F.when(mean > 0, mean)
    mu, s = lognormal_shape(safe, sd)
    return F.exp(mu + s * box_muller(*uniforms(seed, stream, keys, 2, method)))


def lognormal_with_scale(seed, stream, keys, scale, mean, sd, method="md5") -> Column:
    """The three-argument lognormal; the first argument multiplies the draw.

    Every known use passes 1.0, so this equals :func:`lognormal_by_moments`.
    """
    return _column(scale) * lognormal_by_moments(seed, stream, keys, mean, sd, method)


def gamma_by_moments(seed, stream, keys, mean, sd, skew, method="md5", tries=GAMMA_TRIES) -> Column:
    """Shifted gamma with the given mean, sd and skewness in [-2, 2] (our definition).

    Shape k = 4 / skew^2 >= 1, mirrored for negative skew and normal near skew 0, so
    draws can be negative (:func:`below_zero` flags them). Squeeze-free rejection over
    keyed tries; an attempt is only evaluated when the ones before it failed. Each succeeds
    with p > 0.95, so about one draw in 10^15 comes to their end; it takes the value at the
    top of the proposal and is never null.
    """
    mean, sd, skew = _column(mean), _column(sd), _column(skew)
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    flat = F.abs(skew) < 1e-3
    shape = 4.0 / (F.when(flat, F.lit(1.0)).otherwise(skew * skew))
    d = shape - 1.0 / 3.0

    def attempt(i: Column) -> Column:
        u1, u2, u3 = uniforms(seed, stream, [*keys, i], 3, method)
        z = box_muller(u1, u2)
        v = F.pow(1.0 + z / (3.0 * F.sqrt(d)), F.lit(3.0))
        keep = (v > 0) & (F.log(u3) < z * z / 2.0 + d - d * v + d * F.log(v))
        return F.when(keep, d * v)

    # unrolled, the tries outgrow what the code generator can compile when their parameters are columns
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(tries)),
        F.lit(None).cast("double"),
        lambda found, i: F.coalesce(found, attempt(i)),
    )
    draw = F.coalesce(found, d)
    standard = F.when(flat, box_muller(*uniforms(seed, stream, [*keys, F.lit(0)], 2, method))).otherwise(
        F.signum(skew) * (draw - shape) / F.sqrt(shape)
    )
    return mean + sd * standard


def below_zero(draw: Column) -> Column:
    """Whether a draw left the range that concentrations and rates can have; false for null."""
    return F.coalesce(draw < 0, F.lit(False))


def pool_index(seed, stream, keys, size, method="md5") -> Column:
    """One-based index drawn uniformly, with replacement, from a pool of ``size``."""
    (u,) = uniforms(seed, stream, keys, 1, method)
    return (F.floor(u * _column(size)) + 1).cast("long")


def _column(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))
