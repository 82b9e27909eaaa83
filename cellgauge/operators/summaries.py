"""Curves and tables drawn from samples and saved particles."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions import densities
from cellgauge.plans.scale import attach, match, order_statistics, quantile, settle

#: Histogram settings of the two models. Fixed values: (low, high, bins).
SIGNAL_BINS = (0.0, 3.0, 20)
ASSOCIATION_BINS = (0.0, 1000.0, 20)
REACH = 8.5  # bandwidths after which a Gaussian kernel is below 3e-16 of its peak


def density_histogram(
    df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, bins: int
) -> DataFrame:
    """Count, and density by the number of values in range, of every bin.

    Bins are closed on the left and the last one on both sides; values outside are
    dropped. Empty bins have no row.
    """
    width = (hi - lo) / bins
    inside = df.filter((F.col(value) >= lo) & (F.col(value) <= hi))
    k = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*keys, k.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    totals = settle(counts.groupBy(*keys).agg(F.sum("count").alias("n")))
    joined = attach(counts, totals, keys)
    return joined.select(
        *keys, "bin", (lo + F.col("bin") * width).alias("left"), "count",
        (F.col("count") / (F.col("n") * width)).alias("density"),
    )


def curve_points(lo: float, hi: float, points: int) -> Column:
    """Evenly spaced points, as an array of (point, x) to explode."""
    step = (hi - lo) / (points - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.struct(i.alias("point"), (F.lit(lo) + i * step).alias("x")),
    )


def bandwidths(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Silverman's rule per group: 0.9 min(sd, IQR / 1.34) n^(-1/5), with count and range.

    A vanishing quartile range falls back to the spread and a constant sample to 1.
    """
    spread = df.groupBy(*keys).agg(
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("m"),
    )
    quartiles = order_statistics(df, keys, [quantile("q1", value, 0.25), quantile("q3", value, 0.75)]).drop("n")
    if keys:
        joined = match(spread, quartiles, keys, "inner", broadcast=False)
    else:
        joined = attach(spread, settle(quartiles), keys)
    smaller = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)
    width = F.when(smaller > 0, smaller).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return joined.withColumn("h", 0.9 * width * F.pow(F.col("m"), F.lit(-0.2))).select(
        *keys, "m", "low", "high", "h"
    )


def kde_curve(df: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, points: int = 500) -> DataFrame:
    """Gaussian kernel density of every group at evenly spaced points.

    Every value meets the points within ``REACH`` bandwidths, beyond which its kernel is
    below the rounding of a double; nothing is binned. A task adds the kernels of its
    values up by point, so at most groups times points rows a task are shuffled.
    """
    valid = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    stats = settle(bandwidths(valid, keys, value).withColumnRenamed("m", "n"))
    near = attach(valid.select(*keys, F.col(value).cast("double").alias("__v")), stats.select(*keys, "n", "h"), keys)
    step = (hi - lo) / (points - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("__v") - REACH * F.col("h") - lo) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor((F.col("__v") + REACH * F.col("h") - lo) / step)).cast("int")
    met = near.filter(first <= last).select(*keys, "__v", "h", F.explode(F.sequence(first, last)).alias("point"))
    z = (F.lit(lo) + F.col("point") * step - F.col("__v")) / F.col("h")
    sums = met.groupBy(*keys, "point").agg(F.sum(F.exp(-z * z / 2.0)).alias("__sum"))
    frame = stats.select(*keys, "n", "h", F.explode(curve_points(lo, hi, points)).alias("__p")).select(*keys, "n", "h", "__p.point", "__p.x")
    scale = F.col("n") * F.col("h") * math.sqrt(2.0 * math.pi)
    whole = match(frame, sums, [*keys, "point"], "left", broadcast=False)
    return whole.select(*keys, "point", "x", (F.coalesce("__sum", F.lit(0.0)) / scale).alias("density"))


def mixture_curve(
    df: DataFrame, keys: Sequence[str], density: Callable[[Column], Column], lo: float, hi: float, points: int = 500
) -> DataFrame:
    """Average over particles of each particle's cell density, at evenly spaced points.

    ``density`` turns a point into the density under the row's parameters. Points are
    exploded beside each particle and averaged with a map-side combine.
    """
    spread = df.withColumn("__p", F.explode(curve_points(lo, hi, points)))
    return spread.groupBy(*keys, F.col("__p.point").alias("point")).agg(
        F.first("__p.x").alias("x"), F.avg(density(F.col("__p.x"))).alias("density")
    )


def lognormal_of(mean: str, sd: str) -> Callable[[Column], Column]:
    return lambda x: densities.lognormal_density(x, mean, sd)


def gamma_of(mean: str, sd: str, skew: str) -> Callable[[Column], Column]:
    return lambda x: densities.gamma_density(x, mean, sd, skew)


def curve_peak(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest density of every curve and the first point reaching it."""
    best = F.max(F.struct("density", -F.col("x")))
    return curve.groupBy(*keys).agg(best.alias("__b")).select(
        *keys, F.col("__b.density").alias("peak"), (-F.col("__b.col2")).alias("x")
    )


def recovery_report(
    particles: DataFrame, truth: DataFrame, keys: Sequence[str] = ("param", "well"), *, level: float = 0.95
) -> DataFrame:
    """Central interval and median of every parameter over particles, against the truth.

    ``particles`` is long (param, well, value), as is ``truth``.
    """
    tail = (1.0 - level) / 2.0
    wanted = [quantile("lower", "value", tail), quantile("median", "value", 0.5), quantile("upper", "value", 1.0 - tail)]
    intervals = order_statistics(particles, keys, wanted)
    joined = match(intervals, truth.select(*keys, F.col("value").alias("truth")), keys, "left", broadcast=False)
    return joined.withColumn("covered", (F.col("truth") >= F.col("lower")) & (F.col("truth") <= F.col("upper")))
