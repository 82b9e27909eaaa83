"""Selecting, resampling, proposing and accepting particles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions import draws
from cellgauge.operators.cells import index_pool
from cellgauge.plans.scale import (
    Position,
    match,
    number_rows,
    order_statistics,
)


def rank_by_distance(df: DataFrame, rho: str = "rho", key: str = "particle_id") -> DataFrame:
    """Position of every particle by distance, ties by id, nulls first; ranges of the order are numbered apart."""
    return number_rows(df, [rho, key], "position")


def _kept(n: Column, fraction: float) -> Column:
    """How many of ``n`` stay when the worst ``floor(fraction n)`` are cut."""
    return n - F.floor(F.lit(float(fraction)) * n)


def survival_threshold(df: DataFrame, fraction: float, rho: str = "rho") -> DataFrame:
    """The distance of the last particle kept, with ``n`` and ``kept``; one row.

    An exact order statistic, so no sort and no large limit.
    """
    at = Position("threshold", rho, 1.0 - fraction, lambda n: _kept(n, fraction) - 1)
    return order_statistics(df, [], [at]).select(
        "threshold", "n", _kept(F.col("n"), fraction).alias("kept")
    )


def keep_best(
    df: DataFrame, fraction: float, rho: str = "rho", key: str = "particle_id",
    *, threshold: DataFrame | None = None,
) -> DataFrame:
    """The ``n - floor(fraction n)`` closest particles; ties at the threshold by id.

    Particles below the threshold stay; of those exactly at it, the smallest ids
    fill the remaining places, cut by a second order statistic.
    """
    row = (survival_threshold(df, fraction, rho) if threshold is None else threshold).first()
    bound = F.lit(row["threshold"])
    missing = row["kept"] - df.filter(F.col(rho) < bound).count()
    tied = df.filter(F.col(rho) == bound)
    ties = tied.count()
    if missing >= ties:
        return df.filter(F.col(rho) <= bound)
    share = min(max((missing - 0.5) / ties, 0.0), 1.0)
    last = Position("last", key, share, lambda n: F.lit(missing - 1).cast("long"))
    cut = order_statistics(tied, [], [last]).first()["last"]
    return df.filter((F.col(rho) < bound) | ((F.col(rho) == bound) & (F.col(key) <= cut)))


def gather_survivors(slots: DataFrame, survivors: DataFrame, index: str = "idx") -> DataFrame:
    """Each slot's drawn survivor, carrying ``theta`` together with its ``rho``."""
    source = survivors.select(
        F.col("idx").alias(index), F.col("particle_id").alias("parent_id"), "theta", "rho"
    )
    return match(slots, source, [index], "inner", broadcast=False)


def select_resample(
    df: DataFrame, fraction: float, seed: int, *, stream: str = "resample", method: str = "md5"
) -> tuple[DataFrame, float]:
    """Cut the worst particles and refill their places from the survivors.

    Returns particles with ``replaced`` and ``parent_id``, and the threshold.
    Particles without a distance rank as farthest.
    """
    far = F.coalesce("rho", F.lit(float("inf")))
    scored = df.select("particle_id", "theta", far.alias("rho"))
    ranked = rank_by_distance(scored)
    n = ranked.count()
    kept = n - math.floor(fraction * n)
    best = ranked.filter(F.col("position") <= kept).drop("position")
    threshold = best.agg(F.max("rho")).first()[0]
    survivors = index_pool(best, ["particle_id"])
    slots = ranked.filter(F.col("position") > kept).select(
        "particle_id", draws.pool_index(seed, stream, ["particle_id"], float(kept), method).alias("idx")
    )
    refilled = gather_survivors(slots, survivors).select(
        "particle_id", "theta", "rho", F.lit(True).alias("replaced"), "parent_id"
    )
    stayed = best.select(
        "particle_id", "theta", "rho", F.lit(False).alias("replaced"), F.col("particle_id").alias("parent_id")
    )
    return stayed.unionByName(refilled), threshold


Moments = tuple[int, np.ndarray, np.ndarray]
MOMENTS = "n bigint, mean array<double>, products array<double>"
MERGE_WAYS = 256  # shares that the rows of the partitions are dealt to, before the last task adds those up


def _add_moments(one: Moments | None, other: Moments) -> Moments:
    """Counts, means and centred product sums of two parts together."""
    if one is None:
        return other
    n = one[0] + other[0]
    gap = other[1] - one[1]
    return n, one[1] + gap * (other[0] / n), one[2] + other[2] + np.outer(gap, gap) * (one[0] * other[0] / n)


def _moment_row(found: Moments, m: int) -> pa.RecordBatch:
    rows = [pa.array([found[0]]), pa.array([found[1]], pa.list_(pa.float64())), pa.array([found[2].reshape(-1)], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(rows, ["n", "mean", "products"])


def particle_covariance(df: DataFrame, m: int, theta: str = "theta", *, scaled: bool = True) -> DataFrame:
    """Sample covariance of all entries as rows (i, j, value) with i <= j.

    Scaled by 2.38^2 / m as a proposal, unless asked otherwise. Every task multiplies its
    own particles as one matrix and hands on a single row with its centred products; those
    are added in two steps, so neither particles nor pairs are shuffled. Particles without
    ``m`` entries, or with a missing one, are left out; below two the values are null.
    """
    factor = 2.38**2 / m if scaled else 1.0

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            vectors = batch.column(0)
            vectors = vectors.filter(pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), m))
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            x = x[~np.isnan(x).any(axis=1)]
            if len(x):
                mean = x.mean(axis=0)
                found = _add_moments(found, (len(x), mean, (x - mean).T @ (x - mean)))
        if found is not None:
            yield _moment_row(found, m)

    def read(batches: Iterator[pa.RecordBatch]) -> Moments | None:
        found = None
        for batch in batches:
            for n, mean, products in zip(*batch.columns):
                part = n.as_py(), mean.values.to_numpy(zero_copy_only=False), products.values.to_numpy(zero_copy_only=False).reshape(m, m)
                found = _add_moments(found, part)
        return found

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = read(batches)
        if found is not None:
            yield _moment_row(found, m)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = read(batches)
        if found is None:
            return
        i, j = np.triu_indices(m)
        value = factor * found[2][i, j] / (found[0] - 1) if found[0] > 1 else None
        values = pa.array(value if value is not None else [None] * len(i), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(i + 1, pa.int32()), pa.array(j + 1, pa.int32()), values], ["i", "j", "value"])

    rows = df.select(F.col(theta).cast("array<double>")).mapInArrow(multiplied, MOMENTS)
    dealt = rows.withColumn("way", F.pmod(F.hash("mean"), F.lit(MERGE_WAYS))).repartition("way").drop("way")
    few = dealt.mapInArrow(added, MOMENTS).coalesce(1)  # a small row for each of MERGE_WAYS tasks at most
    return few.mapInArrow(finished, "i int, j int, value double")


def proposal_factor(covariance: DataFrame, m: int) -> np.ndarray:
    """Lower Cholesky factor of the proposal; only m (m+1) / 2 numbers reach the driver.

    Entries are scaled to unit variance first, since parameters differ by ten orders
    of magnitude; a constant entry, or one fully determined by others, is not moved
    (beyond rounding).
    """
    matrix = np.zeros((m, m))
    for row in covariance.collect():
        matrix[row["i"] - 1, row["j"] - 1] = matrix[row["j"] - 1, row["i"] - 1] = row["value"] or 0.0
    spread = np.sqrt(np.diag(matrix))
    unit = np.where(spread > 0, spread, 1.0)
    scaled = matrix / np.outer(unit, unit)
    for jitter in (0.0, 1e-12, 1e-10, 1e-8, 1e-6):
        try:
            lower = np.linalg.cholesky(scaled + np.diag(np.where(spread > 0, jitter, 1.0)))
        except np.linalg.LinAlgError:
            continue
        return lower * spread[:, None]
    raise ValueError("the particle covariance is not positive semidefinite")


def propose(
    df: DataFrame, factor: np.ndarray, seed: int, stream: str, *, theta: str = "theta",
    key: str = "particle_id", method: str = "md5",
) -> DataFrame:
    """``proposal``, a multivariate normal step around every particle."""
    m = len(factor)
    rows = F.lit([[float(x) for x in row[: i + 1]] for i, row in enumerate(factor)])
    noise = F.transform(
        F.sequence(F.lit(1), F.lit(m)),
        lambda i: draws.box_muller(*draws.uniforms(seed, stream, [F.col(key), i], 2, method)),
    )

    def moved(x: Column, weights: Column) -> Column:
        pairs = F.zip_with(weights, F.slice("__z", F.lit(1), F.size(weights)), lambda w, z: w * z)
        return x + F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)

    stepped = df.withColumn("__z", noise)
    return stepped.withColumn("proposal", F.zip_with(theta, rows, moved)).drop("__z")


def mh_filter(
    df: DataFrame, log_new: Column, log_old: Column, seed: int, stream: str, *,
    key: str = "particle_id", method: str = "md5",
) -> DataFrame:
    """C4: proposals that pass ln u <= min(0, log prior ratio), before anything is scored.

    The proposal is symmetric, so its own ratio is 1. An undefined ratio is a refusal.
    """
    ratio = log_new - log_old
    u = draws.uniform(seed, stream, [key], method=method)
    passes = F.log(u) <= F.least(F.lit(0.0), ratio)
    return df.filter(passes & ~F.isnan(ratio) & (log_new > float("-inf")))


def abc_accept(state: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Move a particle where its proposal's distance is within the threshold.

    ``scored`` has particle_id, proposal and rho_new. ``moved`` tells which moved.
    """
    joined = match(state, scored.select("particle_id", "proposal", "rho_new"), ["particle_id"], "left", broadcast=False)
    moved = F.coalesce(F.col("rho_new") <= F.lit(float(threshold)), F.lit(False))
    return joined.select(
        "particle_id",
        F.when(moved, F.col("proposal")).otherwise(F.col("theta")).alias("theta"),
        F.when(moved, F.col("rho_new")).otherwise(F.col("rho")).alias("rho"),
        *[c for c in state.columns if c not in ("particle_id", "theta", "rho", "moved")],
        moved.alias("moved"),
    )


def acceptance_rate(attempts: DataFrame, moved: str = "moved", keys: Sequence[str] = ()) -> DataFrame:
    """Accepted over attempted moves."""
    return attempts.groupBy(*keys).agg(
        F.count(F.when(F.col(moved), 1)).alias("accepted"),
        F.count(F.lit(1)).alias("attempted"),
        F.try_divide(F.count(F.when(F.col(moved), 1)).cast("double"), F.count(F.lit(1)).cast("double")).alias("rate"),
    )


def repeat_count(rate: Column | str, c: float) -> Column:
    """Moves after which a particle has stayed put with probability below ``c``.

    Null at rate 0, where no number suffices; 1 at rate 1.
    """
    rate = F.col(rate) if isinstance(rate, str) else rate
    inner = F.when((rate > 0) & (rate < 1), rate)
    steps = F.ceil(math.log(c) / F.log(1.0 - inner))
    return F.when(rate >= 1, F.lit(1)).otherwise(steps).cast("long")
