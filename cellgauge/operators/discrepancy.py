"""Distances between predicted and observed cell tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.operators.cells import melt_channels
from cellgauge.operators.ecdf import FLOOR, KNOTS, anderson_darling, ecdf_grid, ecdf_grids, lookup
from cellgauge.operators.paired import PairMetric, pair_distances
from cellgauge.plans.scale import HOT_ROWS, attach, measured_groups, settle, settle_observed

#: A metric takes (predicted cells, grid, keys, sample, value) and gives a column ``ad``;
#: a pair metric sees the observed cells instead of their grid.
Metric = Callable[..., DataFrame] | PairMetric


def channel_correlation(df: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Pearson correlation by group; null where a channel is constant."""
    spread = F.stddev_pop(first) * F.stddev_pop(second)
    return df.groupBy(*keys).agg(F.try_divide(F.covar_pop(first, second), spread).alias("r"))


@dataclass(frozen=True)
class Observed:
    """The observed side, prepared once and reused in every scoring pass.

    ``grid`` has one row per sample (and channel), ``correlations`` one per sample;
    ``grids`` and ``pairs`` are their row counts. The size depends on the number of
    samples, not of cells.
    """

    keys: list[str]
    channels: list[str]
    grid: DataFrame
    grids: int
    correlations: DataFrame | None = None
    pairs: int = 0
    weights: tuple[float, float] = (0.5, 0.5)
    cells: DataFrame | None = None


def observe(
    df: DataFrame, keys: Sequence[str], channels: Sequence[str], weights: tuple[float, float] = (0.5, 0.5)
) -> Observed:
    """Build the observed grids, and with two channels their correlations.

    ``df`` is wide: one column per channel. Hierarchical keys name the replicate,
    pooled keys leave it out.
    """
    keys, channels = list(keys), list(channels)
    df = df.filter(_valid(channels))
    if len(channels) == 1:
        grid, seen = settle_observed(ecdf_grid(df, keys, channels[0]), grids=F.count(F.lit(1)))
        return Observed(keys, channels, grid, seen["grids"], weights=weights, cells=df.select(*keys, *channels))
    # One pass for the ranges and the correlation, one for the grids of both channels.
    spread = F.stddev_pop(channels[0]) * F.stddev_pop(channels[1])
    ranges = [a for c in channels for a in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))]
    r_obs = F.try_divide(F.covar_pop(*channels), spread).alias("r_obs")
    stats, seen = settle_observed(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ranges, r_obs), samples=F.count(F.lit(1)))
    samples = seen["samples"]
    grid = ecdf_grids(df, keys, channels, stats, samples)
    correlations = stats.select(*keys, "r_obs")
    return Observed(keys, channels, settle(grid), samples * len(channels), correlations, samples, weights, df.select(*keys, *channels))


def pair_samples(
    predicted: DataFrame, observed: DataFrame, keys: Sequence[str], *, rows: int | None = None
) -> DataFrame:
    """Statistics of predicted samples next to those of the observed sample of that key.

    Both sides are aggregates. A key without a partner on the other side pairs with
    nothing; :func:`discrepancy` notices it by counting terms.
    """
    return attach(predicted, observed, keys, rows=rows)


def discrepancy(
    predicted: DataFrame,
    observed: Observed,
    sample: Sequence[str],
    *,
    metric: Metric = anderson_darling,
    max_rows: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One distance ``rho`` per predicted candidate, summed over observed samples.

    One channel: the sum of the metric. Two channels, with weights (w1, w2): 2 w1
    for the first (quenchable) channel, w1 for the second, and w2 times the absolute
    difference of the channel correlations. A cell counts if all its channels have a
    value, on either plan below. Every candidate of ``predicted`` has a row: one that
    lacks an observed sample, or whose correlation is undefined, gets a null distance
    and a ``reason``; one that had cells left out keeps its distance and says so.
    """
    sample = list(sample)
    if metric is anderson_darling and not _lopsided(predicted, [*sample, *observed.keys], max_rows, hot_rows):
        return _totals(_terms_in_one_pass(predicted, observed, sample), observed, sample)
    return _totals(_terms_by_channel(predicted, observed, sample, metric, max_rows, hot_rows), observed, sample)


def _lopsided(predicted: DataFrame, groups: Sequence[str], max_rows: int | None, hot_rows: int) -> bool:
    """Whether some predicted sample is too large for one task; a known bound saves the count."""
    if max_rows is not None and max_rows <= hot_rows:
        return False
    return measured_groups(predicted, groups)[1] > hot_rows


def _terms_in_one_pass(predicted: DataFrame, observed: Observed, sample: Sequence[str]) -> DataFrame:
    """All terms of a sample from one window over it, with its channels side by side.

    Nothing is melted, cells are read (or predicted) once, and where they are already
    partitioned by sample the only shuffle is of the finished terms.
    """
    keys, channels = observed.keys, observed.channels
    two = len(channels) > 1
    groups = [*sample, *keys]
    valid = _valid(channels)
    placed = predicted.select(*groups, *channels, valid.alias("__valid"))
    for c in channels:
        grid = observed.grid.filter(F.col("channel") == c) if two else observed.grid
        also = ["r_obs"] if two and c == channels[0] else []
        named = grid.select(*keys, *also, *[F.col(g).alias(f"__{g}") for g in ("lo", "step", "p", "n")])
        placed = attach(placed, named, keys, how="left", weight="__n", row_bytes=64 + 8 * KNOTS, rows=observed.grids)
        f = lookup(F.col(c), F.col("__lo"), F.col("__step"), F.col("__p"))
        f = F.when(F.col("__valid") & F.col("__p").isNotNull(), F.least(F.greatest(f, F.lit(FLOOR)), F.lit(1.0 - FLOOR)))
        placed = placed.withColumn(f"__f_{c}", f).drop("__lo", "__step", "__p", "__n")
    whole = Window.partitionBy(*groups)
    # cells that do not count come last, so the others have the ranks from 1
    ranked = placed.select(
        "*",
        *[F.count(f"__f_{c}").over(whole).alias(f"__n_{c}") for c in channels],
        *[F.row_number().over(whole.orderBy(F.col(f"__f_{c}").asc_nulls_last())).alias(f"__i_{c}") for c in channels],
    )
    aggregates = [F.sum((~F.col("__valid")).cast("double")).alias("__left_out")]
    for c in channels:
        f, i, n = F.col(f"__f_{c}"), F.col(f"__i_{c}"), F.col(f"__n_{c}")
        term = (2 * i - 1) * F.log(f) + (2 * n + 1 - 2 * i) * F.log(1.0 - f)
        aggregates += [F.sum(term).alias(f"__s_{c}"), F.max(n).alias(f"__n_{c}")]
    if two:
        x, y = (F.when(F.col("__valid"), F.col(c)) for c in channels)
        aggregates.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("__r"))
        aggregates.append(F.max("r_obs").alias("r_obs"))
    stats = ranked.groupBy(*groups).agg(*aggregates)
    weights = _channel_weights(observed)
    entries = [
        F.struct(
            F.lit("sample").alias("kind"),
            (weights[c] * F.sqrt(-F.col(f"__n_{c}") - F.col(f"__s_{c}") / F.col(f"__n_{c}"))).alias("term"),
        )
        for c in channels
    ]
    entries.append(F.struct(F.lit("left out").alias("kind"), F.col("__left_out").alias("term")))
    if two:
        gap = observed.weights[1] * F.abs(F.col("r_obs") - F.col("__r"))
        entries.append(F.struct(F.lit("correlation").alias("kind"), gap.alias("term")))
    return stats.select(*sample, F.explode(F.array(*entries)).alias("__e")).select(*sample, "__e.*")


def _valid(channels: Sequence[str]) -> Column:
    """Whether all channels of a cell have a value."""
    valid = F.lit(True)
    for c in channels:
        valid = valid & F.col(c).isNotNull() & ~F.coalesce(F.isnan(c), F.lit(False))
    return valid


def _terms_by_channel(
    predicted: DataFrame, observed: Observed, sample: Sequence[str], metric: Metric, max_rows, hot_rows
) -> DataFrame:
    """The terms of any metric, and of samples too large for one task: one channel at a time."""
    keys, channels = observed.keys, observed.channels
    if isinstance(metric, PairMetric):
        seen = observed.cells if len(channels) == 1 else melt_channels(observed.cells, keys, channels)

        def measure(cells, grid, by, sample, value):
            return pair_distances(cells, seen, by, sample, value if len(channels) > 1 else channels[0], metric, hot_rows=hot_rows)

    else:
        options = {"max_rows": max_rows, **({"hot_rows": hot_rows} if metric is anderson_darling else {})}

        def measure(cells, grid, by, sample, value):
            return metric(cells, grid, by, sample, value, **options)

    left_out = predicted.groupBy(*sample).agg(F.sum((~_valid(channels)).cast("double")).alias("term"))
    left_out = left_out.select(*sample, F.lit("left out").alias("kind"), "term")  # a row for every candidate
    predicted = predicted.filter(_valid(channels))
    if len(channels) == 1:
        distances = measure(predicted, observed.grid, keys, sample, channels[0])
        return left_out.unionByName(distances.select(*sample, F.lit("sample").alias("kind"), F.col("ad").alias("term")))
    long = melt_channels(predicted, [*sample, *keys], channels)
    distances = measure(long, observed.grid, [*keys, "channel"], sample, "value")
    weight = F.lit(0.0)
    for c, w in _channel_weights(observed).items():
        weight = F.when(F.col("channel") == c, F.lit(w)).otherwise(weight)
    terms = distances.select(*sample, F.lit("sample").alias("kind"), (weight * F.col("ad")).alias("term"))
    r = channel_correlation(predicted, [*sample, *keys], *channels)
    gap = observed.weights[1] * F.abs(F.col("r_obs") - F.col("r"))
    paired = pair_samples(r, observed.correlations, keys, rows=observed.pairs)
    return left_out.unionByName(terms).unionByName(
        paired.select(*sample, F.lit("correlation").alias("kind"), gap.alias("term"))
    )


def _channel_weights(observed: Observed) -> dict[str, float]:
    """One channel counts once; of two, the first counts 2 w1 and the second w1."""
    if len(observed.channels) == 1:
        return {observed.channels[0]: 1.0}
    first, second = observed.channels
    return {first: 2.0 * observed.weights[0], second: observed.weights[0]}


def _totals(terms: DataFrame, observed: Observed, sample: Sequence[str]) -> DataFrame:
    of = lambda kind: F.when(F.col("kind") == kind, F.col("term"))
    totals = terms.groupBy(*sample).agg(
        F.sum(F.when(F.col("kind") != "left out", F.col("term"))).alias("__sum"),
        F.count(of("sample")).alias("__samples"),
        F.count(of("correlation")).alias("__correlations"),
        F.sum(of("left out")).alias("__left_out"),
    )
    missing = F.when(F.col("__samples") < observed.grids, F.lit("missing sample")).when(
        F.col("__correlations") < observed.pairs, F.lit("undefined correlation")
    )
    reason = F.coalesce(missing, F.when(F.col("__left_out") > 0, F.lit("cells left out")))
    return totals.select(*sample, F.when(missing.isNull(), F.col("__sum")).alias("rho"), reason.alias("reason"))


def discrepancy_pooled(
    predicted: DataFrame, observed_cells: DataFrame, keys: Sequence[str], channels: Sequence[str],
    sample: Sequence[str], *, replicate: str = "rep", **options,
) -> DataFrame:
    """Replicates merged on the observed side; n predicted against many observed cells."""
    shared = [k for k in keys if k != replicate]
    return discrepancy(predicted, observe(observed_cells, shared, channels), sample, **options)


def discrepancy_hier(
    predicted: DataFrame, observed_cells: DataFrame, keys: Sequence[str], channels: Sequence[str],
    sample: Sequence[str], **options,
) -> DataFrame:
    """Every replicate compared with its own prediction."""
    return discrepancy(predicted, observe(observed_cells, keys, channels), sample, **options)
