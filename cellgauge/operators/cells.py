"""Preparing cell tables: filters, gains, clipping, summaries, controls, reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.plans.scale import (
    attach,
    first_n,
    match,
    number_rows,
    order_statistics,
    quantile,
    running_total,
    settle,
    settle_observed,
    settle_pool,
    slice_groups,
)

# --- filters and scalar columns -------------------------------------------


def subset(df: DataFrame, **conditions) -> DataFrame:
    """Rows where every named column equals the given value."""
    for column, value in conditions.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def positive_signal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every signal is above 0; null and NaN signals are left out."""
    for column in columns:
        df = df.filter((F.col(column) > 0) & ~F.isnan(column))
    return df


def join_gain(df: DataFrame, gains: DataFrame, on: str) -> DataFrame:
    """The gain of each row's channel; rows of unknown channels are left out."""
    return attach(df, settle(gains.select(on, "gain")), [on])


def normalise_gain(df: DataFrame, gains: DataFrame, *, channel: str, signal: str) -> DataFrame:
    """Signal divided by its channel's gain.

    Several channels can share one gain, so a compensated channel is entered in
    ``gains`` under its own name with the gain of the uncompensated one.
    """
    joined = join_gain(df, gains, channel)
    return joined.withColumn(signal, F.try_divide(F.col(signal), F.col("gain"))).drop("gain")


def gains_with_compensation(gains: DataFrame, channel: str, prefix: str = "FJComp-") -> DataFrame:
    """The gain table with every channel also under its compensated name."""
    compensated = gains.withColumn(channel, F.concat(F.lit(prefix), F.col(channel)))
    return gains.unionByName(compensated)


# --- clipping and summaries -----------------------------------------------


def clip_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    lo: float = 0.001,
    hi: float = 0.999,
    *,
    bounds: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """A1: rows strictly between the group's quantiles of one column, or of several at once.

    All quantiles are taken before any row is cut. ``bounds`` is a settled
    :func:`clip_bounds` and ``rows`` its row count, where known.
    """
    if bounds is None:
        bounds, seen = settle_observed(clip_bounds(df, keys, columns, lo, hi), rows=F.count(F.lit(1)))
        rows = seen["rows"]
    names = [f"{c}_{side}" for c in columns for side in ("lo", "hi")]
    renamed = bounds.select(*keys, F.col("n").alias("__n"), *[F.col(c).alias(f"__{c}") for c in names])
    kept = attach(df, renamed, keys, weight="__n", rows=rows)
    for c in columns:
        kept = kept.filter((F.col(c) > F.col(f"__{c}_lo")) & (F.col(c) < F.col(f"__{c}_hi")))
    return kept.select(*df.columns)


def clip_bounds(df, keys, columns, lo=0.001, hi=0.999) -> DataFrame:
    """The group quantiles :func:`clip_quantiles` cuts at, with the group's row count ``n``."""
    wanted = []
    for c in columns:
        wanted += [quantile(f"{c}_lo", c, lo), quantile(f"{c}_hi", c, hi)]
    return order_statistics(df, keys, wanted)


def geometric_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A2: geometric mean of every signal by group."""
    return df.groupBy(*keys).agg(*[F.exp(F.avg(F.log(c))).alias(c) for c in columns])


def well_counts(raw: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A3: cells before any filter and after all of them; a well that lost all shows 0."""
    before = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("cell_count"))
    after = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("cell_count_nz"))
    joined = match(before, after, keys, "left", broadcast=False)
    return joined.withColumn("cell_count_nz", F.coalesce("cell_count_nz", F.lit(0)))


def prepare_wells(
    raw: DataFrame, keys: Sequence[str], columns: Sequence[str], lo: float = 0.001, hi: float = 0.999
) -> tuple[DataFrame, DataFrame]:
    """Raw cells to (cleaned cells, well summary): P2, A1, A2 and A3 in order.

    The summary is one pass over the raw cells with conditional aggregates; a well
    that loses all its cells keeps its row.
    """
    positive = positive_signal(raw, columns)
    bounds, seen = settle_observed(clip_bounds(positive, keys, columns, lo, hi), rows=F.count(F.lit(1)))
    rows = seen["rows"]
    clean = clip_quantiles(positive, keys, columns, lo, hi, bounds=bounds, rows=rows)
    names = [f"{c}_{side}" for c in columns for side in ("lo", "hi")]
    renamed = bounds.select(*keys, F.col("n").alias("__n"), *[F.col(c).alias(f"__{c}") for c in names])
    judged = attach(raw.select(*keys, *columns), renamed, keys, how="left", weight="__n", rows=rows)
    kept = F.lit(True)
    for c in columns:
        kept = kept & (F.col(c) > 0) & (F.col(c) > F.col(f"__{c}_lo")) & (F.col(c) < F.col(f"__{c}_hi"))
    summary = judged.withColumn("__kept", F.coalesce(kept, F.lit(False))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.count(F.when(F.col("__kept"), 1)).alias("cell_count_nz"),
        *[F.exp(F.avg(F.when(F.col("__kept"), F.log(c)))).alias(c) for c in columns],
    )
    return clean, summary


# --- controls -------------------------------------------------------------


def quench_efficiency(
    df: DataFrame, signal: str, keys: Sequence[str] = (), *, time: float = 120.0, temp: float = 4.0
) -> DataFrame:
    """A4: 1 - mean of quenched over mean of unquenched cold cells, in one pass."""
    cold = df.filter((F.col("time") == time) & (F.col("temp") == temp))
    quenched = F.avg(F.when(F.col("quenched"), F.col(signal)))
    open_cells = F.avg(F.when(~F.col("quenched"), F.col(signal)))
    return cold.groupBy(*keys).agg((1.0 - F.try_divide(quenched, open_cells)).alias("eta"))


def attach_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """A one-row table's columns as constants on every row."""
    return attach(df, scalar, [])


def background_pool(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Time 0, unquenched, 37 degrees: the pool with a dense one-based ``idx``."""
    pool = df.filter((F.col("time") == 0.0) & (~F.col("quenched")) & (F.col("temp") == 37.0))
    return index_pool(pool, order).select("idx", *columns)


def index_pool(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A dense one-based ``idx`` by ``order``; ranges of the order are numbered apart, at any size."""
    return number_rows(df, order, "idx")


def gather_pool(draws: DataFrame, pool: DataFrame, index: str) -> DataFrame:
    """Pool values at drawn indices; the pool is broadcast, packed, while it is small.

    Drawn indices are uniform, so a shuffle join is balanced as well.
    """
    return settle_pool(pool).look_up(draws, index)


def distinct_times(df: DataFrame, column: str = "time") -> DataFrame:
    """Sorted distinct times without the first."""
    times = settle(df.select(column).distinct())
    first = times.agg(F.min(column)).first()[0]
    return times.filter(F.col(column) > F.lit(first)).orderBy(column)


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1000) -> DataFrame:
    """The first ``n`` cells of every sample."""
    return first_n(df, keys, order, n)


# --- reshaping ------------------------------------------------------------


def melt_channels(df: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """One row per cell and channel.

    Written as an exploded array rather than an unpivot, which would forget how the
    cells are partitioned and cost a shuffle in the aggregation that follows.
    """
    entries = [F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels]
    return df.select(*ids, F.explode(F.array(*entries)).alias("__e")).select(*ids, "__e.*")


def union_wells(wells: Sequence[DataFrame]) -> DataFrame:
    """Wells read apart, as one table; missing columns are null."""
    table = wells[0]
    for well in wells[1:]:
        table = table.unionByName(well, allowMissingColumns=True)
    return table


def pool_replicates(df: DataFrame, replicate: str = "rep") -> DataFrame:
    """All replicates of a sample merged, by forgetting which one a cell came from."""
    return df.drop(replicate)


def stack_scenarios(scenarios: dict[str, DataFrame]) -> DataFrame:
    """Variants of a table side by side under a ``scenario`` column."""
    stacked = None
    for name, table in scenarios.items():
        table = table.withColumn("scenario", F.lit(name))
        stacked = table if stacked is None else stacked.unionByName(table)
    return stacked


def nest_samples(df: DataFrame, keys: Sequence[str], order: str, value: str, chunk: int = 100_000) -> DataFrame:
    """Samples as arrays, an export view.

    Long samples are split into consecutive chunks of at most ``chunk`` cells, so a
    row stays small however large a sample is; concatenating ``samples`` by
    ``chunk`` gives the whole sample.
    """
    numbered = slice_groups(df.withColumn("__one", F.lit(1)), keys, order)
    numbered = running_total(numbered, keys, [order], {"__at": "__one"}).done()
    part = F.floor((F.col("__at") - 1) / chunk).cast("int")
    grouped = numbered.groupBy(*keys, part.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("__at", value))).alias("__cells")
    )
    return grouped.select(*keys, "chunk", F.col("__cells")[value].alias("samples"))


def unnest_samples(df: DataFrame, keys: Sequence[str], column: str = "samples") -> DataFrame:
    """Arrays back to one row per cell, with its zero-based position."""
    return df.select(*keys, F.posexplode(column).alias("cell", "value"))
