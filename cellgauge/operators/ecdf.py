"""Empirical distributions on a uniform grid and the distance of a sample to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgauge.plans.scale import (
    HOT_ROWS,
    attach,
    hot_groups,
    match,
    running_total,
    settle,
    slice_groups,
)

KNOTS = 1000
WIDEN = 1e-3  # added to the largest value, so a constant sample has a range
FLOOR = 1e-9  # distribution values are kept within [FLOOR, 1 - FLOOR]


def sample_range(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """A5: smallest and largest value and count of every sample."""
    return df.groupBy(*keys).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")
    )


def grid_interval(y, lo, step, knots: int = KNOTS) -> Column:
    """Zero-based interval k with knot k <= y < knot k+1; clamped to the grid.

    The quotient can be off by one through rounding, so it is compared with the
    knots themselves. Values far outside are clamped first: they can exceed a long.
    """
    guess = F.floor(F.least(F.greatest((y - lo) / step, F.lit(-1.0)), F.lit(float(knots))))
    fixed = guess - F.when(y < lo + guess * step, 1).otherwise(0) + F.when(
        y >= lo + (guess + 1) * step, 1
    ).otherwise(0)
    return F.least(F.greatest(fixed, F.lit(0)), F.lit(knots - 2)).cast("int")


def ecdf_grid(
    df: DataFrame, keys: Sequence[str], value: str, knots: int = KNOTS, *,
    ranges: DataFrame | None = None, rows: int | None = None,
) -> DataFrame:
    """Per sample the share of values strictly below each of ``knots`` even knots.

    One row per sample with ``lo``, ``hi``, ``step``, ``n`` and the array ``p``. Values
    are counted by interval, which combines on the map side, and summed up along the
    knots; the cost is linear in the values and the sample is never gathered. ``ranges``
    is a settled :func:`sample_range` and ``rows`` its row count, where known.
    """
    valid = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, value)
    step = (F.col("hi") + WIDEN - F.col("lo")) / (knots - 1)
    if ranges is None:
        ranges = settle(sample_range(valid, keys, value).withColumn("step", step))
    else:
        ranges = ranges.withColumn("step", step)
    placed = attach(valid, ranges, keys, rows=rows)
    k = grid_interval(F.col(value), F.col("lo"), F.col("step"), knots)
    return _grid_of(placed.select(*keys, k.alias("k")), ranges, keys, knots)


def ecdf_grids(df: DataFrame, keys: Sequence[str], channels: Sequence[str], stats: DataFrame, rows: int, knots: int = KNOTS) -> DataFrame:
    """A6 for all channels of a cell in one aggregate: the grids with a column ``channel``.

    ``stats`` is settled, with ``n`` and for every channel ``__lo_`` and ``__hi_``; its other
    columns stay with the grids. Every channel of every cell has a value. A cell is read once and gives its interval in
    each channel, counted before anything moves.
    """
    step = lambda c: (F.col(f"__hi_{c}") + WIDEN - F.col(f"__lo_{c}")) / (knots - 1)
    placed = attach(df.select(*keys, *channels), stats, keys, rows=rows)
    found = [F.struct(F.lit(c).alias("channel"), grid_interval(F.col(c), F.col(f"__lo_{c}"), step(c), knots).alias("k")) for c in channels]
    spans = [
        F.struct(F.lit(c).alias("channel"), F.col(f"__lo_{c}").alias("lo"), F.col(f"__hi_{c}").alias("hi"), step(c).alias("step")) for c in channels
    ]
    others = [c for c in stats.columns if c not in keys and not c.startswith("__")]  # n, and what goes along
    ranges = stats.select(*keys, *others, F.explode(F.array(*spans)).alias("__s")).select(*keys, *others, "__s.*")
    hits = placed.select(*keys, F.explode(F.array(*found)).alias("__f")).select(*keys, "__f.channel", "__f.k")
    return _grid_of(hits, ranges, [*keys, "channel"], knots)


def _grid_of(hits: DataFrame, ranges: DataFrame, keys: Sequence[str], knots: int) -> DataFrame:
    """Grids from the interval ``k`` of every value and the ranges of the samples."""
    every = ranges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(knots - 2))).alias("k"))
    # Empty intervals join the count with weight 0, so each sample has all of them.
    weighted = hits.withColumn("w", F.lit(1)).unionByName(every.withColumn("w", F.lit(0)))
    counts = weighted.groupBy(*keys, "k").agg(F.sum("w").alias("c"))
    along = Window.partitionBy(*keys).orderBy("k")  # knots - 1 rows per sample
    summed = counts.withColumn("upto", F.sum("c").over(along))
    arrays = summed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("k", "upto"))).alias("__e")
    )
    if keys:
        joined = match(ranges, arrays, keys, "inner", broadcast=False)
    else:
        joined = attach(arrays, ranges, keys)
    shares = F.transform(F.col("__e")["upto"], lambda s: s / F.col("n"))
    others = [c for c in ranges.columns if c not in (*keys, "lo", "hi", "step", "n")]
    return joined.select(
        *keys, "lo", "hi", "step", "n", *others, F.concat(F.array(F.lit(0.0)), shares).alias("p")
    )


def grid_long(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The grid as one row per knot: ``k``, its position ``x`` and ``p``."""
    return grid.select(*keys, "lo", "step", F.posexplode("p").alias("k", "p")).select(
        *keys, "k", (F.col("lo") + F.col("k") * F.col("step")).alias("x"), "p"
    )


def lookup(y, lo, step, p, knots: int = KNOTS) -> Column:
    """Distribution value at ``y`` by linear interpolation, flat outside the grid."""
    k = grid_interval(y, lo, step, knots)
    t = F.least(F.greatest((y - (lo + k * step)) / step, F.lit(0.0)), F.lit(1.0))
    below, above = F.get(p, k), F.get(p, k + 1)
    return below + t * (above - below)


def ecdf_lookup(
    df: DataFrame, grid: DataFrame, keys: Sequence[str], value: str, out: str = "f", knots: int = KNOTS
) -> DataFrame:
    """J3 on a table: the grid row is attached by sample, then indexed (no range join)."""
    row_bytes = 64 + 8 * knots
    joined = attach(df, _named(grid, keys), keys, weight="__n", row_bytes=row_bytes)
    f = lookup(F.col(value), F.col("__lo"), F.col("__step"), F.col("__p"), knots)
    return joined.withColumn(out, f).select(*df.columns, out)


def _named(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grid.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("lo", "step", "p", "n")])


def order_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ascending one-based position ``i`` in the sample, its mirror and the count ``n``."""
    sizes = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    numbered = slice_groups(df.withColumn("__one", F.lit(1)), keys, order, sizes=sizes, hot_rows=hot_rows)
    numbered = running_total(numbered, keys, order, {"i": "__one"}).done().drop("__one")
    counted = attach(numbered, sizes, keys)
    return counted.withColumn("mirror", F.col("n") + 1 - F.col("i"))


def anderson_darling(
    df: DataFrame,
    grid: DataFrame,
    keys: Sequence[str],
    sample: Sequence[str],
    value: str,
    *,
    max_rows: int | None = None,
    hot_rows: int = HOT_ROWS,
    knots: int = KNOTS,
) -> DataFrame:
    """Distance of every predicted sample to the observed distribution of its ``keys``.

    ``sample`` names the columns that tell predicted samples of one key apart (a
    particle, say). With F ascending and clamped, the statistic is
    sqrt(-n - sum((2i-1) ln F_i + (2n+1-2i) ln(1-F_i)) / n): weighting the mirrored
    term by its own rank spares the reversed pairing.

    Samples too large for one task are combined by equal F first and ranked in
    slices; a block of c equal values with s before it has the closed weights
    c (2s + c) and c (2n - 2s - c). ``max_rows`` states a known bound on sample size
    and saves the counting pass.
    """
    groups = [*sample, *keys]
    df = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    placed = ecdf_lookup(df.select(*groups, value), grid, keys, value, knots=knots)
    clamped = F.least(F.greatest("f", F.lit(FLOOR)), F.lit(1.0 - FLOOR))
    placed = placed.select(*groups, clamped.alias("f"))
    if max_rows is None or max_rows > hot_rows:
        sizes = settle(df.groupBy(*groups).agg(F.count(value).alias("n")))
        lopsided = hot_groups(sizes, hot_rows) is not None
    else:
        lopsided = False
    if not lopsided:
        whole = Window.partitionBy(*groups)
        ranked = placed.select(
            *groups,
            "f",
            F.row_number().over(whole.orderBy("f")).alias("i"),
            F.count(F.lit(1)).over(whole).alias("n"),
        )
        below = 2 * F.col("i") - 1
        above = 2 * F.col("n") + 1 - 2 * F.col("i")
    else:
        blocks = placed.groupBy(*groups, "f").agg(F.count(F.lit(1)).alias("c"))
        blocks = slice_groups(blocks, groups, "f", sizes=sizes, hot_rows=hot_rows)
        blocks = running_total(blocks, groups, ["f"], {"upto": "c"}).done()
        ranked = attach(blocks, sizes, groups)
        before = F.col("upto") - F.col("c")
        below = F.col("c") * (2 * before + F.col("c"))
        above = F.col("c") * (2 * F.col("n") - 2 * before - F.col("c"))
    term = below * F.log("f") + above * F.log(1.0 - F.col("f"))
    return (
        ranked.groupBy(*groups)
        .agg(F.sum(term).alias("__s"), F.max("n").alias("n"))
        .select(*groups, "n", F.sqrt(-F.col("n") - F.col("__s") / F.col("n")).alias("ad"))
    )
