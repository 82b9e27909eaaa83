"""Free concentration over time, its integral, and doses drawn from a pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions import draws
from cellgauge.functions.response import Geometry, association_response
from cellgauge.plans import scale
from cellgauge.plans.scale import HOT_ROWS, Pool, Sliced, previous_row, running_total, settle_observed, settle_pool, slice_groups

DRAWS_PER_TASK = 1_000_000  # draws that meet their pool in one task


def fine_grid(df: DataFrame, last_step: int, step_seconds: int = 1800) -> DataFrame:
    """Every row at every fine time from 0; ``step`` is an integer, ``t`` in seconds."""
    steps = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(last_step))))
    return steps.withColumn("t", (F.col("step") * step_seconds).cast("double"))


def mean_free_concentration(
    df: DataFrame, keys: Sequence[str], bound: str, geometry: Geometry = Geometry()
) -> DataFrame:
    """Mean over prepared cells of u0 - P / V by ``keys`` (particle, well, step)."""
    free = geometry.concentration - F.col(bound) / geometry.volume
    return df.groupBy(*keys).agg(F.avg(free).alias("u"))


def cumulative_trapezoid(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, value: str, start: float,
    *, out: str = "integral", max_rows: int | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Running trapezoid integral along ``order`` in every group.

    The first row counts half of (value + start) times its own t. Groups too long for
    one task are cut into slices that carry their border row and total over.
    ``max_rows`` states a known group length and saves the counting pass.
    """
    if max_rows is not None and max_rows <= hot_rows:
        sliced = Sliced(df, False)
    else:
        sliced = slice_groups(df, keys, order, hot_rows=hot_rows)
    with_before = previous_row(sliced, keys, order, {"__t0": t, "__v0": value})
    area = F.when(F.col("__t0").isNull(), 0.5 * (F.col(value) + start) * F.col(t)).otherwise(
        0.5 * (F.col(value) + F.col("__v0")) * (F.col(t) - F.col("__t0"))
    )
    areas = Sliced(with_before.rows.withColumn("__area", area).drop("__t0", "__v0"), with_before.cut)
    return running_total(areas, keys, order, {out: "__area"}).done().drop("__area")


def align_time(fine: DataFrame, times: Sequence[float], step_seconds: int = 1800) -> DataFrame:
    """Rows of the fine grid that are observation times, matched on the integer step."""
    steps = [round(t / step_seconds) for t in times]
    if any(abs(s * step_seconds - t) > 1e-6 for s, t in zip(steps, times)):
        raise ValueError("observation times must lie on the fine grid")
    return fine.filter(F.col("step").isin(steps)).withColumn(
        "time", (F.col("step") * step_seconds).cast("double")
    )


def dose_weight(dose: Column, i: Column, form: str = "balanced") -> Column:
    """Weight of the i-th of ceil(dose) draws.

    balanced: min(1, max(0, dose - i + 1)), so the weights add up to the dose.
    reference: all but the last count fully and the last by the fractional part,
    which is 0 for a whole dose.
    """
    if form == "balanced":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dose - i + 1.0))
    if form == "reference":
        return F.when(i < F.ceil(dose), F.lit(1.0)).otherwise(dose - F.floor(dose))
    raise ValueError(f"unknown form {form!r}")


def fractional_dose_sum(
    cells: DataFrame, ids: Sequence[str], pool: DataFrame | Pool, seed: int, stream: str, *,
    dose: str = "dose", background: str = "background", out: str = "value",
    form: str = "balanced", method: str = "md5", draw_keys: Sequence[str] | None = None, size: int | None = None,
) -> DataFrame:
    """P10: background plus ceil(dose) pool draws, the last one weighted.

    ``pool`` has a dense one-based ``idx`` and ``value``; ``ids`` must identify a cell. Draws
    are made beside their cell, meet the pool by index (sent to them while it is small,
    beyond that both dealt evenly to as many tasks as the draws fill) and are added up
    before the cell moves on. Only counts reach the driver; ``size``, the pool's, if not given.
    """
    if not isinstance(pool, Pool):
        pool = settle_pool(pool.select("idx", F.col("value").cast("double").alias("value")))
    size = pool.size if size is None else size
    keys = [F.col(k) for k in (draw_keys or ids)]
    tasks = None
    if not pool.sent:
        cells, tasks = _draw_tasks(cells, dose)
    some = F.when(F.col(dose) > 0, F.sequence(F.lit(1), F.ceil(dose).cast("int")))
    draw = F.when(F.col("__i").isNotNull(), draws.pool_index(seed, stream, [*keys, F.col("__i")], float(size), method))
    drawn = cells.withColumn("__i", F.explode_outer(some)).withColumn("__idx", draw)
    if tasks:  # a cell without draws meets nothing, anywhere
        drawn = drawn.withColumn("__idx", F.coalesce("__idx", -1 - F.pmod(F.xxhash64(*ids), F.lit(1 << 31))))
    met = _meet(drawn, pool, "left", tasks)
    rest = [c for c in cells.columns if c not in ids]
    taken = F.sum(dose_weight(F.col(dose), F.col("__i"), form) * F.col("__v")).alias("__taken")
    whole = met.groupBy(*ids).agg(*[F.first(c).alias(c) for c in rest], taken)
    return whole.select(*cells.columns, (F.col(background) + F.coalesce("__taken", F.lit(0.0))).alias(out))


def _draw_tasks(cells: DataFrame, dose: str) -> tuple[DataFrame, int]:
    """The settled cells, and as many tasks as their draws and they themselves fill."""
    some = F.when(F.col(dose) > 0, F.ceil(dose)).otherwise(F.lit(1))
    cells, seen = settle_observed(cells, draws=F.sum(some))
    parallel = cells.sparkSession.sparkContext.defaultParallelism
    return cells, max(parallel, -(-int(seen["draws"] or 0) // DRAWS_PER_TASK))


def _meet(drawn: DataFrame, pool: Pool, how: str, tasks: int | None) -> DataFrame:
    """Draws beside their value ``__v`` of the pool, by ``__idx``; a pool that is sent comes to them."""
    if pool.sent:
        return pool.look_up(drawn, "__idx", how, value="__v")
    rows = pool.rows.select(F.col("idx").alias("__idx"), F.col("value").alias("__v"))
    return drawn.repartition(tasks, "__idx").join(rows.repartition(tasks, "__idx").hint("merge"), "__idx", how)


def fractional_dose_join(
    cells: DataFrame, ids: Sequence[str], pool: DataFrame, size: int, seed: int, stream: str, *,
    dose: str = "dose", background: str = "background", out: str = "value",
    form: str = "balanced", method: str = "md5", draw_keys: Sequence[str] | None = None,
) -> DataFrame:
    """P10 with sums apart from the cells: one row per draw, joined to the pool by index.

    Drawn indices are uniform, so the join is balanced; draws and cells are dealt to as many
    tasks as the draws fill, so that what a task holds does not grow with them. ``ids`` must
    identify a cell. Cells with dose 0 keep their background.
    """
    keys = [F.col(k) for k in (draw_keys or ids)]
    cells, tasks = _draw_tasks(scale.spread(cells), dose)
    pool = settle_pool(pool.select("idx", "value"))
    drawn = (
        cells.filter(F.col(dose) > 0)
        .select(*ids, dose, F.explode(F.sequence(F.lit(1), F.ceil(dose).cast("int"))).alias("__i"))
        .withColumn("__idx", draws.pool_index(seed, stream, [*keys, F.col("__i")], float(size), method))
    )
    gathered = _meet(drawn, pool, "inner", tasks)
    weighted = gathered.select(*ids, (dose_weight(F.col(dose), F.col("__i"), form) * F.col("__v")).alias("__taken"))
    sums = weighted.repartition(tasks, *ids).groupBy(*ids).agg(F.sum("__taken").alias("__taken"))
    joined = cells.repartition(tasks, *ids).join(sums.hint("merge"), list(ids), "left")
    return joined.withColumn(
        out, F.col(background) + F.coalesce("__taken", F.lit(0.0))
    ).drop("__taken")


def bound_particles(df: DataFrame, r: str, k: str, t: str = "t", geometry: Geometry = Geometry()) -> DataFrame:
    """P8 on a table: ``bound`` particles of every cell at its time."""
    return df.withColumn("bound", association_response(t, r, k, geometry))
