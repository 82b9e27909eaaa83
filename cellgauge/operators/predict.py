"""From particles to predicted cells to distances, as one Spark plan.

A particle row becomes (sample) rows, these are spread over the cluster, and only
then become cells. All draws, responses and ranks of a sample stay in the task that
holds it, so a scoring pass shuffles particle-sized rows and never the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.functions import draws
from cellgauge.functions.response import Geometry, clamp_nonnegative, compartment_response, saturating_uptake
from cellgauge.operators import uptake
from cellgauge.operators.discrepancy import Observed, discrepancy
from cellgauge.operators.ecdf import anderson_darling
from cellgauge.operators.priors import Layout, slice_params
from cellgauge.plans.scale import Pool, match, settle, settle_pool

CELLS_PER_TASK = 2_000_000

#: A forward model takes particles (particle_id, theta) and gives predicted cells.
Model = Callable[[DataFrame], DataFrame]


def expand_particles(
    particles: DataFrame, dims: dict[str, Sequence], cells: int, *, keep: Sequence[str] = ()
) -> DataFrame:
    """Every particle x dimension value x cell slot, spread by sample.

    Dimensions are short lists of settings (times, wells, conditions) and become
    array literals. The sample rows are hash-partitioned before cells appear, with a
    fixed partition count because the small rows hide how much they expand to.
    """
    rows = particles
    for name, values in dims.items():
        rows = rows.withColumn(name, F.explode(F.lit(list(values))))
    return explode_cells(rows, ["particle_id", *dims], cells)


def explode_cells(rows: DataFrame, keys: Sequence[str], cells: int) -> DataFrame:
    spark = rows.sparkSession
    rows = settle(rows)
    total = rows.count() * cells
    parts = max(spark.sparkContext.defaultParallelism, -(-total // CELLS_PER_TASK))
    spread = rows.repartition(int(parts), *keys)
    return spread.withColumn("cell", F.explode(F.sequence(F.lit(1), F.lit(cells))))


# --- internalisation ------------------------------------------------------


def assemble_signal(
    df: DataFrame, *, surface="surface", internal="internal", r="R", alpha_1="alpha_1", alpha_2="alpha_2",
    noise_1="noise_1", noise_2="noise_2", back_1="back_cy5", back_2="back_bdp", eta="eta",
    quenched="quenched",
) -> DataFrame:
    """The two measured channels of a cell.

    Both see the total amount; quenching only lowers what the first channel sees of
    the surface. Totals are cut off at 0 (P5).
    """
    s, i, amount = F.col(surface), F.col(internal), F.col(r)
    total = clamp_nonnegative(amount * (s + i))
    visible = clamp_nonnegative(amount * (i + (1.0 - F.col(eta)) * s))
    first = F.when(F.col(quenched), visible).otherwise(total)
    return df.withColumn("cy5", F.col(alpha_1) * first + F.col(back_1) + F.col(noise_1)).withColumn(
        "bdp", F.col(alpha_2) * total + F.col(back_2) + F.col(noise_2)
    )


@dataclass(frozen=True)
class Internalisation:
    """C1 for the internalisation model, pooled (``layout.wells == 0``) or with wells.

    ``pool`` has ``idx``, ``cy5`` and ``bdp``: one index picks both background values.
    """

    layout: Layout
    times: tuple[float, ...]
    cells: int
    pool: DataFrame
    eta: float
    seed: int
    method: str = "xxhash64"
    form: str = "balanced"
    channels: tuple[str, ...] = ("cy5", "bdp")

    @property
    def keys(self) -> list[str]:
        return ["time", "quenched"] + (["rep"] if self.layout.wells else [])

    @cached_property
    def _backgrounds(self) -> Pool:
        """The settled pool, shared by all scoring passes."""
        return settle_pool(self.pool.select("idx", F.col("cy5").alias("back_cy5"), F.col("bdp").alias("back_bdp")))

    def __call__(self, particles: DataFrame, stream: str = "") -> DataFrame:
        """Predicted cells: particle_id, keys, cell, cy5, bdp."""
        pool = self._backgrounds
        hier = self.layout.wells > 0
        dims = {"t_index": range(1, len(self.times) + 1), "quenched": [True, False]}
        if hier:
            dims["rep"] = range(1, self.layout.wells + 1)
        rows = particles.select("particle_id", "theta")
        for name, values in dims.items():
            rows = rows.withColumn(name, F.explode(F.lit(list(values))))
        names = ["sigma_lambda", "sigma_beta", "sigma_R", "sigma_1", "sigma_2", "alpha_1", "alpha_2", "p", "omega_lambda", "omega_beta"]
        means = {}
        for short in ("lambda", "beta", "R"):
            means[short] = (
                self.layout.well_at(f"mu_{short}", F.col("rep")) if hier else self.layout.at(f"mu_{short}")
            )
        time = F.element_at(F.lit([float(t) for t in self.times]), F.col("t_index"))
        rows = slice_params(rows, self.layout, names).select(
            "particle_id", *dims, *names, time.alias("time"), *[c.alias(f"mean_{s}") for s, c in means.items()]
        ).drop("theta")
        cells = explode_cells(rows, ["particle_id", *self.keys], self.cells)

        key = ["particle_id", "t_index", F.col("quenched").cast("int"), "cell"]
        if hier:
            key.insert(2, "rep")
        seed, method, tag = self.seed, self.method, stream
        z = draws.uniforms(seed, tag + "noise", key, 4, method)
        drawn = cells.select(
            "particle_id", *self.keys, "cell", "alpha_1", "alpha_2", "p",
            draws.gamma_by_moments(seed, tag + "lambda", key, "mean_lambda", "sigma_lambda", "omega_lambda", method).alias("lambda"),
            draws.gamma_by_moments(seed, tag + "beta", key, "mean_beta", "sigma_beta", "omega_beta", method).alias("beta"),
            draws.lognormal_with_scale(seed, tag + "R", key, 1.0, "mean_R", "sigma_R", method).alias("R"),
            (F.col("sigma_1") * draws.box_muller(z[0], z[1])).alias("noise_1"),
            (F.col("sigma_2") * draws.box_muller(z[2], z[3])).alias("noise_2"),
            draws.pool_index(seed, tag + "pool", key, float(pool.size), method).alias("idx"),
        )
        seen = pool.look_up(drawn, "idx")
        surface, internal = compartment_response("time", "lambda", "beta", "p", self.form)
        responses = seen.withColumn("surface", surface).withColumn("internal", internal)
        signals = assemble_signal(responses.withColumn("eta", F.lit(float(self.eta))))
        return signals.select("particle_id", *self.keys, "cell", "cy5", "bdp")


# --- association ----------------------------------------------------------


@dataclass(frozen=True)
class Association:
    """C1 for the association model, pooled (``layout.wells == 0``) or with wells.

    ``cell_pool`` and ``particle_pool`` have ``idx`` and ``value``.
    """

    layout: Layout
    times: tuple[float, ...]
    cells: int
    cell_pool: DataFrame
    particle_pool: DataFrame
    seed: int
    method: str = "xxhash64"
    form: str = "balanced"
    prepared: int = 100
    step_seconds: int = 1800
    geometry: Geometry = Geometry()
    channels: tuple[str, ...] = ("value",)

    @property
    def keys(self) -> list[str]:
        return ["time"] + (["rep"] if self.layout.wells else [])

    def _cell_parameters(self, df: DataFrame, key: list, tag: str) -> DataFrame:
        return df.withColumn(
            "r", draws.lognormal_by_moments(self.seed, tag + "r", key, "mean_r", "sigma_r", self.method)
        ).withColumn(
            "K", draws.lognormal_by_moments(self.seed, tag + "K", key, "mean_K", "sigma_K", self.method)
        )

    def exposures(self, particles: DataFrame, stream: str = "") -> DataFrame:
        """Integrated free concentration per particle, well and observation time."""
        hier = self.layout.wells > 0
        wells = ["rep"] if hier else []
        rows = particles.select("particle_id", "theta")
        if hier:
            rows = rows.withColumn("rep", F.explode(F.lit(list(range(1, self.layout.wells + 1)))))
        mean = {
            s: self.layout.well_at(f"mu_{s}", F.col("rep")) if hier else self.layout.at(f"mu_{s}")
            for s in ("r", "K")
        }
        rows = rows.select(
            "particle_id", *wells,
            mean["r"].alias("mean_r"), mean["K"].alias("mean_K"),
            self.layout.at("sigma_r").alias("sigma_r"), self.layout.at("sigma_K").alias("sigma_K"),
        )
        last = round(max(self.times) / self.step_seconds)
        params = ["mean_r", "mean_K", "sigma_r", "sigma_K"]
        fine = uptake.fine_grid(rows, last, self.step_seconds)
        prepared = explode_cells(fine, ["particle_id", *wells], self.prepared)
        prepared = self._cell_parameters(prepared, ["particle_id", *wells, "step", "cell"], stream + "prep-")
        bound = uptake.bound_particles(prepared, "r", "K", geometry=self.geometry)
        group = ["particle_id", *wells, "step", "t", *params]
        free = uptake.mean_free_concentration(bound, group, "bound", self.geometry)
        integral = uptake.cumulative_trapezoid(
            free, ["particle_id", *wells], ["step"], "t", "u", self.geometry.concentration,
            out="exposure", max_rows=last + 1,
        )
        aligned = uptake.align_time(integral, self.times, self.step_seconds)
        return aligned.select("particle_id", *wells, "step", "time", "exposure", *params)

    @cached_property
    def _backgrounds(self) -> Pool:
        """The settled cell pool, shared by all scoring passes."""
        return settle_pool(self.cell_pool.select("idx", F.col("value").cast("double").alias("value")))

    @cached_property
    def _doses(self) -> Pool:
        """The settled particle pool; one table that is both pools is settled, and sent, once."""
        if self.particle_pool is self.cell_pool:
            return self._backgrounds
        return settle_pool(self.particle_pool.select("idx", F.col("value").cast("double").alias("value")))

    def __call__(self, particles: DataFrame, stream: str = "") -> DataFrame:
        """Predicted cells: particle_id, keys, cell, value."""
        pool = self._backgrounds
        wells = ["rep"] if self.layout.wells else []
        cells = explode_cells(self.exposures(particles, stream), ["particle_id", *self.keys], self.cells)
        key = ["particle_id", *wells, "step", "cell"]
        sized = self._cell_parameters(cells, key, stream)
        dosed = sized.withColumn("dose", saturating_uptake("r", "K", "exposure", self.geometry))
        drawn = dosed.withColumn(
            "idx", draws.pool_index(self.seed, stream + "cell", key, float(pool.size), self.method)
        )
        drawn = drawn.select("particle_id", *self.keys, "step", "cell", "dose", "idx")
        seen = pool.look_up(drawn, "idx", value="background")
        summed = uptake.fractional_dose_sum(
            seen, ["particle_id", *wells, "step", "cell"], self._doses, self.seed, stream + "dose",
            form=self.form, method=self.method,
        )
        return summed.select("particle_id", *self.keys, "cell", "value")


# --- scoring --------------------------------------------------------------


def score_particles(
    particles: DataFrame, model: Model, observed: Observed, *, stream: str = "", metric=anderson_darling
) -> DataFrame:
    """Particles with their distance ``rho``; a particle without prediction gets a reason."""
    predicted = model(particles, stream) if stream else model(particles)
    size = getattr(model, "cells", None)  # every predicted sample has this many cells
    scores = discrepancy(predicted, observed, ["particle_id"], metric=metric, max_rows=size)
    scored = match(particles, scores, ["particle_id"], "left", broadcast=False, shuffle=True)
    empty = F.col("rho").isNull() & F.col("reason").isNull()
    return scored.withColumn("reason", F.when(empty, F.lit("nothing predicted")).otherwise(F.col("reason")))
