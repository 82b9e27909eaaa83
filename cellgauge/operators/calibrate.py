"""Round-by-round calibration and its configured runs.

The driver only loops: every step is one Spark plan over all moving particles, and
only scalars and the proposal factor come back. Each round is written to the run's
folder and read again, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.functions import draws
from cellgauge.operators import cells as cell_ops
from cellgauge.operators import particles as parts
from cellgauge.operators import priors
from cellgauge.operators.discrepancy import Observed, observe
from cellgauge.operators.predict import Association, Internalisation, Model, score_particles
from cellgauge.plans.scale import settle, settle_observed
from cellgauge.sources.wells import load_round, save_round

#: A score takes (particles, model, observed, stream=...) and adds ``rho`` and ``reason``.
Score = Callable[..., DataFrame]

METRICS_SCHEMA = (
    "run_id string, round int, threshold double, trial_rate double, repeat long, capped boolean, "
    "steps int, rate double, seconds double, stop string"
)


@dataclass(frozen=True)
class Calibration:
    """Settings of a run. ``cut`` is the share of particles replaced each round."""

    run_id: str
    layout: priors.Layout
    particles: int
    trial: int
    folder: str
    seed: int
    c: float = 0.01
    cut: float = 0.75
    min_rate: float = 0.0
    max_minutes: float = float("inf")
    target: float = float("-inf")
    max_rounds: int | None = None
    max_steps: int | None = None
    method: str = "xxhash64"
    score: Score = score_particles


def stop_rule(config: Calibration, round_no: int, rate: float, threshold: float, seconds: float) -> str | None:
    """Why a run ends after this round, or None."""
    if threshold < config.target:
        return "target"
    if seconds > config.max_minutes * 60:
        return "budget"
    if not rate >= config.min_rate:
        return "min_accept"
    if config.max_rounds is not None and round_no >= config.max_rounds:
        return "max_rounds"
    return None


def move_step(
    moving: DataFrame, config: Calibration, factor, model: Model, observed: Observed, threshold: float, stream: str
) -> tuple[DataFrame, int]:
    """One proposal for every moving particle: R10, C4, C2, C5; and how many moves there were so far."""
    proposed = parts.propose(moving, factor, config.seed, stream + "step", method=config.method)
    passing = parts.mh_filter(
        proposed,
        priors.log_prior(config.layout, "proposal"),
        priors.log_prior(config.layout, "theta"),
        config.seed,
        stream + "accept",
        method=config.method,
    )
    passing = settle(passing.select("particle_id", "proposal"))
    candidates = passing.withColumnRenamed("proposal", "theta")
    scored = config.score(candidates, model, observed, stream=stream).select(
        "particle_id", F.col("theta").alias("proposal"), F.col("rho").alias("rho_new")
    )
    moved = parts.abc_accept(moving, scored, threshold)
    counted = moved.withColumn("moves", F.col("moves") + F.col("moved").cast("int"))
    done, seen = settle_observed(counted, accepted=F.sum("moves"))
    return done, seen["accepted"] or 0


def move_phase(
    moving: DataFrame, config: Calibration, factor, model: Model, observed: Observed, threshold: float, round_no: int
) -> tuple[DataFrame, dict]:
    """Trial steps, then as many more as :func:`particles.repeat_count` asks for.

    The acceptance rate is taken over all steps done, and observed in their own jobs.
    """
    start = moving.withColumn("moves", F.lit(0)).withColumn("moved", F.lit(False))
    moving, seen = settle_observed(start, moving=F.count(F.lit(1)))
    count, accepted = seen["moving"], 0

    def rate_after(steps: int) -> float:
        return accepted / (steps * count) if steps and count else 0.0

    def go(first: int, last: int) -> None:
        nonlocal moving, accepted
        for step in range(first, last + 1):
            moving, accepted = move_step(
                moving, config, factor, model, observed, threshold, f"{round_no}-{step}-"
            )

    go(1, config.trial)
    trial_rate = rate_after(config.trial)
    one = moving.sparkSession.range(1)
    repeat = one.select(parts.repeat_count(F.lit(trial_rate), config.c)).first()[0]
    wanted = repeat if repeat is not None else (config.max_steps or config.trial)
    total = max(config.trial, wanted)
    capped = config.max_steps is not None and total > config.max_steps
    if capped:
        total = max(config.trial, config.max_steps)
    go(config.trial + 1, total)
    return moving.drop("moves", "moved"), {
        "trial_rate": trial_rate,
        "repeat": repeat,
        "capped": capped or repeat is None,
        "steps": total,
        "rate": rate_after(total),
    }


def initial_particles(spark: SparkSession, config: Calibration, model: Model, observed: Observed) -> DataFrame:
    """Particles from the prior with their distances."""
    drawn = settle(priors.prior_table(spark, config.layout, config.particles, config.seed, method=config.method))
    if not drawn.filter("exhausted").isEmpty():
        raise ValueError("a truncated draw found no value; choose another seed or prior")
    scored = config.score(drawn.select("particle_id", "theta"), model, observed, stream="0-0-")
    return settle(scored.select("particle_id", "theta", F.coalesce("rho", F.lit(float("inf"))).alias("rho")))


def calibrate(
    spark: SparkSession, config: Calibration, model: Model, observed: Observed, *, after_round: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Rounds of C3-C6 until T3, each saved (S8). Returns particles and round metrics.

    ``after_round`` goes on from a saved round, after a lost driver for instance. Draws
    are keyed by round and step, so the rounds that follow are those of an
    uninterrupted run.
    """
    if after_round:
        saved = load_round(spark, config.folder, config.run_id, after_round)
        state = saved.select("particle_id", "theta", "rho")
    else:
        state = initial_particles(spark, config, model, observed)
    rounds: list[dict] = []
    elapsed, round_no, stop = 0.0, after_round, None
    while stop is None:
        round_no += 1
        began = time.monotonic()
        resampled, threshold = parts.select_resample(
            state, config.cut, config.seed, stream=f"resample-{round_no}", method=config.method
        )
        resampled = settle(resampled)
        m = len(config.layout.names)
        factor = parts.proposal_factor(parts.particle_covariance(resampled, m), m)
        moving, report = move_phase(
            resampled.filter("replaced").select("particle_id", "theta", "rho"),
            config, factor, model, observed, threshold, round_no,
        )
        kept = resampled.filter("not replaced").select("particle_id", "theta", "rho")
        save_round(kept.unionByName(moving), config.folder, config.run_id, round_no)
        state = load_round(spark, config.folder, config.run_id, round_no).select("particle_id", "theta", "rho")
        seconds = time.monotonic() - began
        elapsed += seconds
        stop = stop_rule(config, round_no, report["rate"], threshold, elapsed)
        rounds.append(
            {"run_id": config.run_id, "round": round_no, "threshold": threshold, "seconds": seconds, "stop": stop, **report}
        )
    return state, round_metrics(spark, rounds)


def round_metrics(spark: SparkSession, rounds: Sequence[dict]) -> DataFrame:
    """One row per round."""
    names = [part.split()[0] for part in METRICS_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rounds], METRICS_SCHEMA)


# --- configured runs ------------------------------------------------------


@dataclass(frozen=True)
class Run:
    """A published workload. Fixed values."""

    model: str
    mode: str
    scenario: str
    particles: int
    trial: int
    cells: int
    cut: float
    min_rate: float
    c: float = 0.01
    wells: int = 3


RUNS = [
    Run("internalisation", "hierarchical", "real", 1000, 20, 1000, 0.75, 0.0),
    Run("internalisation", "hierarchical", "uncorrupted", 10_000, 20, 1000, 0.75, 0.0),
    Run("internalisation", "hierarchical", "corrupted", 10_000, 20, 1000, 0.75, 0.0),
    Run("internalisation", "pooled", "uncorrupted", 2000, 10, 1000, 0.75, 0.001),
    Run("internalisation", "pooled", "corrupted", 2000, 10, 1000, 0.75, 0.001),
    Run("association", "hierarchical", "uncorrupted", 2000, 50, 20_000, 0.5, 0.0),
    Run("association", "hierarchical", "corrupted", 2000, 50, 20_000, 0.5, 0.0),
    Run("association", "hierarchical", "corrupted2", 2000, 50, 20_000, 0.5, 0.0),
    Run("association", "pooled", "uncorrupted", 2000, 50, 20_000, 0.5, 0.0),
    Run("association", "pooled", "corrupted", 2000, 50, 20_000, 0.5, 0.0),
    Run("association", "pooled", "corrupted2", 2000, 50, 20_000, 0.5, 0.0),
]

ASSOCIATION_TIMES = tuple(3600.0 * h for h in (1, 2, 4, 8, 16, 24))  # fixed values, hours to seconds


def layout_of(run: Run) -> priors.Layout:
    if run.model == "internalisation":
        return priors.INTERNALISATION_POOLED if run.mode == "pooled" else priors.internalisation_hierarchical(run.wells)
    if run.mode == "pooled":
        return priors.association_pooled(run.scenario)
    return priors.association_hierarchical(run.scenario, run.wells)


@dataclass(frozen=True)
class Controls:
    """What the models need beside particles.

    Internalisation: times, ``pool`` (idx, cy5, bdp) and ``eta``. Association:
    ``cell_pool`` and ``particle_pool`` (idx, value).
    """

    times: tuple[float, ...]
    pool: DataFrame | None = None
    eta: float | None = None
    cell_pool: DataFrame | None = None
    particle_pool: DataFrame | None = None


def controls_from_cells(df: DataFrame) -> Controls:
    """Times, background pool and quench efficiency of a cell table (signal_cy5, signal_bdp, cell_id)."""
    times = tuple(r[0] for r in cell_ops.distinct_times(df).collect())  # one per observation time
    renamed = df.withColumnRenamed("signal_cy5", "cy5").withColumnRenamed("signal_bdp", "bdp")
    pool = settle(cell_ops.background_pool(renamed, ["cy5", "bdp"], ["cell_id"]))
    eta = cell_ops.quench_efficiency(renamed, "cy5").first()["eta"]
    return Controls(times, pool=pool, eta=eta)


def observed_from_cells(df: DataFrame, times: Sequence[float], cells: int, wells: int) -> DataFrame:
    """The first ``cells`` warm cells of every time, well and condition, one column per channel."""
    warm = df.filter((F.col("temp") == 37.0) & F.col("time").isin(list(times)) & F.col("repeat").between(1, wells))
    named = warm.select(
        "time", F.col("repeat").cast("int").alias("rep"), "quenched", "cell_id",
        F.col("signal_cy5").alias("cy5"), F.col("signal_bdp").alias("bdp"),
    )
    return cell_ops.first_n_per_group(named, ["time", "rep", "quenched"], ["cell_id"], cells)


def model_of(run: Run, layout: priors.Layout, controls: Controls, seed: int, **options) -> Model:
    if run.model == "internalisation":
        return Internalisation(
            layout, tuple(controls.times), run.cells, settle(controls.pool), controls.eta, seed, **options
        )
    return Association(
        layout, tuple(controls.times), run.cells, controls.cell_pool, controls.particle_pool, seed, **options
    )


def execute(
    spark: SparkSession, run: Run, observed_cells: DataFrame, controls: Controls, folder: str, seed: int, **settings
) -> tuple[DataFrame, DataFrame]:
    """A configured run. ``observed_cells`` is wide, with ``rep``; pooling forgets it."""
    layout = layout_of(run)
    model = model_of(run, layout, controls, seed)
    if run.mode == "pooled":
        observed_cells = cell_ops.pool_replicates(observed_cells)
    observed = observe(observed_cells, model.keys, model.channels)
    config = Calibration(
        run_id=f"{run.model}-{run.mode}-{run.scenario}", layout=layout, particles=run.particles, trial=run.trial,
        folder=folder, seed=seed, c=run.c, cut=run.cut, min_rate=run.min_rate, **settings,
    )
    return calibrate(spark, config, model, observed)


def run_pooled(spark, run: Run, observed_cells, controls, folder, seed, **settings):
    """C8 with all wells merged."""
    return execute(spark, replace(run, mode="pooled"), observed_cells, controls, folder, seed, **settings)


def run_hierarchical(spark, run: Run, observed_cells, controls, folder, seed, **settings):
    """C8 with one set of means per well."""
    return execute(spark, replace(run, mode="hierarchical"), observed_cells, controls, folder, seed, **settings)


# --- synthetic scenarios --------------------------------------------------

# True shared parameters and the altered wells of each scenario.
# A negative well number counts from the last well.
TRUE_SHARED = {
    "internalisation": {
        "sigma_lambda": 0.01, "sigma_beta": 0.05, "sigma_R": 0.25, "m_lambda": 0.08, "m_beta": 0.05, "m_R": 0.05,
        "s_lambda": 0.01, "s_beta": 0.005, "s_R": 0.01, "sigma_1": 5.0, "sigma_2": 2.0, "alpha_1": 8500.0,
        "alpha_2": 38.0, "p": 0.075, "omega_lambda": 0.9, "omega_beta": -1.0,
    },
    "association": {
        "sigma_r": 4.56962e-7, "sigma_K": 2.0, "m_r": 3.86125e-7, "m_K": 10.0, "s_r": 0.0, "s_K": 0.0,
    },
}
ALTERED = {
    "internalisation": [
        ("corrupted", 1, "mu_lambda", 0.02),
        ("corrupted2", 1, "mu_lambda", 0.02),
        ("corrupted2", -1, "mu_lambda", 0.14),
    ],
    "association": [
        ("corrupted", 1, "mu_r", 9e-7),
        ("corrupted2", 1, "mu_r", 9e-7),
        ("corrupted2", 2, "mu_K", 20.0),
    ],
}
SCENARIOS = ["uncorrupted", "corrupted", "corrupted2"]


def true_parameters(spark: SparkSession, model: str, layout: priors.Layout, seed: int) -> DataFrame:
    """The parameter table (scenario, well, param, value) of all scenarios.

    Well means are drawn once and shared by the scenarios; then single wells are altered.
    """
    shared = TRUE_SHARED[model]
    one = spark.range(1, 2).withColumnRenamed("id", "particle_id")
    for g in layout.groups:
        one = one.select(
            "*",
            *[
                draws.truncated_normal(
                    seed, g.name, ["particle_id", F.lit(w)], shared[g.mean], shared[g.spread]
                ).alias(f"{g.name}_{w}")
                for w in range(1, layout.wells + 1)
            ],
        )
    one = one.select("*", *[F.lit(v).alias(k) for k, v in shared.items()])
    long = priors.unpack_theta(priors.pack_theta(one, layout), layout)
    base = long.select("well", "param", "value").withColumn("scenario", F.explode(F.lit(SCENARIOS)))
    changes = [(s, w if w > 0 else layout.wells + 1 + w, p, v) for s, w, p, v in ALTERED[model]]
    altered = spark.createDataFrame(changes, "scenario string, well int, param string, value double")
    return priors.override_parameter(base, altered).select("scenario", "well", "param", "value")


def synthesise_scenarios(
    spark: SparkSession, model_name: str, model: Model, layout: priors.Layout, seed: int
) -> tuple[DataFrame, DataFrame]:
    """Predicted cells of every scenario for known parameters, and those parameters."""
    truth = settle(true_parameters(spark, model_name, layout, seed))
    positions = priors.dimension_table(spark, layout).select("position", "param", "well")
    placed = truth.join(
        F.broadcast(positions.withColumnRenamed("well", "__well").withColumnRenamed("param", "__param")),
        (F.col("param") == F.col("__param")) & F.col("well").eqNullSafe(F.col("__well")),
    )
    number = F.array_position(F.lit(SCENARIOS), F.col("scenario")).cast("long")
    vectors = priors.theta_from_long(placed.withColumn("particle_id", number))
    samples = model(vectors).withColumn(
        "scenario", F.element_at(F.lit(SCENARIOS), F.col("particle_id").cast("int"))
    )
    return samples.drop("particle_id"), truth
