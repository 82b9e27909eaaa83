"""Selection among candidates that a table holds, round by round to the stop rule.

A candidate is a key of a cell table; its cells are its rows there, so its distance to
the observed samples is a property of the table and is found once for all candidates,
in one pass. A population of particles then walks over the candidates: the worst are
replaced by copies of the rest, copies move along the order of the candidates, and a
move counts if the new candidate is close enough.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.functions import draws
from cellgauge.operators import particles as parts
from cellgauge.operators.discrepancy import Metric, Observed, discrepancy
from cellgauge.operators.ecdf import anderson_darling
from cellgauge.plans.scale import BROADCAST_BYTES, match, number_rows, settle, settle_observed
from cellgauge.sources.wells import load_round, save_round

METRICS_SCHEMA = (
    "run_id string, round int, threshold double, width long, moving long, trial_rate double, repeat long, steps int, "
    "accepted long, rate double, seconds double, stop string"
)
CANDIDATE_BYTES = 40  # place, distance and prior of a candidate


@dataclass(frozen=True)
class Selection:
    """Settings of a run. ``cut`` is the share of particles replaced each round, ``block`` the moves in one job."""

    run_id: str
    folder: str
    seed: int
    trial: int
    c: float = 0.01
    cut: float = 0.75
    min_rate: float = 0.0
    target: float = float("-inf")
    max_minutes: float = float("inf")
    method: str = "xxhash64"
    block: int = 8


def candidates(
    cells: DataFrame, observed: Observed, key: str, order: Column, log_prior: Column | None = None, *, metric: Metric = anderson_darling
) -> DataFrame:
    """C2 over a table: (candidate_id, place, rho, log_prior) for every value of ``key``.

    ``order`` and ``log_prior`` are aggregates over a candidate's cells; candidates are
    placed 1, 2, 3 ... by ``order``, then by id, and differ little from their neighbours. One
    that lacks an observed sample is farther than any other.
    """
    scored = discrepancy(cells, observed, [key], metric=metric).select(key, F.coalesce("rho", F.lit(float("inf"))).alias("rho"))
    prior = F.lit(0.0) if log_prior is None else log_prior
    traits = cells.groupBy(key).agg(order.alias("trait"), prior.alias("log_prior"))
    placed = number_rows(traits.select(F.col(key).alias("candidate_id"), "trait", "log_prior"), ["trait", "candidate_id"], "place")
    joined = match(placed, scored.withColumnRenamed(key, "candidate_id"), ["candidate_id"], "inner", broadcast=False)
    return settle(joined.select("candidate_id", "place", "rho", "log_prior"))


def stop_reason(
    round_no: Column, rate: Column, threshold: Column, seconds: Column, *,
    min_rate: float = 0.0, target: float = float("-inf"), max_minutes: float = float("inf"), max_rounds: int | None = None,
) -> Column:
    """T3 as a column: why a run ends after a round, or null. An undefined rate is too low."""
    low = ~F.coalesce(~F.isnan(rate) & (rate >= F.lit(float(min_rate))), F.lit(False))
    reason = F.when(threshold < F.lit(float(target)), "target").when(seconds > F.lit(max_minutes * 60.0), "budget").when(low, "min_accept")
    return reason if max_rounds is None else reason.when(round_no >= F.lit(max_rounds), "max_rounds")


def first_stop(rounds: DataFrame, run: Sequence[str], round_column: str = "round", **rule) -> DataFrame:
    """T3 over a table of rounds: for every run the first round it ends after, and why; runs without one are left out.

    ``rounds`` has rate, threshold and seconds. One aggregation; no run is sorted.
    """
    reason = stop_reason(F.col(round_column), F.col("rate"), F.col("threshold"), F.col("seconds"), **rule)
    ended = rounds.withColumn("stop", reason).filter(F.col("stop").isNotNull())
    first = ended.groupBy(*run).agg(F.min(F.struct(round_column, "stop")).alias("__first"))
    return first.select(*run, F.col("__first")[round_column].alias(round_column), F.col("__first")["stop"].alias("stop"))


def proposal_width(population: DataFrame, place: str = "place") -> Column:
    """A14 in one dimension: the longest step, 2.38 standard deviations of the places, at least 1."""
    spread = F.coalesce(F.stddev_samp(F.col(place).cast("double")), F.lit(0.0))
    return F.greatest(F.lit(1), F.ceil(2.38 * spread)).cast("long")


def moves(
    moving: DataFrame, scores: DataFrame, config: Selection, round_no: int, steps: Sequence[int], threshold: float, width: int, *, few: bool
) -> DataFrame:
    """R10, C4, J7, C5 for several steps in one plan: every particle proposes a neighbour and takes it or not.

    A step is even over 1 to ``width`` places in both directions, so the proposal is
    symmetric; places that no candidate has are refused, as are those less likely
    than the draw allows. Nothing is shuffled while the scores are ``few``.
    """
    keyed = scores.select(
        F.col("place").alias("__to"), F.col("rho").alias("__rho"), F.col("log_prior").alias("__log_prior")
    ).filter(F.col("__rho") <= F.lit(threshold))  # farther ones are never taken
    for step in steps:
        key = [F.lit(round_no), F.lit(step), F.col("particle_id")]
        drawn = draws.pool_index(config.seed, "step", key, float(2 * width), config.method)
        u = draws.uniform(config.seed, "accept", key, method=config.method)
        proposed = moving.withColumn("__to", F.col("place") + F.when(drawn <= width, -drawn).otherwise(drawn - width))
        joined = match(proposed, keyed, ["__to"], "left", broadcast=few)
        taken = F.col("__rho").isNotNull() & (F.log(u) <= F.least(F.lit(0.0), F.col("__log_prior") - F.col("log_prior")))
        taken = F.coalesce(taken, F.lit(False))
        moving = joined.select(
            "particle_id",
            *[F.when(taken, F.col(new)).otherwise(F.col(old)).alias(old) for old, new in (("place", "__to"), ("rho", "__rho"), ("log_prior", "__log_prior"))],
            (F.col("moves") + taken.cast("long")).alias("moves"),
        )
    return moving


def move_phase(
    moving: DataFrame, scores: DataFrame, config: Selection, round_no: int, threshold: float, width: int, *, few: bool
) -> tuple[DataFrame, dict]:
    """Trial steps, then as many more as the acceptance asks for, without a bound.

    Acceptance is observed in the jobs that make the steps (A15).
    """
    spark = moving.sparkSession
    seen = {"accepted": 0, "moving": 0}

    def go(first: int, last: int) -> None:
        nonlocal moving, seen
        for start in range(first, last + 1, config.block):
            steps = range(start, min(start + config.block, last + 1))
            moved = moves(moving, scores, config, round_no, steps, threshold, width, few=few)
            moving, seen = settle_observed(moved, accepted=F.sum("moves"), moving=F.count(F.lit(1)))

    go(1, config.trial)
    attempted = seen["moving"] * config.trial
    trial_rate = (seen["accepted"] or 0) / attempted if attempted else 0.0
    repeat = spark.range(1).select(parts.repeat_count(F.lit(trial_rate), config.c)).first()[0]
    total = max(config.trial, repeat or config.trial)
    go(config.trial + 1, total)
    accepted = seen["accepted"] or 0
    rate = accepted / (seen["moving"] * total) if seen["moving"] else 0.0
    report = {"trial_rate": trial_rate, "repeat": repeat, "steps": total, "accepted": accepted, "moving": seen["moving"], "rate": rate}
    return moving.drop("moves"), report


def save_metrics(spark: SparkSession, config: Selection, row: dict) -> None:
    """Append the row of a round to the run's metrics."""
    names = [part.split()[0] for part in METRICS_SCHEMA.split(", ")]
    made = spark.createDataFrame([tuple(row[n] for n in names)], METRICS_SCHEMA)
    made.coalesce(1).write.mode("append").parquet(f"{config.folder}/_metrics")


def load_metrics(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """One row a round; of a round that was run again, the last."""
    rows = spark.read.schema(METRICS_SCHEMA).parquet(f"{folder}/_metrics").filter(F.col("run_id") == run_id)
    return rows.dropDuplicates(["run_id", "round"])


def select(
    spark: SparkSession, config: Selection, scores: DataFrame, particles: DataFrame | None = None, *, after_round: int = 0
) -> tuple[DataFrame, DataFrame]:
    """C3-C7 over a table: rounds until T3. Returns (particle_id, place, rho) and the metrics of the rounds.

    ``scores`` comes from :func:`candidates`; ``particles`` has particle_id and place, by
    default one particle at every candidate. Each round is saved whole (S8) and can be
    gone on from. There is no bound on steps or rounds besides the rule's: thresholds
    never rise, and a population that cannot move any more has a rate below any
    ``min_rate`` above 0.
    """
    if not (config.min_rate > 0 or config.target > float("-inf") or config.max_minutes < float("inf")):
        raise ValueError("a run needs min_rate, target or max_minutes to end")
    scores = settle(scores.select("candidate_id", "place", "rho", "log_prior"))
    few = scores.count() * CANDIDATE_BYTES <= BROADCAST_BYTES
    if after_round:
        state = load_round(spark, config.folder, config.run_id, after_round).select("particle_id", "theta", "rho")
    else:
        start = scores.select(F.col("candidate_id").alias("particle_id"), "place") if particles is None else particles
        scored = match(start.select("particle_id", "place"), scores.select("place", "rho"), ["place"], "inner", broadcast=few)
        state = scored.select("particle_id", F.array(F.col("place").cast("double")).alias("theta"), "rho")
    elapsed, round_no, stop = 0.0, after_round, None
    while stop is None:
        round_no += 1
        began = time.monotonic()
        resampled, threshold = parts.select_resample(state, config.cut, config.seed, stream=f"resample-{round_no}", method=config.method)
        placed = resampled.select("particle_id", F.col("theta")[0].cast("long").alias("place"), "rho", "replaced")
        placed, seen = settle_observed(placed, width=proposal_width(placed), moving=F.sum(F.col("replaced").cast("long")))
        priors = scores.select("place", "log_prior")
        moving = match(placed.filter("replaced").drop("replaced"), priors, ["place"], "inner", broadcast=few)
        moving = moving.withColumn("moves", F.lit(0).cast("long"))
        moving, report = move_phase(moving, scores, config, round_no, threshold, seen["width"], few=few)
        whole = placed.filter("not replaced").select("particle_id", "place", "rho").unionByName(moving.select("particle_id", "place", "rho"))
        save_round(whole.select("particle_id", F.array(F.col("place").cast("double")).alias("theta"), "rho"), config.folder, config.run_id, round_no)
        state = load_round(spark, config.folder, config.run_id, round_no).select("particle_id", "theta", "rho")
        seconds = time.monotonic() - began
        elapsed += seconds
        rule = dict(min_rate=config.min_rate, target=config.target, max_minutes=config.max_minutes)
        values = (F.lit(round_no), F.lit(report["rate"]), F.lit(float(threshold)), F.lit(elapsed))
        stop = spark.range(1).select(stop_reason(*values, **rule)).first()[0]
        row = {"run_id": config.run_id, "round": round_no, "threshold": threshold, "width": seen["width"], "seconds": seconds, "stop": stop, **report}
        save_metrics(spark, config, row)
    final = state.select("particle_id", F.col("theta")[0].cast("long").alias("place"), "rho")
    return final, load_metrics(spark, config.folder, config.run_id)
