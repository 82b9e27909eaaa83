import dataclasses
import uuid

import pytest
from pyspark.sql import functions as F

from cellgauge.operators import selection as sel
from cellgauge.plans import scale
from cellgauge.sources import wells as io


def scores(spark, n=60):
    """Candidates in a valley: the farther from place 20, the worse; the worst have no distance."""
    rows = [(1000 + p, p, float("inf") if p > n - 3 else abs(p - 20) + 0.01 * (p % 7), 0.1 * (p % 3)) for p in range(1, n + 1)]
    return spark.createDataFrame(rows, "candidate_id long, place long, rho double, log_prior double").repartition(3)


def config(folder, **changes):
    return dataclasses.replace(sel.Selection("r", str(folder), seed=5, trial=3, c=0.2, cut=0.75, min_rate=0.3), **changes)


def pairs(df):
    return sorted((r.particle_id, r.place, r.rho) for r in df.collect())


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("selection")
    table = scores(spark)
    final, metrics = sel.select(spark, config(folder / "a"), table)
    return folder, table, pairs(final), metrics.orderBy("round").collect()


def test_a_run_goes_on_to_the_rule(spark, whole):
    _, table, final, rounds = whole
    assert len(final) == 60 and [r["round"] for r in rounds] == list(range(1, len(rounds) + 1)) and len(rounds) > 1
    thresholds = [r["threshold"] for r in rounds]
    assert thresholds == sorted(thresholds, reverse=True)
    assert [r["stop"] for r in rounds] == [None] * (len(rounds) - 1) + ["min_accept"]
    assert all(r["rate"] >= 0.3 for r in rounds[:-1]) and rounds[-1]["rate"] < 0.3
    assert all(r["steps"] == max(3, r["repeat"] or 3) for r in rounds)
    assert all(r["rate"] == r["accepted"] / (r["moving"] * r["steps"]) for r in rounds)
    distance = {r.place: r.rho for r in table.collect()}
    assert all(distance[place] == rho <= thresholds[-1] for _, place, rho in final)


def test_blocks_joins_and_resumed_runs_agree(spark, whole, monkeypatch):
    folder, table, final, rounds = whole
    monkeypatch.setattr(sel, "BROADCAST_BYTES", 0)
    assert pairs(sel.select(spark, config(folder / "b", block=3), table.repartition(7))[0]) == final
    monkeypatch.undo()
    resumed, metrics = sel.select(spark, config(folder / "a"), table, after_round=1)
    assert pairs(resumed) == final
    again = metrics.orderBy("round").collect()
    assert [(r["round"], r["rate"], r["stop"]) for r in again] == [(r["round"], r["rate"], r["stop"]) for r in rounds]


def test_odd_populations(spark, tmp_path):
    with pytest.raises(ValueError):
        sel.select(spark, config(tmp_path, min_rate=0.0), scores(spark))
    one = spark.createDataFrame([(7, 1, 2.0, 0.0)], "candidate_id long, place long, rho double, log_prior double")
    final, metrics = sel.select(spark, config(tmp_path / "one", cut=0.0), one)
    assert pairs(final) == [(7, 1, 2.0)] and metrics.first()["stop"] == "min_accept"
    many = spark.createDataFrame([(i, 1 + i % 60) for i in range(300)], "particle_id long, place long")
    final, _ = sel.select(spark, config(tmp_path / "many"), scores(spark), many)
    assert final.count() == 300


def test_stop_reasons(spark):
    rows = [(1, 0.5, 4.0, 0.0), (1, 0.5, 6.0, 61.0), (1, 0.001, 6.0, 1.0), (1, None, 6.0, 1.0), (1, float("nan"), 6.0, 1.0), (9, 0.5, 6.0, 1.0), (1, 0.5, 6.0, 1.0)]
    df = spark.createDataFrame(rows, "round int, rate double, threshold double, seconds double")
    reason = sel.stop_reason(*[F.col(c) for c in ("round", "rate", "threshold", "seconds")], min_rate=0.01, target=5, max_minutes=1, max_rounds=9)
    assert [r[0] for r in df.select(reason).collect()] == ["target", "budget", "min_accept", "min_accept", "min_accept", "max_rounds", None]


def jobs(spark, action):
    context = spark.sparkContext
    context.setJobGroup(name := f"jobs-{uuid.uuid4().hex}", "")
    action()
    context._jsc.sc().listenerBus().waitUntilEmpty(20_000)  # the tracker learns of jobs from events
    found = context.statusTracker().getJobIdsForGroup(name)
    context.setLocalProperty("spark.jobGroup.id", None)
    return len(found)


def test_observed_scalars_cost_no_job(spark):
    table = lambda: scores(spark).groupBy("place").agg(F.sum("rho").alias("rho"))
    plain = jobs(spark, lambda: scale.settle(table()))
    assert jobs(spark, lambda: scale.settle_observed(table(), s=F.sum("rho"))) == plain
    assert jobs(spark, lambda: scale.settle(table()).agg(F.sum("rho")).first()) > plain
    assert scale.settle_observed(table(), n=F.count(F.lit(1)))[1] == {"n": 60}


def test_a_round_lost_in_mid_write_leaves_the_old_one(spark, tmp_path):
    folder = str(tmp_path / "rounds")
    df = spark.createDataFrame([(i, [float(i), 2.0], float(i)) for i in range(40)], "particle_id long, theta array<double>, rho double").repartition(4)
    with pytest.raises(Exception):
        io.load_round(spark, folder, "r", 1)
    io.save_round(df, folder, "r", 1)
    broken = df.withColumn("rho", F.when(F.col("particle_id") == 39, F.raise_error(F.lit("lost"))).otherwise(0.0))
    with pytest.raises(Exception):
        io.save_round(broken, folder, "r", 1)
    df.withColumn("rho", F.lit(-1.0)).write.parquet(f"{folder}/run_id=r/round=1/attempt=whole-but-unsaid")
    read = lambda n=1: sorted((r.particle_id, tuple(r.theta), r.rho) for r in io.load_round(spark, folder, "r", n).collect())
    assert read() == [(i, (float(i), 2.0), float(i)) for i in range(40)]
    io.save_round(df.withColumn("rho", F.lit(3.0)), folder, "r", 1)
    io.save_round(df, folder, "r", 2)
    io.save_round(df, folder, "other", 1)
    assert {r[2] for r in read()} == {3.0} and len(read(None)) == 80
    assert io.load_round(spark, folder, "r", 7).count() == 0
