import dataclasses
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import calibrate as cal
from cellgauge.operators import particles as parts
from cellgauge.operators import predict, priors, summaries
from cellgauge.operators.discrepancy import discrepancy, observe
from cellgauge.plans.scale import settle
from cellgauge.sources.wells import load_round


def scored(spark, n=101, seed=0):
    rng = np.random.default_rng(seed)
    rho = np.round(rng.random(n), 1)  # many ties
    rows = [(i, [float(i), float(i) ** 2], float(r)) for i, r in enumerate(rho, 1)]
    return spark.createDataFrame(rows, "particle_id long, theta array<double>, rho double").repartition(3), rows


@pytest.mark.parametrize("fraction", [0.75, 0.5, 0.0])
def test_threshold_and_keep_best(spark, fraction):
    df, rows = scored(spark)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    nl = len(rows) - math.floor(fraction * len(rows))
    row = parts.survival_threshold(df, fraction).first()
    assert (row["threshold"], row["n"], row["kept"]) == (order[nl - 1][2], len(rows), nl)
    kept = {r["particle_id"] for r in parts.keep_best(df, fraction).collect()}
    assert kept == {r[0] for r in order[:nl]}


def test_rank_by_distance(spark):
    df, rows = scored(spark)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    got = {r["particle_id"]: r["position"] for r in parts.rank_by_distance(df).collect()}
    assert got == {r[0]: i for i, r in enumerate(order, 1)}


def test_resample_copies_vector_and_distance(spark):
    df, rows = scored(spark)
    out, threshold = parts.select_resample(df, 0.75, seed=3)
    out = out.collect()
    source = {r[0]: r for r in rows}
    assert len(out) == 101 and len({r["particle_id"] for r in out}) == 101
    assert sum(r["replaced"] for r in out) == 75
    for r in out:
        assert r["theta"] == source[r["parent_id"]][1] and r["rho"] == source[r["parent_id"]][2] <= threshold


def test_covariance_and_proposal(spark):
    rng = np.random.default_rng(1)
    x = rng.multivariate_normal([0, 1e6, 5], [[1e-12, 1e-7, 0], [1e-7, 4e4, 0], [0, 0, 0]], 400)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "particle_id long, theta array<double>")
    cov = parts.particle_covariance(df, 3)
    want = np.cov(x.T) * 2.38**2 / 3
    for r in cov.collect():
        assert r["value"] == pytest.approx(want[r["i"] - 1, r["j"] - 1], rel=1e-8, abs=1e-18)
    factor = parts.proposal_factor(cov, 3)
    assert np.allclose(factor @ factor.T, want, rtol=1e-6)
    steps = parts.propose(df, factor, 1, "s").collect()
    delta = np.array([np.array(r["proposal"]) - np.array(r["theta"]) for r in steps])
    assert np.all(delta[:, 2] == 0) and abs(delta[:, 1].std() / np.sqrt(want[1, 1]) - 1) < 0.15
    assert np.corrcoef(delta[:, :2].T)[0, 1] == pytest.approx(np.corrcoef(x[:, :2].T)[0, 1], abs=0.15)


def test_mh_filter_and_accept(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0), (2, float("-inf"), 0.0), (3, 5.0, 0.0), (4, -50.0, 0.0), (5, float("inf"), float("inf"))],
        "particle_id long, new double, old double",
    )
    passed = {r["particle_id"] for r in parts.mh_filter(df, F.col("new"), F.col("old"), 1, "u").collect()}
    assert passed == {1, 3}
    state = spark.createDataFrame([(i, [0.0], 9.0, "x") for i in (1, 2, 3)], "particle_id long, theta array<double>, rho double, tag string")
    new = spark.createDataFrame([(1, [1.0], 5.0), (2, [2.0], 5.1), (3, [3.0], None)], "particle_id long, proposal array<double>, rho_new double")
    got = {r["particle_id"]: (r["theta"][0], r["rho"], r["moved"], r["tag"]) for r in parts.abc_accept(state, new, 5.0).collect()}
    assert got == {1: (1.0, 5.0, True, "x"), 2: (0.0, 9.0, False, "x"), 3: (0.0, 9.0, False, "x")}


def test_acceptance_and_repeats(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.02,), (0.5,)], "rate double")
    got = [r[0] for r in df.select(parts.repeat_count("rate", 0.01)).collect()]
    assert got == [None, 1, 228, 7]
    rate = parts.acceptance_rate(spark.createDataFrame([(True,), (False,), (None,), (True,)], "moved boolean")).first()
    assert (rate["accepted"], rate["attempted"], rate["rate"]) == (2, 4, 0.5)


def pools(spark):
    rng = np.random.default_rng(3)
    pool = pd.DataFrame({"idx": np.arange(1, 41), "cy5": rng.gamma(2, 20, 40), "bdp": rng.gamma(2, 2, 40)})
    single = pd.DataFrame({"idx": np.arange(1, 31), "value": rng.gamma(3, 15, 30)})
    return settle(spark.createDataFrame(pool)), settle(spark.createDataFrame(single))


def internalisation(spark, wells, cells, **options):
    layout = priors.internalisation_hierarchical(wells) if wells else priors.INTERNALISATION_POOLED
    return layout, predict.Internalisation(layout, (10.0, 60.0), cells, pools(spark)[0], 0.95, 7, **options)


@pytest.mark.parametrize("wells", [0, 2])
def test_internalisation_prediction(spark, wells):
    layout, model = internalisation(spark, wells, 50)
    particles = priors.prior_table(spark, layout, 4, seed=2).select("particle_id", "theta")
    cells = settle(model(particles))
    groups = 4 * 2 * 2 * max(wells, 1)
    assert cells.count() == groups * 50
    assert cells.filter("cy5 is null or bdp is null").count() == 0
    again = model(particles.repartition(5))
    keys = ["particle_id", *model.keys, "cell"]
    both = cells.join(again.withColumnRenamed("cy5", "c2").select(*keys, "c2"), keys)
    off = both.filter("cy5 != c2").select("cy5", "c2").collect()
    assert both.count() == groups * 50 and not off, off[:5]
    shared = {**cal.TRUE_SHARED["internalisation"], "mu_lambda": 0.08, "mu_beta": 0.05, "mu_R": 0.05}
    theta = [shared.get(n, shared.get(n.rsplit("_", 1)[0])) for n in layout.names]
    many = dataclasses.replace(model, cells=4000)
    cells = many(spark.createDataFrame([(1, theta)], "particle_id long, theta array<double>"))
    quenched = cells.filter("time = 10").groupBy("quenched").agg(F.median("cy5").alias("m")).collect()
    means = {r["quenched"]: r["m"] for r in quenched}
    assert means[True] < means[False]


@pytest.mark.parametrize("wells", [0, 2])
def test_association_prediction(spark, wells):
    layout = priors.association_hierarchical("corrupted", wells) if wells else priors.association_pooled("corrupted")
    cell_pool = pools(spark)[1]
    particle_pool = settle(cell_pool.withColumn("value", F.lit(10.0)))
    model = predict.Association(layout, (3600.0, 14400.0, 86400.0), 40, cell_pool, particle_pool, 5, prepared=20)
    theta = [4e-7] * wells + [10.0] * wells + [1e-7, 1.0] + ([4e-7, 10.0] + ([1e-8, 0.1] if wells else []))
    particles = spark.createDataFrame([(1, theta), (2, theta)], "particle_id long, theta array<double>")
    exposure = model.exposures(particles).collect()
    assert len(exposure) == 2 * 3 * max(wells, 1)
    for r in exposure:
        assert 0.85 < r["exposure"] / (9.95e7 * r["time"]) <= 1.0
    cells = settle(model(particles))
    assert cells.count() == 2 * 3 * max(wells, 1) * 40 and cells.filter("value is null").count() == 0
    means = [r["m"] for r in cells.groupBy("time").agg(F.avg("value").alias("m")).orderBy("time").collect()]
    assert means == sorted(means)


def test_one_pass_scores_equal_general_discrepancy(spark):
    layout, model = internalisation(spark, 2, 60)
    particles = priors.prior_table(spark, layout, 5, seed=2).select("particle_id", "theta")
    seen = observe(model(particles.filter("particle_id = 1").withColumn("particle_id", F.lit(99).cast("long"))).drop("particle_id"), model.keys, ["cy5", "bdp"])
    predicted = settle(model(particles))
    fast = {r["particle_id"]: r["rho"] for r in discrepancy(predicted, seen, ["particle_id"], max_rows=60).collect()}
    general = {r["particle_id"]: r["rho"] for r in discrepancy(predicted, seen, ["particle_id"], hot_rows=10).collect()}
    assert len(fast) == 5 and fast == pytest.approx(general)
    scored_particles = {r["particle_id"]: r for r in predict.score_particles(particles, model, seen).collect()}
    assert {k: r["rho"] for k, r in scored_particles.items()} == pytest.approx(fast)
    assert scored_particles[1]["rho"] == min(r["rho"] for r in scored_particles.values())


def test_missing_prediction_has_a_reason(spark):
    layout, model = internalisation(spark, 0, 20)
    particles = priors.prior_table(spark, layout, 2, seed=2).select("particle_id", "theta")
    seen = observe(model(particles.limit(1)).drop("particle_id"), model.keys, ["cy5", "bdp"])
    partial = lambda df: model(df).filter("particle_id = 1 or time < -1")
    partial_rows = predict.score_particles(particles, partial, seen).collect()
    assert {r["particle_id"]: r["reason"] for r in partial_rows} == {1: None, 2: "nothing predicted"}


class Shift:
    """A one-parameter forward model: cells of a normal sample around theta."""

    cells = 200
    keys = ["time"]
    channels = ("value",)

    def __call__(self, particles, stream=""):
        from cellgauge.functions import draws

        rows = predict.expand_particles(particles, {"time": [1.0, 2.0]}, self.cells)
        noise = draws.normal(11, stream + "n", ["particle_id", F.col("time").cast("int"), "cell"], method="xxhash64")
        return rows.select("particle_id", "time", "cell", (F.element_at("theta", 1) * F.col("time") + noise).alias("value"))


def test_calibration_recovers_a_known_parameter(spark, tmp_path):
    layout = priors.Layout(shared=(priors.Param("mu", "uniform", 0.0, 10.0),))
    truth = spark.createDataFrame([(77, [4.0])], "particle_id long, theta array<double>")
    model = Shift()
    seen = observe(model(truth).drop("particle_id"), ["time"], ["value"])
    config = cal.Calibration("shift", layout, 24, 2, str(tmp_path / "run"), seed=5, cut=0.5, max_rounds=4, max_steps=3)
    state, metrics = cal.calibrate(spark, config, model, seen)
    rounds = metrics.orderBy("round").collect()
    assert [r["round"] for r in rounds] == [1, 2, 3, 4] and rounds[-1]["stop"] == "max_rounds"
    thresholds = [r["threshold"] for r in rounds]
    assert thresholds == sorted(thresholds, reverse=True)
    rows = state.collect()
    assert len(rows) == 24 and abs(np.mean([r["theta"][0] for r in rows]) - 4.0) < 0.3
    assert max(r["rho"] for r in rows) <= thresholds[-1]
    again = dataclasses.replace(config, folder=str(tmp_path / "again"), max_rounds=1)
    cal.calibrate(spark, again, model, seen)
    resumed, _ = cal.calibrate(spark, dataclasses.replace(again, max_rounds=2), model, seen, after_round=1)
    saved = load_round(spark, config.folder, "shift", 2)
    pairs = lambda df: {r["particle_id"]: (tuple(r["theta"]), r["rho"]) for r in df.collect()}
    assert pairs(resumed) == pairs(saved)
    assert saved.count() == 24 and load_round(spark, config.folder, "shift").count() == 96


def test_stop_rules():
    config = cal.Calibration("r", priors.Layout(()), 1, 1, "", 1, min_rate=0.01, max_minutes=1, target=5, max_rounds=9)
    assert cal.stop_rule(config, 1, 0.5, 4.0, 0) == "target"
    assert cal.stop_rule(config, 1, 0.5, 6.0, 61) == "budget"
    assert cal.stop_rule(config, 1, 0.001, 6.0, 1) == "min_accept"
    assert cal.stop_rule(config, 1, float("nan"), 6.0, 1) == "min_accept"
    assert cal.stop_rule(config, 9, 0.5, 6.0, 1) == "max_rounds"
    assert cal.stop_rule(config, 1, 0.5, 6.0, 1) is None


def test_scenarios_and_configured_run(spark, tmp_path):
    layout, model = internalisation(spark, 3, 30)
    samples, truth = cal.synthesise_scenarios(spark, "internalisation", model, layout, seed=3)
    samples = settle(samples)
    assert {r[0]: r[1] for r in samples.groupBy("scenario").count().collect()} == {s: 30 * 12 for s in cal.SCENARIOS}
    value = lambda s, w: truth.filter(f"scenario = '{s}' and param = 'mu_lambda' and well = {w}").first()["value"]
    assert value("corrupted", 1) == value("corrupted2", 1) == 0.02 and value("corrupted2", 3) == 0.14
    assert value("corrupted", 2) == value("uncorrupted", 2) and value("uncorrupted", 1) != 0.02
    # the altered well is the one that departs from the unaltered scenario
    seen = observe(samples.filter("scenario = 'uncorrupted'").drop("scenario", "cell"), ["rep", *["time", "quenched"]], ["cy5", "bdp"])
    assert seen.grid.count() == 24
    controls = cal.Controls((10.0, 60.0), pool=pools(spark)[0], eta=0.95)
    run = cal.Run("internalisation", "pooled", "corrupted", 8, 1, 20, 0.75, 0.0)
    state, metrics = cal.run_pooled(
        spark, run, samples.filter("scenario = 'corrupted'").drop("scenario"), controls, str(tmp_path / "c8"), 1,
        max_rounds=1, max_steps=1,
    )
    assert state.count() == 8 and metrics.first()["stop"] == "max_rounds"
    long = priors.unpack_theta(state, cal.layout_of(run))
    shared_truth = truth.filter("scenario = 'corrupted'").drop("scenario")
    report = summaries.recovery_report(long.select("param", "well", "value"), shared_truth)
    assert report.count() == 13 and report.filter("lower > upper").count() == 0


def test_controls_and_hierarchical_run_from_a_cell_table(spark, tmp_path):
    rng = np.random.default_rng(0)
    frames = []
    for time in (0.0, 60.0, 120.0):
        for temp in (4.0, 37.0):
            for quenched in (True, False):
                for repeat in (1, 2):
                    n = 40
                    level = 200 if quenched else 1000
                    frames.append(pd.DataFrame({"time": time, "temp": temp, "quenched": quenched, "repeat": repeat,
                        "signal_cy5": rng.gamma(4, level / 4 * (1 + time), n), "signal_bdp": rng.gamma(4, 5, n)}))
    cells = pd.concat(frames, ignore_index=True)
    cells["cell_id"] = np.arange(len(cells))
    df = spark.createDataFrame(cells)
    controls = cal.controls_from_cells(df)
    assert controls.times == (60.0, 120.0) and controls.pool.count() == 80
    cold = cells[(cells.time == 120) & (cells.temp == 4)]
    assert controls.eta == pytest.approx(1 - cold[cold.quenched].signal_cy5.mean() / cold[~cold.quenched].signal_cy5.mean())
    observed = settle(cal.observed_from_cells(df, controls.times, 30, 2))
    assert observed.count() == 2 * 2 * 2 * 30
    run = cal.Run("internalisation", "hierarchical", "real", 6, 1, 20, 0.5, 0.0, wells=2)
    state, metrics = cal.run_hierarchical(spark, run, observed.drop("cell_id"), controls, str(tmp_path / "real"), 1, max_rounds=1, max_steps=1)
    assert state.count() == 6 and state.filter("rho is null").count() == 0
