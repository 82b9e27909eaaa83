import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgauge.functions import densities, draws, response
from cellgauge.plans import scale
from cellgauge.operators import priors, uptake


def test_compartments_obey_their_equations(spark):
    rows = [(l, b, p) for l in (0.08, 0.02, 0.3) for b in (0.05, 0.1) for p in (0.0, 0.075, 0.4)]
    rows += [(0.05 * 0.9, 0.05, 0.1)]  # the removable singularity
    df = spark.createDataFrame(rows, "l double, b double, p double")
    eps = 1e-4

    def at(t):
        s, i = response.compartment_response(t, "l", "b", "p")
        return s, i

    s0, i0 = at(0.0)
    checks = [s0.alias("s0"), i0.alias("i0")]
    for t in (10.0, 120.0):
        checks += [((at(t + eps)[1] - at(t - eps)[1]) / (2 * eps)).alias(f"d{int(t)}"), at(t)[0].alias(f"s{int(t)}")]
    for r in df.select("*", *checks).collect():
        assert r.s0 == pytest.approx(r.b / (r.b + r.l), rel=1e-5)
        assert r.i0 == pytest.approx(0, abs=1e-6)
        for t in (10, 120):
            assert r[f"d{t}"] == pytest.approx(r.l * r[f"s{t}"], rel=2e-3)


def test_reference_surface_form_is_kept_apart(spark):
    s, _ = response.compartment_response(0.0, 0.08, 0.05, 0.075, form="reference")
    assert spark.range(1).select(s).first()[0] == pytest.approx(0.320, abs=1e-3)


def test_association_response(spark):
    g = response.Geometry()
    total = g.volume * g.concentration
    df = spark.createDataFrame([(total,), (total * (1 + 1e-9),), (10.0,), (-1.0,), (1e4,)], "k double")
    p = response.association_response(3600.0, 4e-7, "k")
    same, near, small, bad, big = [r[0] for r in df.select(p).collect()]
    assert same == pytest.approx(near, rel=1e-4)
    assert 0 < small < 10 and bad is None and 0 < big < total
    zero = response.association_response(0.0, 4e-7, F.lit(10.0))
    assert spark.range(1).select(zero).first()[0] == pytest.approx(0, abs=1e-9)


def test_uptake_saturates(spark):
    low, high = spark.range(1).select(
        response.saturating_uptake(1e-9, 10.0, 1.0), response.saturating_uptake(1.0, 10.0, 1e30)
    ).first()
    assert low == pytest.approx(5.31e-5 * 1e-9, rel=1e-3) and high == 10.0


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_draw_moments(spark, method):
    n = 20_000
    df = spark.range(n).repartition(3)
    got = df.select(
        draws.uniform(1, "u", ["id"], 2, 4, method).alias("u"),
        draws.normal(1, "z", ["id"], 1, 3, method).alias("z"),
        draws.truncated_normal(1, "t", ["id"], 0.0, 1.0, method).alias("t"),
        draws.half_cauchy(1, "c", ["id"], 2.0, method).alias("c"),
        draws.lognormal_by_moments(1, "l", ["id"], 2.0, 1.0, method).alias("l"),
        draws.gamma_by_moments(1, "g", ["id"], 0.08, 0.01, 0.9, method).alias("g"),
        draws.gamma_by_moments(1, "m", ["id"], 5.0, 2.0, -2.0, method).alias("m"),
        draws.gamma_by_moments(1, "f", ["id"], 5.0, 2.0, 0.0, method).alias("f"),
        draws.pool_index(1, "i", ["id"], 7.0, method).alias("i"),
    ).toPandas()
    assert not got.isna().any().any()
    se = 4 / math.sqrt(n)
    assert abs(got.u.mean() - 3) < se and got.u.between(2, 4).all()
    assert abs(got.z.mean() - 1) < 3 * se and abs(got.z.std() - 3) < 6 * se
    assert abs(got.t.mean() - math.sqrt(2 / math.pi)) < se and (got.t >= 0).all()
    assert abs(got.c.median() - 2) < 0.1 and (got.c > 0).all()
    assert abs(got.l.mean() - 2) < se and abs(got.l.std() - 1) < 4 * se
    assert abs(got.g.mean() - 0.08) < 0.01 * se and abs(got.g.std() - 0.01) < 0.02 * se and abs(got.g.skew() - 0.9) < 0.15
    assert abs(got.m.mean() - 5) < 2 * se and abs(got.m.skew() + 2) < 0.3
    assert abs(got.f.mean() - 5) < 2 * se and abs(got.f.skew()) < 0.1
    counts = got.i.value_counts()
    assert sorted(counts.index) == list(range(1, 8)) and counts.min() > n / 7 * 0.9


def test_draws_do_not_depend_on_partitioning(spark):
    make = lambda k: {r[0]: r[1] for r in spark.range(100).repartition(k).select("id", draws.normal(3, "s", ["id"])).collect()}
    assert make(1) == make(7)


def test_truncated_draw_edges(spark):
    row = spark.range(1).select(
        draws.truncated_normal(1, "a", ["id"], 3.0, 0.0).alias("mean"),
        draws.truncated_normal(1, "b", ["id"], -50.0, 1.0).alias("none"),
    ).first()
    assert row["mean"] == 3.0 and row["none"] is None


def test_densities(spark):
    df = spark.createDataFrame([(0.5,), (3.7,), (12.0,), (1e-3,)], "x double")
    for r in df.select("x", densities.log_gamma(F.col("x")).alias("g"), densities.normal_cdf(F.col("x")).alias("c")).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), abs=1e-10)
        assert r.c == pytest.approx(0.5 * (1 + math.erf(r.x / math.sqrt(2))), abs=1e-7)
    row = spark.range(1).select(
        densities.log_density("uniform", 0.5, 0, 2).alias("u"),
        densities.log_density("uniform", 2.5, 0, 2).alias("out"),
        densities.log_density("normal", 1.0, 0, 2).alias("n"),
        densities.log_density("half_cauchy", 1.0, 0, 2).alias("h"),
        densities.log_density("half_cauchy", -1.0, 0, 2).alias("hn"),
    ).first()
    assert row.u == pytest.approx(-math.log(2)) and row.out == row.hn == float("-inf")
    assert row.n == pytest.approx(-0.125 - math.log(2) - 0.5 * math.log(2 * math.pi))
    assert row.h == pytest.approx(math.log(2 / (math.pi * 2 * 1.25)))


@pytest.mark.parametrize("skew", [0.9, -1.0, 0.0, 1.9])
def test_gamma_and_lognormal_densities_integrate_to_one(spark, skew):
    n = 40_000  # fine enough for the jump of a strongly skewed density
    df = spark.range(n).select((F.col("id") * (40.0 / n) - 15).alias("x"))
    total = df.select(
        densities.gamma_density("x", 5.0, 1.0, skew).alias("g"), densities.lognormal_density("x", 5.0, 1.0).alias("l"),
        (F.col("x") * densities.gamma_density("x", 5.0, 1.0, skew)).alias("m"),
    ).agg(F.sum("g"), F.sum("l"), F.sum("m")).first()
    assert [v * 40 / n for v in total] == pytest.approx([1, 1, 5], abs=5e-3)


def test_trapezoid(spark):
    rng = np.random.default_rng(0)
    frames = [pd.DataFrame({"g": g, "t": np.cumsum(rng.random(k)), "v": rng.random(k)}) for g, k in (("a", 300), ("b", 2), ("c", 1))]
    frames.append(pd.DataFrame({"g": "const", "t": np.arange(1.0, 30), "v": 2.0}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf).repartition(4)
    for options in ({}, {"hot_rows": 20}, {"max_rows": 300}):
        out = uptake.cumulative_trapezoid(df, ["g"], ["t"], "t", "v", 2.0, **options).toPandas()
        assert len(out) == len(pdf)
        for _, part in out.groupby("g"):
            part = part.sort_values("t")
            t, v = np.r_[0, part.t], np.r_[2.0, part.v]
            assert np.allclose(part.integral, np.cumsum((v[1:] + v[:-1]) / 2 * np.diff(t)))


def test_fractional_dose(spark, monkeypatch):
    pool = spark.createDataFrame([(i, 10.0) for i in range(1, 6)], "idx long, value double")
    cells = spark.createDataFrame([(1, 0.0), (2, 0.4), (3, 1.0), (4, 2.5)], "cell int, dose double").withColumn("background", F.lit(1.0))
    run = lambda form: {r["cell"]: r["value"] for r in uptake.fractional_dose_sum(cells, ["cell"], pool, 1, "d", form=form).collect()}
    balanced, reference = run("balanced"), run("reference")
    assert balanced == pytest.approx({1: 1, 2: 5, 3: 11, 4: 26})
    assert reference == pytest.approx({1: 1, 2: 5, 3: 1, 4: 26})
    varied = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "idx long, value double")
    rows = lambda: sorted(uptake.fractional_dose_sum(cells, ["cell"], varied, 1, "d").collect())
    one = rows()
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    assert [list(r) for r in rows()] == [pytest.approx(list(r)) for r in one]
    monkeypatch.undo()
    clashing = cells.withColumn("idx", F.lit(3)).withColumn("n", F.lit("x"))
    out = uptake.fractional_dose_sum(clashing, ["cell"], varied, 1, "d")
    assert out.columns == ["cell", "dose", "background", "idx", "n", "value"]
    assert sorted((r.cell, r.value) for r in out.collect()) == [(r[0], pytest.approx(r[3])) for r in one]


def test_prior_table_and_log_prior(spark):
    layout = priors.internalisation_hierarchical(3)
    assert len(layout.names) == 25
    table = priors.prior_table(spark, layout, 200, seed=4)
    rows = table.select("theta", "exhausted", priors.log_prior(layout).alias("lp"), priors.log_prior(layout, truncated=True).alias("lt")).collect()
    assert all(not r.exhausted and math.isfinite(r.lp) and r.lt >= r.lp - 1e-9 for r in rows)
    theta = dict(zip(layout.names, rows[0]["theta"]))
    norm = lambda x, m, s: -0.5 * ((x - m) / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi)
    want = 0.0
    for p in layout.shared:
        if p.dist == "uniform":
            want -= math.log(p.b - p.a)
        else:
            want += math.log(2 / (math.pi * p.b * (1 + (theta[p.name] / p.b) ** 2)))
    for g in layout.groups:
        want += sum(norm(theta[f"{g.name}_{w}"], theta[g.mean], theta[g.spread]) for w in (1, 2, 3))
    assert rows[0]["lp"] == pytest.approx(want)
    bad = table.limit(1).withColumn("theta", F.transform("theta", lambda x, i: F.when(i == 0, -x).otherwise(x)))
    assert bad.select(priors.log_prior(layout)).first()[0] == float("-inf")


def test_theta_round_trip(spark):
    layout = priors.association_hierarchical("corrupted", 2)
    table = priors.prior_table(spark, layout, 5, seed=1)
    long = priors.unpack_theta(table, layout)
    assert long.count() == 5 * 10 and long.filter("well is null").count() == 5 * 6
    back = priors.theta_from_long(long)
    named = priors.pack_theta(priors.slice_params(table, layout).drop("theta", "exhausted"), layout)
    want = {r["particle_id"]: r["theta"] for r in table.collect()}
    assert {r["particle_id"]: r["theta"] for r in back.collect()} == want
    assert {r["particle_id"]: r["theta"] for r in named.collect()} == want


def test_override(spark):
    truth = spark.createDataFrame([("a", 1, "mu", 1.0), ("a", None, "s", 2.0), ("b", 1, "mu", 1.0)], "scenario string, well int, param string, value double")
    change = spark.createDataFrame([("b", 1, "mu", 9.0), ("a", None, "s", 5.0)], truth.schema)
    got = {(r["scenario"], r["param"]): r["value"] for r in priors.override_parameter(truth, change).collect()}
    assert got == {("a", "mu"): 1.0, ("a", "s"): 5.0, ("b", "mu"): 9.0}


#: The published priors, as (low, high) or the half-Cauchy scale.
PUBLISHED = {
    "pooled uncorrupted": [(0.0, 1e-6), (0.0, 5.0), (0.0, 1e-6), (0.0, 50.0)],
    "pooled corrupted": [(0.0, 2e-6), (0.0, 5.0), (0.0, 1e-6), (0.0, 50.0)],
    "pooled corrupted2": [(0.0, 1e-6), (0.0, 10.0), (0.0, 1e-6), (0.0, 50.0)],
    "wells uncorrupted": [(0.0, 1e-6), (0.0, 5.0), (0.0, 1e-6), (0.0, 50.0), 3e-7, 0.5],
    "wells corrupted": [(0.0, 1e-6), (0.0, 5.0), (0.0, 1e-6), (0.0, 50.0), 3e-7, 5.0],
    "wells corrupted2": [(0.0, 2e-6), (0.0, 5.0), (0.0, 1e-6), (0.0, 50.0), 3e-7, 5.0],
    "internalisation pooled": [
        (0.0, 0.3), (0.0, 0.1), (0.0, 1.0), (0.0, 0.5), (0.0, 0.2), (0.0, 1.0), (0.0, 10.0), (0.0, 3.0),
        (5000.0, 12000.0), (20.0, 80.0), (0.0, 0.15), (-2.0, 1.0), (-2.0, 1.0),
    ],
    "internalisation wells": [
        (0.0, 0.3), (0.0, 0.1), (0.0, 1.0), (0.06, 0.2), (0.03, 0.1), (0.0, 1.0), 0.01, 0.008, 0.27, (0.0, 10.0),
        (0.0, 3.0), (7000.0, 10000.0), (30.0, 45.0), (0.0, 0.1), (-2.0, 1.0), (-2.0, 1.0),
    ],
}


@pytest.mark.parametrize("name", sorted(PUBLISHED))
def test_priors_are_the_published_ones(name):
    kind, _, scenario = name.partition(" ")
    if kind == "internalisation":
        layout = priors.INTERNALISATION_POOLED if scenario == "pooled" else priors.internalisation_hierarchical(3)
    else:
        layout = priors.association_pooled(scenario) if kind == "pooled" else priors.association_hierarchical(scenario, 3)
    assert [p.b if p.dist == "half_cauchy" else (p.a, p.b) for p in layout.shared] == PUBLISHED[name]


@pytest.mark.parametrize("layout", [priors.internalisation_hierarchical(2), priors.association_pooled("corrupted")])
def test_a_prior_held_in_a_table(spark, layout):
    keys = spark.range(1, 40).withColumnRenamed("id", "particle_id")
    table = priors.prior_rows(spark, layout)
    for method in ("md5", "xxhash64"):
        drawn = {r.particle_id: r for r in priors.draw_prior(keys, layout, 4, method=method).collect()}
        again = priors.draw_prior_rows(keys.repartition(3), table, 4, method=method)
        for r in again.collect():
            assert r.theta == pytest.approx(drawn[r.particle_id].theta, rel=1e-12) and r.exhausted == drawn[r.particle_id].exhausted
    odd = spark.createDataFrame(
        [(100, [0.1] * len(layout.names)), (101, [-0.1] * len(layout.names)), (102, [0.1]), (103, None), (104, [None] * len(layout.names))],
        "particle_id long, theta array<double>",
    )
    both = again.select("particle_id", "theta").unionByName(odd)
    for truncated in (False, True):
        want = {r.particle_id: r.p for r in both.select("particle_id", priors.log_prior(layout, truncated=truncated).alias("p")).filter("particle_id < 102").collect()}
        got = {r.particle_id: r.log_prior for r in priors.log_prior_rows(both.repartition(4), table, truncated=truncated).collect()}
        assert {k: v for k, v in got.items() if k < 102} == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
        assert got[101] == float("-inf") and got.get(102) is None and got.get(103) is None and got[104] == float("-inf")
    assert priors.draw_prior_rows(keys.limit(0), table, 4).count() == 0


@pytest.mark.parametrize("change", ["position = 2", "dist = 'gamma'", "b = null"])
def test_a_wrong_prior_table_is_refused(spark, change):
    column, _, value = change.partition(" = ")
    table = priors.prior_rows(spark, priors.association_pooled("corrupted"))
    wrong = table.withColumn(column, F.when(F.col("position") == 1, F.expr(value)).otherwise(F.col(column)))
    with pytest.raises(ValueError):
        priors.check_prior(wrong)


def test_gamma_draws_are_never_null_and_flagged_below_zero(spark):
    df = spark.range(20_000).select("id", draws.gamma_by_moments(1, "g", ["id"], 0.5, 1.0, 2.0, "xxhash64").alias("g"))
    found = df.select(F.count("g").alias("n"), F.avg("g").alias("m"), F.stddev("g").alias("s"), F.skewness("g").alias("w"),
                      F.sum(draws.below_zero(F.col("g")).cast("int")).alias("low")).first()
    assert found.n == 20_000 and found.m == pytest.approx(0.5, abs=0.03) and found.s == pytest.approx(1.0, abs=0.04)
    assert found.w == pytest.approx(2.0, abs=0.25) and 0 < found.low < 20_000
    none = spark.range(50).select(draws.gamma_by_moments(1, "g", ["id"], 0.5, 1.0, 0.9, tries=1).alias("g"))
    assert none.filter("g is null").count() == 0


def test_a_vector_is_drawn_once(spark):
    layout = priors.association_hierarchical("corrupted", 3)
    drawn = priors.draw_prior(spark.range(0, 10, 1, 1).withColumnRenamed("id", "particle_id"), layout, 9)
    assert drawn.rdd.getNumPartitions() >= 8  # also from a file that is one task
    named = priors.slice_params(drawn, layout).drop("theta", "exhausted")
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("md5(") <= 6 + 2 * 6  # a draw an entry, of two uniforms for well means
    assert "transform(sequence" not in plan  # tries of a well mean end with the first that succeeds
    summed = priors.log_prior_rows(drawn, priors.prior_rows(spark, layout))
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert not any("md5(" in line for line in plan.splitlines() if "Filter" in line)


def test_doses_by_shuffle_are_dealt_by_number(spark, monkeypatch):
    pool = spark.range(1, 301).select(F.col("id").alias("idx"), (F.col("id") * 1.5).alias("value"))
    cells = spark.range(0, 400, 1, 1).select(F.col("id").alias("cell"), (F.col("id") % 5 / 2.0).alias("dose"), F.lit(7.0).alias("background"))
    rows = lambda df: sorted((r.cell, r.dose, round(r.value, 9)) for r in df.collect())
    want = rows(uptake.fractional_dose_sum(cells, ["cell"], pool, 1, "d"))
    assert rows(uptake.fractional_dose_join(cells, ["cell"], pool, 300, 1, "d")) == want
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(uptake, "DRAWS_PER_TASK", 50)
    joined = uptake.fractional_dose_join(cells, ["cell"], pool, 300, 1, "d")
    assert joined.rdd.getNumPartitions() >= 10  # not few tasks that grow with the draws
    assert rows(joined) == want and rows(uptake.fractional_dose_sum(cells, ["cell"], pool, 1, "d")) == want


def test_a_pool_beyond_the_bound_and_its_draws_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    few = spark.range(10).select("id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("cell"))
    both = scale.attach(few, spark.range(5).withColumn("v", F.lit(1)), ["id"])
    assert "Broadcast" not in both._jdf.queryExecution().sparkPlan().toString() and both.count() == 250


def test_a_pool_is_sent_packed(spark):
    values = [None if i == 5 else float("nan") if i == 4100 else i * 0.5 for i in range(1, 9001)]
    pool = spark.createDataFrame([(i + 1, v, i) for i, v in enumerate(values)], "idx long, value double, other long").repartition(5)
    drawn = spark.createDataFrame([(1, 1), (2, 5), (3, 4096), (4, 4097), (5, 4100), (6, 9000), (7, 9001), (8, 0), (9, None), (10, 5)], "cell int, idx long")
    settled = scale.settle_pool(pool)
    assert settled.size == 9000 and settled.packed.count() == 3  # not a row a value
    want = [(c, i, values[i - 1], i - 1) for c, i in ((1, 1), (2, 5), (3, 4096), (4, 4097), (5, 4100), (6, 9000), (10, 5))]
    rows = lambda df: sorted((str(tuple(r)) for r in df.collect()))
    both = settled.look_up(drawn, "idx", other="place")
    assert both.columns == ["cell", "idx", "value", "place"] and rows(both) == sorted(map(str, want))
    none = [(c, i, None, None) for c, i in ((7, 9001), (8, 0), (9, None))]
    assert rows(settled.look_up(drawn, "idx", "left")) == sorted(map(str, want + none))
    twice = settled.look_up(settled.look_up(drawn, "idx"), "idx", "left", value="v", other="o")
    twice.collect()
    assert "ReusedExchange" in twice._jdf.queryExecution().executedPlan().toString()  # sent once


@pytest.mark.parametrize("change", ["idx + 1", "if(idx = 7, 8, idx)", "if(idx = 7, null, idx)", "idx - 3", "if(idx = 7, 5000, idx)"])
def test_an_index_that_is_not_dense_is_met_row_by_row(spark, change):
    pool = spark.range(1, 31).select(F.expr(change.replace("idx", "id")).alias("idx"), (F.col("id") * 2.0).alias("value"))
    drawn = spark.range(-3, 40).select(F.col("id").alias("idx"))
    settled = scale.settle_pool(pool)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert settled.packed is None and rows(settled.look_up(drawn, "idx")) == rows(drawn.join(pool, "idx"))
