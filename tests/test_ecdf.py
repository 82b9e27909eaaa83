import numpy as np
import pandas as pd
import pytest

from cellgauge.operators import discrepancy as disc
from cellgauge.operators import ecdf


def brute_grid(x, n=1000):
    lo, hi = min(x), max(x)
    step = (hi + 1e-3 - lo) / (n - 1)
    knots = lo + np.arange(n) * step
    return knots, (np.asarray(x)[None, :] < knots[:, None]).mean(axis=1)


def brute_distance(x, y):
    knots, p = brute_grid(x)
    f = np.clip(np.interp(np.sort(y), knots, p), 1e-9, 1 - 1e-9)
    n = len(y)
    w = 2 * np.arange(1, n + 1) - 1
    return np.sqrt(-n - np.sum(w / n * (np.log(f) + np.log(1 - f[::-1]))))


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(2)
    obs = {"a": rng.normal(5, 2, 400), "b": np.full(30, 3.0), "c": rng.integers(0, 9, 500).astype(float), "d": np.array([1.0])}
    pred = {(i, g): rng.normal(4 + i, 2, 150 + 10 * i) for i in range(3) for g in obs}
    pred[(0, "a")][:40] = -100.0  # ties below the grid
    return obs, pred


def frames(spark, samples):
    obs, pred = samples
    o = pd.concat([pd.DataFrame({"g": g, "x": v}) for g, v in obs.items()])
    p = pd.concat([pd.DataFrame({"cand": i, "g": g, "x": v}) for (i, g), v in pred.items()])
    return spark.createDataFrame(o), spark.createDataFrame(p).repartition(5)


def test_grid_equals_brute_force(spark, samples):
    o, _ = frames(spark, samples)
    for row in ecdf.ecdf_grid(o, ["g"], "x").collect():
        knots, p = brute_grid(samples[0][row["g"]])
        assert len(row["p"]) == 1000
        assert np.allclose(row["p"], p)
        assert row["lo"] == knots[0]
    long = ecdf.grid_long(ecdf.ecdf_grid(o, ["g"], "x"), ["g"])
    assert long.count() == 4000


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_distance_equals_brute_force(spark, samples, hot_rows):
    o, p = frames(spark, samples)
    grid = ecdf.settle(ecdf.ecdf_grid(o, ["g"], "x"))
    rows = ecdf.anderson_darling(p, grid, ["g"], ["cand"], "x", hot_rows=hot_rows).collect()
    assert len(rows) == len(samples[1])
    for row in rows:
        y = samples[1][(row["cand"], row["g"])]
        assert row["n"] == len(y)
        assert row["ad"] == pytest.approx(brute_distance(samples[0][row["g"]], y), rel=1e-9)


def test_distance_grows_under_a_shift_and_is_small_against_itself(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    o = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x}))
    p = spark.createDataFrame(pd.concat([pd.DataFrame({"cand": s, "g": 1, "x": x + s}) for s in range(4)]))
    grid = ecdf.settle(ecdf.ecdf_grid(o, ["g"], "x"))
    got = {r["cand"]: r["ad"] for r in ecdf.anderson_darling(p, grid, ["g"], ["cand"], "x", max_rows=500).collect()}
    assert got[0] < 1 < got[1] < got[2] < got[3]


def test_order_index(spark):
    df = spark.createDataFrame([("a", 3.0, 1), ("a", 1.0, 2), ("a", 1.0, 3), ("b", 9.0, 4)], "g string, x double, id int")
    got = {r["id"]: (r["i"], r["mirror"], r["n"]) for r in ecdf.order_index(df, ["g"], ["x", "id"]).collect()}
    assert got == {2: (1, 3, 3), 3: (2, 2, 3), 1: (3, 1, 3), 4: (1, 1, 1)}


def two_channel(spark):
    rng = np.random.default_rng(3)

    def cells(shift, n, rep, t):
        a = rng.normal(10 + shift, 2, n)
        return pd.DataFrame({"rep": rep, "time": t, "c1": a, "c2": a * 0.5 + rng.normal(0, 1, n)})

    obs = pd.concat([cells(0, 200, r, t) for r in (1, 2) for t in (10, 20)])
    pred = pd.concat([cells(s, 100, r, t).assign(cand=s) for s in (0, 1) for r in (1, 2) for t in (10, 20)])
    return obs, pred


def test_hierarchical_and_pooled_two_channel(spark):
    obs, pred = two_channel(spark)
    o, p = spark.createDataFrame(obs), spark.createDataFrame(pred)
    got = {r["cand"]: r for r in disc.discrepancy_hier(p, o, ["time", "rep"], ["c1", "c2"], ["cand"]).collect()}
    pooled_in = p.drop("rep")
    pooled = {r["cand"]: r for r in disc.discrepancy_pooled(pooled_in, o, ["time", "rep"], ["c1", "c2"], ["cand"]).collect()}
    for cand in (0, 1):
        for rows, keys in ((got, ["time", "rep"]), (pooled, ["time"])):
            want = 0.0
            for key, y in pred[pred.cand == cand].groupby(keys):
                x = obs[(obs[keys] == pd.Series(key, index=keys)).all(axis=1)]
                want += brute_distance(x.c1, y.c1) + 0.5 * brute_distance(x.c2, y.c2)
                want += 0.5 * abs(np.corrcoef(x.c1, x.c2)[0, 1] - np.corrcoef(y.c1, y.c2)[0, 1])
            assert rows[cand]["rho"] == pytest.approx(want, rel=1e-9)
            assert rows[cand]["reason"] is None


def test_reasons_for_null_distances(spark):
    obs, pred = two_channel(spark)
    pred = pred[~((pred.cand == 1) & (pred.time == 20))].copy()
    pred.loc[(pred.cand == 0) & (pred.rep == 1) & (pred.time == 10), "c2"] = 1.0
    got = disc.discrepancy_hier(
        spark.createDataFrame(pred), spark.createDataFrame(obs), ["time", "rep"], ["c1", "c2"], ["cand"]
    ).collect()
    assert {r["cand"]: (r["rho"], r["reason"]) for r in got} == {
        0: (None, "undefined correlation"),
        1: (None, "missing sample"),
    }


def test_custom_metric_hook(spark):
    """any callable with the metric signature replaces the distance."""
    from pyspark.sql import functions as F

    def worst_gap(df, grid, keys, sample, value, max_rows=None):
        placed = ecdf.ecdf_lookup(df, grid, keys, value)
        return placed.groupBy(*sample, *keys).agg(F.abs(F.avg("f") - 0.5).alias("ad"))

    obs, pred = two_channel(spark)
    seen = disc.observe(spark.createDataFrame(obs), ["time", "rep"], ["c1"])
    got = disc.discrepancy(spark.createDataFrame(pred), seen, ["cand"], metric=worst_gap).collect()
    assert len(got) == 2 and all(0 <= r["rho"] < 2 for r in got)


def test_null_cells_give_one_answer_on_both_plans(spark):
    """A cell counts if all its channels have a value; every candidate keeps its row."""
    obs, pred = two_channel(spark)
    holes = pred.copy()
    third = np.arange(len(holes)) % 3 == 0
    holes.loc[third & (holes.cand == 0), "c2"] = None
    holes.loc[(np.arange(len(holes)) % 5 == 0) & (holes.cand == 0), "c1"] = float("nan")
    empty = pred[pred.cand == 1].assign(cand=2, c1=None)
    apart = pred[pred.cand == 1].assign(cand=3, time=99)
    rows = [tuple(None if v is None or v != v else v for v in r) for r in pd.concat([holes, empty, apart])[["cand", "rep", "time", "c1", "c2"]].itertuples(index=False)]
    p = spark.createDataFrame(rows, "cand int, rep int, time int, c1 double, c2 double")
    o = disc.observe(spark.createDataFrame(obs), ["time", "rep"], ["c1", "c2"])
    plans = [{r["cand"]: (r["rho"], r["reason"]) for r in disc.discrepancy(p, o, ["cand"], hot_rows=bound).collect()} for bound in (1_000_000, 20)]
    whole = holes.dropna()
    want = 0.0
    for key, y in whole[whole.cand == 0].groupby(["time", "rep"]):
        x = obs[(obs[["time", "rep"]] == pd.Series(key, index=["time", "rep"])).all(axis=1)]
        want += brute_distance(x.c1, y.c1) + 0.5 * brute_distance(x.c2, y.c2)
        want += 0.5 * abs(np.corrcoef(x.c1, x.c2)[0, 1] - np.corrcoef(y.c1, y.c2)[0, 1])
    for got in plans:
        assert sorted(got) == [0, 1, 2, 3]
        assert got[0] == (pytest.approx(want, rel=1e-9), "cells left out")
        assert got[1][1] is None and got[1][0] == pytest.approx(plans[0][1][0], rel=1e-9)
        assert got[2] == (None, "missing sample") and got[3] == (None, "missing sample")


def test_ranks_with_missing_and_infinite_distances(spark):
    from cellgauge.operators.particles import rank_by_distance

    df = spark.range(1000).selectExpr("id as particle_id", "if(id < 900, if(id % 2 = 0, double('inf'), null), double(1000 - id)) as rho").repartition(4)
    ranked = rank_by_distance(df)
    ranks = {r.particle_id: r.position for r in ranked.collect()}
    assert ranks[1] == 1 and ranks[999] == 451 and ranks[898] == 1000 and sorted(ranks.values()) == list(range(1, 1001))
    plan = ranked._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
