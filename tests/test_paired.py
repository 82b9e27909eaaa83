import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import paired
from cellgauge.operators.discrepancy import discrepancy, observe


def earth(x, y):
    points = np.union1d(x, y)
    gap = np.searchsorted(np.sort(x), points[:-1], "right") / len(x) - np.searchsorted(np.sort(y), points[:-1], "right") / len(y)
    return np.sum(np.abs(gap) * np.diff(points)), np.sqrt(2 * np.sum(gap * gap * np.diff(points)))


@pytest.fixture(scope="module")
def tables(spark):
    """One candidate holds most cells, one is constant, one lies outside the observed range; some keys and values are missing."""
    rng = np.random.default_rng(3)
    parts = [("big", "a", rng.normal(5, 2, 3000)), ("big", "b", rng.normal(1, 1, 300)), ("same", "a", np.full(400, 4.0)), ("far", "a", rng.normal(90, 1, 50))]
    parts += [(f"c{i}", k, np.round(rng.normal(4, 2, 20 + i), 1)) for i in range(12) for k in "ab"] + [("lone", "z", np.array([1.0])), (None, "a", np.array([2.0, 3.0]))]
    mine = pd.concat([pd.DataFrame({"who": w, "k": k, "v": v}) for w, k, v in parts], ignore_index=True)
    seen = pd.concat([pd.DataFrame({"k": "a", "v": rng.normal(4, 2, 2500)}), pd.DataFrame({"k": "b", "v": np.round(rng.normal(1, 1, 200), 1)}), pd.DataFrame({"k": "y", "v": [7.0]})])
    odd = spark.createDataFrame([("big", "a", None), ("c1", "a", float("nan")), ("none", "a", None)], "who string, k string, v double")
    df = spark.createDataFrame(mine).withColumn("who", F.when(F.col("who") != "NaN", F.col("who"))).unionByName(odd).repartition(5)
    return mine, seen, df, spark.createDataFrame(seen).repartition(3)


@pytest.mark.parametrize("hot_rows", [1_000_000, 500, 40])
def test_every_bound_gives_the_distance(tables, hot_rows):
    mine, seen, df, observed = tables
    want = {}
    for (who, k), part in mine.groupby(["who", "k"], dropna=False):
        y = seen[seen.k == k].v.values
        if len(y):
            want[None if pd.isna(who) else who, k] = (len(part), *earth(part.v.values, y))
    for place, metric in ((1, paired.EARTH_MOVERS), (2, paired.ENERGY)):
        got = paired.pair_distances(df, observed, ["k"], ["who"], "v", metric, hot_rows=hot_rows).collect()
        assert {(r.who, r.k): r.n for r in got} == {g: w[0] for g, w in want.items()}
        for r in got:
            assert r.ad == pytest.approx(want[r.who, r.k][place], rel=1e-9, abs=1e-12)


def test_hot_samples_are_cut_and_constant_ones_counted(tables):
    _, _, df, observed = tables
    seen = []

    def part(p, o, low, high):
        assert len(p.values) <= 900 and len(o.values) <= 1200
        assert np.all(np.diff(p.values) > 0) and (len(p.values) == 0 or low <= p.values[0] and p.values[-1] < high)
        return float(p.counts.sum())

    sizes = paired.pair_distances(df, observed, ["k"], ["who"], "v", paired.PairMetric(part), hot_rows=500).collect()
    assert all(r.ad == r.n for r in sizes) and not seen
    assert {r.who: r.n for r in sizes if r.k == "a"}["same"] == 400


def test_users_metric_in_a_discrepancy(spark, tables):
    _, _, df, observed = tables
    widest = paired.PairMetric(lambda p, o, low, high: float(p.counts.sum()) / p.total + float(o.counts.sum()) / o.total)
    named = lambda t: t.withColumnRenamed("k", "well")
    seen = observe(named(observed.filter("k != 'y'")), ["well"], ["v"])
    out = {r.who: r for r in discrepancy(named(df), seen, ["who"], metric=widest).collect()}
    assert out["c1"].rho == pytest.approx(4.0) and out["c1"].reason == "cells left out"
    assert out["far"].rho is None and out["far"].reason == "missing sample"
    assert out["none"].rho is None


def test_two_channels(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"who": np.repeat([1, 2], 200), "x": rng.normal(0, 1, 400), "y": rng.normal(3, 2, 400)})
    obs = pd.DataFrame({"x": rng.normal(0, 1, 500), "y": rng.normal(3, 2, 500)})
    observed = observe(spark.createDataFrame(obs).withColumn("well", F.lit(1)), ["well"], ["x", "y"])
    df = spark.createDataFrame(pdf).withColumn("well", F.lit(1))
    got = {r.who: r.rho for r in discrepancy(df, observed, ["who"], metric=paired.EARTH_MOVERS).collect()}
    for who, part in pdf.groupby("who"):
        gap = abs(np.corrcoef(part.x, part.y)[0, 1] - np.corrcoef(obs.x, obs.y)[0, 1])
        want = earth(part.x.values, obs.x.values)[0] + 0.5 * earth(part.y.values, obs.y.values)[0] + 0.5 * gap
        assert got[who] == pytest.approx(want, rel=1e-9)
    assert paired.pair_distances(df.limit(0), df, ["well"], ["who"], "x", paired.EARTH_MOVERS).count() == 0


def test_a_candidate_costs_its_own_cells(spark):
    """The observed side is summed up once and then only searched, so many candidates do not walk it again."""
    rng = np.random.default_rng(5)
    y = np.unique(rng.normal(5, 3, 200_000))
    seen = paired.Side(y, np.ones(len(y), np.int64), 0, len(y))
    plain = lambda x: paired.Side(*np.unique(x, return_counts=True), 0, len(x))
    samples = [rng.normal(4, 2, 8), np.array([5.0, 5.0]), np.array([-99.0, 99.0]), y[:3], y[-1:]]
    for x in samples:
        work, energy = earth(x, y)
        assert paired.EARTH_MOVERS.part(plain(x), seen, -np.inf, np.inf) == pytest.approx(work, rel=1e-9)
        assert np.sqrt(paired.ENERGY.part(plain(x), seen, -np.inf, np.inf)) == pytest.approx(energy, rel=1e-9)
    assert paired.ENERGY.part(seen, seen, -np.inf, np.inf) == pytest.approx(0, abs=1e-15)

    area = paired._area(seen)
    np.testing.assert_allclose(np.diff(area.first).astype(float), np.arange(1, len(y)) / len(y) * np.diff(y), rtol=1e-9)
    assert seen.area is seen.area
    endless = np.array([1.0, np.inf])
    with np.errstate(invalid="ignore"):
        assert paired.EARTH_MOVERS.part(plain(endless), seen, -np.inf, np.inf) == np.inf


def test_predicted_cells_are_dealt_as_they_are_read(spark, monkeypatch):
    """samples that fit a task are not counted by value and written first, nor are observed values copied row by row."""
    rng = np.random.default_rng(11)
    x, y = rng.normal(4, 2, (40, 50)), rng.normal(5, 3, 300)
    df = spark.createDataFrame(pd.DataFrame({"who": np.repeat(np.arange(40), 50), "k": "a", "v": x.ravel()}))
    observed = spark.createDataFrame(pd.DataFrame({"k": "a", "v": y}))
    written = []

    def kept(rows, real=paired.settle):
        written.append(real(rows))
        return written[-1]

    monkeypatch.setattr(paired, "settle", kept)
    got = paired.pair_distances(df, observed, ["k"], ["who"], "v", paired.EARTH_MOVERS)
    assert max(t.count() for t in written) <= 300
    assert {r.who: r.ad for r in got.collect()} == pytest.approx({i: earth(x[i], y)[0] for i in range(40)}, rel=1e-9)


def test_candidates_of_a_task_are_measured_together(tables):
    """a metric that can takes all candidates of a task's range at once, not in a call for each."""
    _, _, df, observed = tables
    many = paired.PairMetric(None, parts=lambda p, o, low, high: np.full(len(p.ends), float(len(p.ends))))
    got = {r.who: r.ad for r in paired.pair_distances(df, observed, ["k"], ["who"], "v", many).collect() if r.k == "a"}
    assert len(got) == 16 and set(got.values()) == {16.0}


@pytest.mark.parametrize("low, high", [(-np.inf, np.inf), (2.0, 6.0), (-np.inf, 1.0), (50.0, np.inf)])
def test_parts_of_many_are_those_of_each(low, high):
    rng = np.random.default_rng(13)

    def side(x):
        inside = x[(x >= low) & (x < high)]
        return paired.Side(*np.unique(inside, return_counts=True), int((x < low).sum()), len(x))

    samples = [np.round(rng.normal(4, 2, n), 1) for n in (1, 1, 2, 3, 40, 500)] + [np.array([-np.inf, 3.0]), np.array([4.0, np.inf]), np.full(9, 5.0), np.array([-30.0, 90.0])]
    seen, sides = side(np.round(rng.normal(4, 2, 400), 1)), [side(x) for x in samples]
    assert len(seen.values) == 0 if low == 50 else len(seen.values) > 5
    ends = np.cumsum([len(s.values) for s in sides])
    joined = [np.concatenate([getattr(s, name) for s in sides]) for name in ("values", "counts")]
    all_sides = paired.Sides(*joined, ends, *[np.array([getattr(s, name) for s in sides]) for name in ("before", "total")])
    for power, metric in ((1, paired.EARTH_MOVERS), (2, paired.ENERGY)):
        for k, s in enumerate(sides):
            gap, width = paired._gaps(s, seen, low, high)
            with np.errstate(invalid="ignore"):
                want = np.sum(np.abs(gap) * width) if power == 1 else 2 * np.sum(gap * gap * width)
                got = metric.of_all(all_sides, seen, low, high)[k], metric.part(s, seen, low, high)
            assert got == pytest.approx((want, want), rel=1e-9, abs=1e-12, nan_ok=True)
    assert [len(b.ends) for b in all_sides.batches(1)] == [1] * len(sides)
    assert len(all_sides.batches()) == 1


@pytest.mark.parametrize("hot_rows", [1_000_000, 60, 5])
def test_observed_cuts_and_keys_of_any_type(spark, hot_rows):
    """Candidates that need no cut against an observed sample that does; zeros and NaN are one key each, null is one."""
    nan, values = float("nan"), [1.0, 1.0, 2.5, 7.0, 9.0, 40.0]
    whos = [0.0, -0.0, nan, -nan, None, 3.5]
    rows = [(w, f, t, float(v + i % 3)) for i, w in enumerate(whos) for f in (True, None) for t in (0.0, -0.0, None) for v in values]
    df = spark.createDataFrame(rows, "who double, flag boolean, time double, v double").withColumn("part", F.lit(1.50).cast("decimal(5,2)")).repartition(4)
    y = np.arange(200) / 10
    observed = spark.createDataFrame([(t, float(v)) for t in (-0.0, None) for v in y], "time double, v double")
    got = paired.pair_distances(df, observed, ["time"], ["who", "flag", "part"], "v", paired.EARTH_MOVERS, hot_rows=hot_rows).collect()
    name = lambda v: "nan" if v is not None and v != v else v
    want = {}
    for w, f, t, v in rows:
        want.setdefault((name(w), f, t), []).append(v)
    assert len(got) == len(want) == 16
    for r in got:
        sample = np.array(want[name(r.who), r.flag, r.time])
        assert r.n == len(sample) and r.ad == pytest.approx(earth(sample, y)[0], rel=1e-9)
