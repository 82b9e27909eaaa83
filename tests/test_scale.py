import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgauge.plans import scale


@pytest.fixture(scope="module")
def lopsided():
    """Three groups; one holds most rows, with ties, negatives and a constant run."""
    rng = np.random.default_rng(5)
    big = np.round(rng.lognormal(0, 2, 6000) - 3, 2)
    big[:800] = 1.25
    frames = [("big", big), ("mid", rng.normal(size=700)), ("one", np.array([4.0])), (None, rng.normal(size=9))]
    pdf = pd.concat([pd.DataFrame({"g": g, "x": v}) for g, v in frames], ignore_index=True)
    pdf["id"] = rng.permutation(len(pdf))
    return pdf


@pytest.mark.parametrize("sketch, hot_rows", [(10_000, 1_000_000), (1000, 1_000_000), (300, 20)])
def test_order_statistics_equal_numpy(spark, lopsided, sketch, hot_rows):
    df = spark.createDataFrame(lopsided).repartition(7)
    probs = [0.001, 0.25, 0.5, 0.9, 0.999, 1.0, 0.0]
    wanted = [scale.quantile(f"q{i}", "x", p) for i, p in enumerate(probs)]
    got = {r["g"]: r for r in scale.order_statistics(df, ["g"], wanted, sketch=sketch, hot_rows=hot_rows).collect()}
    assert len(got) == 4
    for g, part in lopsided.groupby("g", dropna=False):
        g = None if pd.isna(g) else g
        assert got[g]["n"] == len(part)
        for i, p in enumerate(probs):
            assert got[g][f"q{i}"] == pytest.approx(np.quantile(part["x"], p), abs=1e-12)


def test_order_statistics_without_keys_and_with_nulls(spark):
    df = spark.createDataFrame([(None,), (3.0,), (1.0,)], "x double")
    row = scale.order_statistics(df, [], [scale.quantile("m", "x", 0.5)]).first()
    assert (row["m"], row["n"]) == (2.0, 3)


@pytest.mark.parametrize("hot_rows", [1_000_000, 100])
def test_running_total_and_previous_row(spark, lopsided, hot_rows):
    df = spark.createDataFrame(lopsided.assign(g=lopsided["g"].fillna("none"))).repartition(5)
    sliced = scale.slice_groups(df, ["g"], ["x", "id"], hot_rows=hot_rows)
    if hot_rows == 100:
        counts = {r["slice"]: r["count"] for r in sliced.rows.filter("g = 'big'").groupBy("slice").count().collect()}
        assert len(counts) > 100 and max(counts.values()) < 100  # the 800 ties too
    out = scale.running_total(sliced, ["g"], ["x", "id"], {"total": "x"})
    out = scale.previous_row(out, ["g"], ["x", "id"], {"before": "x"}).done().toPandas()
    assert len(out) == len(lopsided)
    for _, part in out.groupby("g"):
        part = part.sort_values(["x", "id"])
        assert np.allclose(part["total"], part["x"].cumsum())
        assert part["before"].isna().sum() == 1
        assert np.allclose(part["before"].iloc[1:], part["x"].iloc[:-1])


def test_whole_table_is_sliced_when_large(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("v"), F.lit(1).alias("one"))
    sliced = scale.slice_groups(df, [], "v", hot_rows=100, slices=16)
    out = scale.running_total(sliced, [], ["v"], {"rank": "one"}).done()
    assert out.filter("rank != v + 1").count() == 0


def test_many_equal_large_groups_are_all_cut(spark):
    df = spark.range(40_000).select((F.col("id") % 200).alias("g"), F.col("id"), F.lit(1).alias("one"))
    sliced = scale.slice_groups(df, ["g"], "id", hot_rows=50)
    counts = [r["count"] for r in sliced.rows.groupBy("g", "slice").count().collect()]
    assert len(counts) > 200 * 4 and max(counts) < 100
    out = scale.running_total(sliced, ["g"], ["id"], {"rank": "one"}).done()
    assert out.filter("rank != (id - g) / 200 + 1").count() == 0


@pytest.mark.parametrize("kind", ["string", "timestamp_ntz", "date", "boolean", "decimal(12,2)", "double"])
def test_any_order_type_with_nulls_gives_one_answer(spark, kind):
    """The same ranks with the bound low and high; nulls first, ties by id."""
    x = F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") * 37 % 11)
    value = {
        "timestamp_ntz": F.timestamp_seconds(x * 5000).cast("timestamp_ntz"), "date": F.date_add(F.lit("2020-01-01"), x.cast("int")),
        "boolean": x > 5, "double": F.when(x == 3, float("inf")).when(x == 4, float("nan")).when(x == 5, float("-inf")).otherwise(x.cast("double")),
    }.get(kind, x.cast(kind))
    df = spark.range(3000).select("id", value.alias("x"), F.lit(1).alias("one"), (F.col("id") % 3).alias("g")).repartition(5)
    ranks = []
    for hot_rows in (40, 1_000_000):
        sliced = scale.slice_groups(df, ["g"], ["x", "id"], hot_rows=hot_rows)
        if hot_rows == 40:
            assert sliced.cut and max(r["count"] for r in sliced.rows.groupBy("g", "slice").count().collect()) < 80
        done = scale.running_total(sliced, ["g"], ["x", "id"], {"rank": "one"}).done()
        ranks.append(sorted((r.id, r.rank) for r in done.select("id", "rank").collect()))
    assert ranks[0] == ranks[1]


@pytest.mark.parametrize("sketch", [10_000, 500])
def test_first_n(spark, lopsided, sketch):
    df = spark.createDataFrame(lopsided).repartition(6)
    got = scale.first_n(df, ["g"], ["x", "id"], 50, salts=8, sketch=sketch).toPandas()
    for g, part in lopsided.groupby("g", dropna=False):
        mine = got[got["g"].isna()] if pd.isna(g) else got[got["g"] == g]
        assert sorted(mine["id"]) == sorted(part.sort_values(["x", "id"]).head(50)["id"])


def test_attach_beyond_broadcast_equals_broadcast(spark, lopsided, monkeypatch):
    df = spark.createDataFrame(lopsided)
    stats = scale.settle(df.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("m")))
    easy = scale.attach(df, stats, ["g"]).agg(F.count("*"), F.sum("m")).first()
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 64)
    monkeypatch.setattr(scale, "HOT_SHARE", 2)
    hard = scale.attach(df, stats, ["g"]).agg(F.count("*"), F.sum("m")).first()
    assert easy[0] == hard[0] == len(lopsided)
    assert easy[1] == pytest.approx(hard[1])


def test_rows_are_numbered_by_ranges(spark):
    rows = [(i * 7919 % 1000 // 3, None if i % 50 == 0 else f"s{i % 11}") for i in range(3000)]
    df = spark.createDataFrame(rows, "x int, s string").repartition(6)
    got = scale.number_rows(df, [F.col("x").desc(), "s"], "place", partitions=5)
    want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1]))
    assert [(r.x, r.s) for r in got.orderBy("place").collect()] == want
    assert sorted(r.place for r in got.collect()) == list(range(1, 3001))
    assert scale.number_rows(df.limit(0), ["x"], "place").count() == 0


def test_equal_rows_are_spread(spark):
    df = spark.range(4000).select(F.lit(1).alias("x")).repartition(8)
    got = scale.number_rows(df, ["x"], "place", partitions=4)
    assert got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).filter(lambda n: n > 0).count() >= 3
    assert got.agg(F.sum("place")).first()[0] == 4000 * 4001 // 2
