import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cellgauge.operators import cells as ops
from cellgauge.operators import summaries
from cellgauge.sources import wells as io


def write_well(folder, name, values):
    pd.DataFrame({"bdp": values, "cy5": [2 * v for v in values]}).to_csv(folder / name, index=False)


def test_wells_from_files(spark, tmp_path):
    write_well(tmp_path, "A_37degree_Q_THP1_60min_1.fcs", [1.0, 2.0])
    write_well(tmp_path, "A_4degree_N_THP1_120min_2.fcs", [3.0])
    write_well(tmp_path, "broken.fcs", [9.0])
    write_well(tmp_path, ".hidden.fcs", [9.0])
    raw = io.read_wells(spark, str(tmp_path), "bdp double, cy5 double", glob="*.fcs")
    good, rejects = io.split_wells(raw)
    got = sorted(tuple(r) for r in good.select("cond", "temp", "quenched", "cell_line", "time", "repeat", "bdp").collect())
    assert got == [
        ("A", 4.0, False, "THP1", 120.0, 2, 3.0),
        ("A", 37.0, True, "THP1", 60.0, 1, 1.0),
        ("A", 37.0, True, "THP1", 60.0, 1, 2.0),
    ]
    assert [r["well"] for r in rejects.collect()] == ["broken.fcs"]


@pytest.mark.parametrize("name", ["", "a_b", "A_xdegree_Q_L_60min_1.fcs", "A_37degree_Q_L_min_1.fcs", "A_37degree_Q_L_60min_x.fcs"])
def test_malformed_names(spark, name):
    row = spark.createDataFrame([(name,)], "well string").select(io.well_metadata("well").alias("m")).first()
    assert row["m"] is None


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2)], "time double, x int")
    io.write_cells(df, str(tmp_path / "cells"))
    with pytest.raises(AnalysisException):
        io.write_cells(df, str(tmp_path / "cells"))
    io.write_summary(df, str(tmp_path / "summary"))
    with pytest.raises(AnalysisException):
        io.write_summary(df, str(tmp_path / "summary"))


def test_control_by_position(spark, tmp_path):
    pd.DataFrame({"a.x": [1, 2], "b": [3.5, 4.5]}).to_csv(tmp_path / "control.csv", index=False)
    for position, want in ((0, [1.0, 2.0]), (1, [3.5, 4.5])):
        rows = io.read_control(spark, str(tmp_path / "control.csv"), position).collect()
        assert sorted(r["value"] for r in rows) == want


def test_scenarios_are_pruned_on_read(spark, tmp_path):
    base = spark.createDataFrame([(1.0, 1, True, "c", 1, 5.0)], "time double, rep int, quenched boolean, channel string, cell long, value double")
    io.save_scenarios(ops.stack_scenarios({"a": base, "b": base.withColumn("value", F.lit(7.0))}), str(tmp_path / "s"))
    chosen = io.load_scenarios(spark, str(tmp_path / "s"), ["b"])
    assert [(r["scenario"], r["value"]) for r in chosen.collect()] == [("b", 7.0)]
    plan = chosen._jdf.queryExecution().toString()
    assert "scenario" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_prepare_wells_edges(spark):
    """A null, a NaN and a non-positive signal; a one-cell well; a constant well; a lost well."""
    rng = np.random.default_rng(1)
    many = [("many", float(a), float(b)) for a, b in rng.gamma(3, 10, (500, 2))]
    rows = many + [("many", None, 1.0), ("many", float("nan"), 1.0), ("many", 0.0, 1.0), ("many", 5.0, -1.0)]
    rows += [("one", 3.0, 4.0)] + [("constant", 2.0, 2.0)] * 10 + [("lost", -1.0, 5.0)] * 3
    df = spark.createDataFrame(rows, "well string, x double, y double")
    clean, summary = ops.prepare_wells(df, ["well"], ["x", "y"], 0.01, 0.99)
    got = {r["well"]: r for r in summary.collect()}
    x, y = np.array([r[1:] for r in many]).T
    both = np.r_[x, 5.0]  # the row with a negative second signal is not positive
    keep = np.ones(500, bool)
    for v in (x, y):
        keep &= (v > np.quantile(v, 0.01)) & (v < np.quantile(v, 0.99))
    assert got["many"]["cell_count"] == 504 and got["many"]["cell_count_nz"] == keep.sum() == clean.filter("well = 'many'").count()
    assert got["many"]["x"] == pytest.approx(np.exp(np.log(x[keep]).mean()))
    for well, n in (("one", 1), ("constant", 10), ("lost", 3)):
        assert (got[well]["cell_count"], got[well]["cell_count_nz"], got[well]["x"]) == (n, 0, None)
    counts = ops.well_counts(df, clean, ["well"]).collect()
    assert {r["well"]: (r["cell_count"], r["cell_count_nz"]) for r in counts} == {
        w: (r["cell_count"], r["cell_count_nz"]) for w, r in got.items()
    }


def test_nest_and_unnest_round_trip(spark):
    rows = [(g, i, float(i * i)) for g in "ab" for i in range(25 if g == "a" else 3)]
    df = spark.createDataFrame(rows, "g string, id long, x double").repartition(4)
    nested = ops.nest_samples(df, ["g"], "id", "x", chunk=10)
    assert sorted((r["g"], r["chunk"], len(r["samples"])) for r in nested.collect()) == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("b", 0, 3)]
    back = ops.unnest_samples(nested, ["g", "chunk"]).collect()
    assert sorted((r["g"], r["chunk"] * 10 + r["cell"], r["value"]) for r in back) == sorted(rows)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 3.1)], "v double")
    rows = summaries.density_histogram(df, [], "v", 0.0, 3.0, 3).orderBy("bin").collect()
    assert [(r["bin"], r["count"]) for r in rows] == [(0, 2), (1, 1), (2, 2)]
    assert sum(r["density"] for r in rows) == pytest.approx(1.0)


def test_kde_equals_direct_kernels_and_handles_a_constant(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(5, 2, 400)
    pdf = pd.concat([pd.DataFrame({"g": "n", "x": x}), pd.DataFrame({"g": "c", "x": [2.0] * 5})])
    df = spark.createDataFrame(pdf)
    curve = summaries.kde_curve(df, ["g"], "x", -5.0, 15.0, 50).toPandas()
    h = 0.9 * min(x.std(ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) * 400**-0.2
    mine = curve[curve.g == "n"].sort_values("point")
    direct = np.exp(-0.5 * ((mine.x.values[:, None] - x) / h) ** 2).sum(1) / (400 * h * np.sqrt(2 * np.pi))
    assert np.allclose(mine.density, direct, rtol=1e-9, atol=1e-15)
    peak = {r["g"]: r["x"] for r in summaries.curve_peak(summaries.kde_curve(df, ["g"], "x", -5.0, 15.0, 201), ["g"]).collect()}
    assert peak["c"] == pytest.approx(2.0) and abs(peak["n"] - 5) < 1
