"""Whole preparations: written wells to clean cells, and a cell table to what a comparison needs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cellgauge.operators import calibrate as cal
from cellgauge.operators import cells as ops
from cellgauge.plans.scale import scratch_path, settle
from cellgauge.queries.registry import CELLS, cells, query, rounded
from cellgauge.queries.wells import NAME_SQL, named_wells
from cellgauge.sources import wells as io

GAINS = [("488nm", 4.0), ("642nm", 2.5)]

PREPARED = f"""named AS (SELECT {NAME_SQL} AS well, l_orderkey, l_linenumber,
  (l_extendedprice - 5000) / 2.5::DOUBLE AS signal_cy5, l_quantity / 4.0::DOUBLE AS signal_bdp FROM lineitem),
parsed AS (SELECT *, string_split(well, '_') AS f FROM named),
good AS (SELECT 'DualMarker' AS exp, f[1] AS cond, f[2][:-7]::DOUBLE AS temp, f[4] AS cell_line, f[3] = 'Q' AS quenched,
  f[5][:-4]::DOUBLE AS time, f[6][:-5]::BIGINT AS repeat, l_orderkey, l_linenumber, signal_bdp, signal_cy5
  FROM parsed WHERE len(f) >= 6),
q AS (SELECT exp, cond, temp, cell_line, quenched, time, repeat,
  quantile_cont(signal_cy5, 0.001) AS a, quantile_cont(signal_cy5, 0.999) AS b,
  quantile_cont(signal_bdp, 0.001) AS c, quantile_cont(signal_bdp, 0.999) AS d
  FROM good WHERE signal_cy5 > 0 AND signal_bdp > 0 GROUP BY ALL),
clean AS (SELECT good.* FROM good JOIN q USING (exp, cond, temp, cell_line, quenched, time, repeat)
  WHERE signal_cy5 > 0 AND signal_bdp > 0 AND signal_cy5 > a AND signal_cy5 < b AND signal_bdp > c AND signal_bdp < d)"""


def prepared(spark, sf):
    """Wells written as files, read back, named, gained, filtered and clipped: cells and their summary."""
    folder = scratch_path(spark, "raw-wells")
    wells = named_wells(spark, sf, "l_orderkey", "l_linenumber").withColumn("cy5", F.col("cy5") - 5000.0)
    wells.repartition("well").write.partitionBy("well").csv(folder, header=True)
    schema = "cy5 double, bdp double, l_orderkey long, l_linenumber int"
    raw, _ = io.split_wells(io.read_wells(spark, folder, schema, glob="*.csv", well_in="directory"))
    gains = settle(ops.gains_with_compensation(spark.createDataFrame(GAINS, "channel string, gain double"), "channel"))
    raw = raw.withColumnsRenamed({"cy5": "signal_cy5", "bdp": "signal_bdp"})
    for signal, channel in (("signal_cy5", "FJComp-642nm"), ("signal_bdp", "488nm")):
        raw = ops.normalise_gain(raw.withColumn("channel", F.lit(channel)), gains, channel="channel", signal=signal).drop("channel")
    return ops.prepare_wells(raw, io.WELL_KEYS, ["signal_cy5", "signal_bdp"])


@query(
    "prepare_cells",
    f"""WITH {PREPARED} SELECT exp, cond, temp, cell_line, quenched, time, repeat, l_orderkey, l_linenumber,
  round(signal_bdp, 6) AS signal_bdp, round(signal_cy5, 6) AS signal_cy5 FROM clean""",
)
def prepare_cells(spark, sf):
    clean, _ = prepared(spark, sf)
    return rounded(clean.select(*io.WELL_KEYS, "l_orderkey", "l_linenumber", "signal_bdp", "signal_cy5"), signal_bdp=6, signal_cy5=6)


@query(
    "prepare_summary",
    f"""WITH {PREPARED},
b AS (SELECT exp, cond, temp, cell_line, quenched, time, repeat, count(*) AS cell_count FROM good GROUP BY ALL),
k AS (SELECT exp, cond, temp, cell_line, quenched, time, repeat, count(*) AS n,
  exp(avg(ln(signal_bdp))) AS signal_bdp, exp(avg(ln(signal_cy5))) AS signal_cy5 FROM clean GROUP BY ALL)
SELECT exp, cond, temp, cell_line, quenched, time, repeat, cell_count, coalesce(n, 0) AS cell_count_nz,
  round(signal_bdp, 6) AS signal_bdp, round(signal_cy5, 4) AS signal_cy5
FROM b LEFT JOIN k USING (exp, cond, temp, cell_line, quenched, time, repeat)""",
)
def prepare_summary(spark, sf):
    _, summary = prepared(spark, sf)
    return rounded(summary.select(*io.WELL_KEYS, "cell_count", "cell_count_nz", "signal_bdp", "signal_cy5"), signal_bdp=6, signal_cy5=4)


CELL_ID = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"  # lineitem has no unique key


def numbered_cells(spark, sf):
    return cells(spark, sf).withColumn("cell_id", F.expr(CELL_ID))


@query(
    "observed_cells",
    f"""WITH {CELLS}, w AS (SELECT time, repeat::INTEGER AS rep, quenched, {CELL_ID} AS cell_id,
  signal_cy5 AS cy5, signal_bdp AS bdp FROM cells WHERE temp = 37 AND time > (SELECT min(time) FROM cells)),
n AS (SELECT *, row_number() OVER (PARTITION BY time, rep, quenched ORDER BY cell_id) AS i FROM w)
SELECT time, rep, quenched, cell_id, cy5, bdp FROM n WHERE i <= 50""",
)
def observed_cells(spark, sf):
    """The first 50 warm cells of every time, well and condition, as the published analysis takes its samples."""
    df = numbered_cells(spark, sf)
    times = sorted(r[0] for r in ops.distinct_times(df).collect())  # one number per observation time
    seen = cal.observed_from_cells(df, [t for t in times if t > 0], 50, 3)
    return seen.select("time", "rep", "quenched", "cell_id", "cy5", "bdp")


@query(
    "controls",
    f"""WITH {CELLS}, p AS (SELECT signal_cy5 AS cy5, signal_bdp AS bdp,
  row_number() OVER (ORDER BY {CELL_ID})::BIGINT AS idx
  FROM cells WHERE time = 0 AND NOT quenched AND temp = 37),
e AS (SELECT 1 - avg(signal_cy5) FILTER (WHERE quenched) / avg(signal_cy5) FILTER (WHERE NOT quenched) AS eta
  FROM cells WHERE time = 120 AND temp = 4)
SELECT idx, cy5, bdp, round(eta, 9) AS eta FROM p, e""",
)
def controls(spark, sf):
    """The background pool, with the quenching efficiency beside every row."""
    found = cal.controls_from_cells(numbered_cells(spark, sf))
    return found.pool.select("idx", "cy5", "bdp", F.round(F.lit(found.eta), 9).alias("eta"))


@query(
    "refuse_overwrite",
    f"""WITH {CELLS} SELECT time, repeat, quenched, round(exp(avg(ln(signal_cy5))), 4) AS signal_cy5, true AS refused
FROM cells GROUP BY ALL""",
)
def refuse_overwrite(spark, sf):
    """A second write to the same folder is an error and changes nothing."""
    folder = scratch_path(spark, "summary")
    keys = ["time", "repeat", "quenched"]
    io.write_summary(ops.geometric_means(cells(spark, sf), keys, ["signal_cy5"]), folder)
    try:
        io.write_summary(cells(spark, sf).select(*keys, "signal_cy5"), folder)
        refused = False
    except AnalysisException:
        refused = True
    saved = spark.read.schema("time double, repeat long, quenched boolean, signal_cy5 double").csv(folder, header=True)
    return rounded(saved, signal_cy5=4).withColumn("refused", F.lit(refused))
