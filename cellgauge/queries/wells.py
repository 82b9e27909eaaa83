"""Sources, preparation, controls and reshaping over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.functions import draws, response
from cellgauge.operators import cells as ops
from cellgauge.plans.scale import scratch_path
from cellgauge.queries.registry import (
    CELL_ORDER,
    CELLS,
    CHANNELS,
    WELL,
    cells,
    query,
    rounded,
    sql_pool_index,
    table,
)
from cellgauge.sources import wells as io

ORDER_SQL = ", ".join(CELL_ORDER)


def raw_cells(spark, sf):
    """Cells whose first signal is shifted, so that some are not positive."""
    return cells(spark, sf).withColumn("signal_cy5", F.col("signal_cy5") - 5000.0)


RAW = CELLS + """, raw AS (SELECT * REPLACE (signal_cy5 - 5000 AS signal_cy5) FROM cells)"""


@query(
    "well_summary",
    f"""
WITH {RAW},
pos AS (SELECT * FROM raw WHERE signal_cy5 > 0 AND signal_bdp > 0),
q AS (SELECT time, repeat, quenched,
        quantile_cont(signal_cy5, 0.001) AS a, quantile_cont(signal_cy5, 0.999) AS b,
        quantile_cont(signal_bdp, 0.001) AS c, quantile_cont(signal_bdp, 0.999) AS d
      FROM pos GROUP BY ALL),
kept AS (SELECT pos.* FROM pos JOIN q USING (time, repeat, quenched)
         WHERE signal_cy5 > a AND signal_cy5 < b AND signal_bdp > c AND signal_bdp < d),
before AS (SELECT time, repeat, quenched, count(*) AS cell_count FROM raw GROUP BY ALL),
after AS (SELECT time, repeat, quenched, count(*) AS cell_count_nz,
            exp(avg(ln(signal_cy5))) AS signal_cy5, exp(avg(ln(signal_bdp))) AS signal_bdp
          FROM kept GROUP BY ALL)
SELECT time, repeat, quenched, cell_count, coalesce(cell_count_nz, 0) AS cell_count_nz,
  round(signal_cy5, 4) AS signal_cy5, round(signal_bdp, 6) AS signal_bdp
FROM before LEFT JOIN after USING (time, repeat, quenched)
""",
)
def well_summary(spark, sf):
    _, summary = ops.prepare_wells(raw_cells(spark, sf), WELL, CHANNELS)
    return rounded(summary, signal_cy5=4, signal_bdp=6)


CLIPPED_COLUMNS = [*WELL, "l_orderkey", "l_linenumber", "signal_cy5", "signal_bdp"]


@query(
    "clip_1d",
    f"""
WITH {CELLS}, q AS (SELECT time, repeat, quenched, quantile_cont(signal_cy5, 0.001) AS a,
  quantile_cont(signal_cy5, 0.999) AS b FROM cells GROUP BY ALL)
SELECT time, repeat, quenched, l_orderkey, l_linenumber, signal_cy5, signal_bdp
FROM cells JOIN q USING (time, repeat, quenched) WHERE signal_cy5 > a AND signal_cy5 < b
""",
)
def clip_1d(spark, sf):
    return ops.clip_quantiles(cells(spark, sf), WELL, ["signal_cy5"]).select(*CLIPPED_COLUMNS)


@query(
    "clip_2d",
    f"""
WITH {CELLS}, q AS (SELECT time, repeat, quenched, quantile_cont(signal_cy5, 0.01) AS a,
  quantile_cont(signal_cy5, 0.99) AS b, quantile_cont(signal_bdp, 0.01) AS c,
  quantile_cont(signal_bdp, 0.99) AS d FROM cells GROUP BY ALL)
SELECT time, repeat, quenched, l_orderkey, l_linenumber, signal_cy5, signal_bdp
FROM cells JOIN q USING (time, repeat, quenched)
WHERE signal_cy5 > a AND signal_cy5 < b AND signal_bdp > c AND signal_bdp < d
""",
)
def clip_2d(spark, sf):
    return ops.clip_quantiles(cells(spark, sf), WELL, CHANNELS, 0.01, 0.99).select(*CLIPPED_COLUMNS)


@query(
    "clip_bounds",
    """
SELECT l_suppkey, count(*) AS n, round(quantile_cont(l_extendedprice, 0.001), 6) AS l_extendedprice_lo,
  round(quantile_cont(l_extendedprice, 0.999), 6) AS l_extendedprice_hi
FROM lineitem GROUP BY l_suppkey
""",
)
def clip_bounds(spark, sf):
    bounds = ops.clip_bounds(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_extendedprice"])
    return rounded(bounds, l_extendedprice_lo=6, l_extendedprice_hi=6)


@query(
    "geometric_means",
    f"""
WITH {CELLS} SELECT time, repeat, quenched, round(exp(avg(ln(signal_cy5))), 4) AS signal_cy5,
  round(exp(avg(ln(signal_bdp))), 6) AS signal_bdp FROM cells GROUP BY ALL
""",
)
def geometric_means(spark, sf):
    return rounded(ops.geometric_means(cells(spark, sf), WELL, CHANNELS), signal_cy5=4, signal_bdp=6)


@query(
    "well_counts",
    """
SELECT user_id, event_type, count(*) AS cell_count, count(*) FILTER (value - 100 > 0) AS cell_count_nz
FROM events GROUP BY ALL
""",
)
def well_counts(spark, sf):
    raw = table(spark, sf, "events").withColumn("value", F.col("value") - 100)
    return ops.well_counts(raw, ops.positive_signal(raw, ["value"]), ["user_id", "event_type"])


def gains(spark, sf):
    by_brand = table(spark, sf, "part").groupBy("p_brand").agg((F.avg("p_size") / 10.0).alias("gain"))
    return by_brand.withColumnRenamed("p_brand", "channel")


@query(
    "gain_normalise",
    """
WITH gains AS (SELECT p_brand, avg(p_size) / 10 AS gain FROM part GROUP BY p_brand)
SELECT l_orderkey, l_linenumber, l_partkey, 'FJComp-' || p_brand AS channel, round(l_quantity / gain, 6) AS signal
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN gains USING (p_brand)
""",
)
def gain_normalise(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    measured = table(spark, sf, "lineitem").join(parts, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.concat(F.lit("FJComp-"), "p_brand").alias("channel"), F.col("l_quantity").alias("signal"),
    )
    known = ops.gains_with_compensation(gains(spark, sf), "channel")
    return rounded(ops.normalise_gain(measured, known, channel="channel", signal="signal"), signal=6)


@query(
    "join_gain",
    """
WITH gains AS (SELECT event_type AS channel, count(*) / 1000.0::DOUBLE AS gain FROM events GROUP BY 1)
SELECT event_id, event_type AS channel, round(gain, 6) AS gain FROM events JOIN gains ON event_type = channel
""",
)
def join_gain(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("channel"))
    known = events.groupBy("channel").agg((F.count("*") / 1000.0).alias("gain"))
    return rounded(ops.join_gain(events, known, "channel"), gain=6)


@query(
    "subset",
    f"""
WITH {CELLS} SELECT l_orderkey, l_linenumber, signal_cy5, signal_bdp FROM cells
WHERE time = 120 AND quenched AND temp = 37
""",
)
def subset(spark, sf):
    chosen = ops.subset(cells(spark, sf), time=120.0, quenched=True, temp=37.0)
    return chosen.select("l_orderkey", "l_linenumber", "signal_cy5", "signal_bdp")


@query("positive_signal", "SELECT event_id, value - 100 AS signal FROM events WHERE value - 100 > 0")
def positive_signal(spark, sf):
    events = table(spark, sf, "events").select("event_id", (F.col("value") - 100).alias("signal"))
    return ops.positive_signal(events, ["signal"])


@query("rescale_voltage", "SELECT event_id, round(value * exp(0.016::DOUBLE * 100), 6) AS signal FROM events")
def rescale_voltage(spark, sf):
    signal = response.rescale_voltage("value", 600, 500)
    return rounded(table(spark, sf, "events").select("event_id", signal.alias("signal")), signal=6)


@query("clamp_nonnegative", "SELECT event_id, greatest(0, round(value - 100, 6)) AS total FROM events")
def clamp_nonnegative(spark, sf):
    total = response.clamp_nonnegative(F.round(F.col("value") - 100, 6))
    return table(spark, sf, "events").select("event_id", total.alias("total"))


@query(
    "rescale_units",
    "SELECT event_id, round(value / 10000, 9) AS scaled, round(value * 3600, 6) AS seconds FROM events",
)
def rescale_units(spark, sf):
    out = table(spark, sf, "events").select(
        "event_id",
        response.rescale_units("value", 1e-4).alias("scaled"),
        response.rescale_units("value", 3600).alias("seconds"),
    )
    return rounded(out, scaled=9, seconds=6)


ETA = """1 - avg(signal_cy5) FILTER (quenched) / avg(signal_cy5) FILTER (NOT quenched)"""


@query(
    "quench_efficiency",
    f"WITH {CELLS} SELECT repeat, round({ETA}, 9) AS eta FROM cells WHERE time = 120 AND temp = 4 GROUP BY repeat",
)
def quench_efficiency(spark, sf):
    return rounded(ops.quench_efficiency(cells(spark, sf), "signal_cy5", ["repeat"]), eta=9)


@query(
    "attach_scalar",
    f"""
WITH {CELLS}, e AS (SELECT {ETA} AS eta FROM cells WHERE time = 120 AND temp = 4)
SELECT time, repeat, quenched, round(sum((1 - eta) * signal_cy5), 2) AS reduced FROM cells, e GROUP BY ALL
""",
)
def attach_scalar(spark, sf):
    df = cells(spark, sf)
    joined = ops.attach_scalar(df, ops.quench_efficiency(df, "signal_cy5"))
    total = F.sum((1.0 - F.col("eta")) * F.col("signal_cy5"))
    return rounded(joined.groupBy(*WELL).agg(total.alias("reduced")), reduced=2)


@query(
    "background_pool",
    f"""
WITH {CELLS}, pool AS (SELECT *, row_number() OVER (ORDER BY {ORDER_SQL}) AS idx FROM cells
  WHERE time = 0 AND NOT quenched AND temp = 37)
SELECT idx, signal_cy5, signal_bdp FROM pool
""",
)
def background_pool(spark, sf):
    return ops.background_pool(cells(spark, sf), CHANNELS, CELL_ORDER)


@query(
    "gather_pool",
    f"""
WITH pool AS (SELECT row_number() OVER (ORDER BY event_id) AS idx, value FROM events WHERE event_type = 'view'),
d AS (SELECT p_partkey, {sql_pool_index(11, "pool", "(SELECT count(*) FROM pool)", "p_partkey")} AS idx FROM part)
SELECT p_partkey, idx, value FROM d JOIN pool USING (idx)
""",
)
def gather_pool(spark, sf):
    pool = view_pool(spark, sf)
    index = draws.pool_index(11, "pool", ["p_partkey"], float(pool.count()))
    drawn = table(spark, sf, "part").select("p_partkey", index.alias("idx"))
    return ops.gather_pool(drawn, pool, "idx")


def view_pool(spark, sf, event_type="view"):
    """Values of one event type as a control pool."""
    events = table(spark, sf, "events").filter(F.col("event_type") == event_type)
    return ops.index_pool(events.select("event_id", "value"), ["event_id"]).select("idx", "value")


@query(
    "distinct_times",
    f"WITH {CELLS} SELECT DISTINCT time FROM cells WHERE time > (SELECT min(time) FROM cells) ORDER BY time",
)
def distinct_times(spark, sf):
    return ops.distinct_times(cells(spark, sf))


@query(
    "first_n_cells",
    f"""
WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY time, repeat, quenched ORDER BY {ORDER_SQL}) AS i FROM cells)
SELECT time, repeat, quenched, l_orderkey, l_linenumber, signal_cy5, signal_bdp FROM r WHERE i <= 1000
""",
)
def first_n_cells(spark, sf):
    return ops.first_n_per_group(cells(spark, sf), WELL, CELL_ORDER, 1000).select(*CLIPPED_COLUMNS)


@query(
    "melt_channels",
    f"""
WITH {CELLS}, m AS (SELECT time, repeat, quenched, 'signal_cy5' AS channel, signal_cy5 AS value FROM cells
  UNION ALL SELECT time, repeat, quenched, 'signal_bdp', signal_bdp FROM cells)
SELECT time, repeat, quenched, channel, count(*) AS n, round(sum(value), 2) AS total FROM m GROUP BY ALL
""",
)
def melt_channels(spark, sf):
    long = ops.melt_channels(cells(spark, sf), WELL, CHANNELS)
    out = long.groupBy(*WELL, "channel").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(out, total=2)


@query(
    "union_wells",
    f"WITH {CELLS} SELECT repeat, count(*) AS n, round(sum(signal_bdp), 2) AS total FROM cells GROUP BY repeat",
)
def union_wells(spark, sf):
    wells = [ops.subset(cells(spark, sf), repeat=r) for r in (1, 2, 3)]
    out = ops.union_wells(wells).groupBy("repeat").agg(F.count("*").alias("n"), F.sum("signal_bdp").alias("total"))
    return rounded(out, total=2)


@query(
    "pool_replicates",
    f"""WITH {CELLS} SELECT time, quenched, count(*) AS n, round(exp(avg(ln(signal_cy5))), 4) AS signal_cy5
FROM cells GROUP BY ALL""",
)
def pool_replicates(spark, sf):
    pooled = ops.pool_replicates(cells(spark, sf), "repeat")
    out = pooled.groupBy("time", "quenched").agg(
        F.count("*").alias("n"), F.exp(F.avg(F.log("signal_cy5"))).alias("signal_cy5")
    )
    return rounded(out, signal_cy5=4)


@query(
    "stack_scenarios",
    f"""
WITH {CELLS}, s AS (SELECT 'uncorrupted' AS scenario, repeat, signal_cy5 FROM cells UNION ALL
  SELECT 'corrupted', repeat, CASE WHEN repeat = 1 THEN signal_cy5 * 2 ELSE signal_cy5 END FROM cells)
SELECT scenario, repeat, count(*) AS n, round(avg(signal_cy5), 4) AS mean FROM s GROUP BY ALL
""",
)
def stack_scenarios(spark, sf):
    base = cells(spark, sf).select("repeat", "signal_cy5")
    doubled = F.when(F.col("repeat") == 1, F.col("signal_cy5") * 2).otherwise(F.col("signal_cy5"))
    stacked = ops.stack_scenarios({"uncorrupted": base, "corrupted": base.withColumn("signal_cy5", doubled)})
    out = stacked.groupBy("scenario", "repeat").agg(F.count("*").alias("n"), F.avg("signal_cy5").alias("mean"))
    return rounded(out, mean=4)


NESTED = """n AS (SELECT event_type, floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 500)::INTEGER AS chunk,
  event_id, value FROM events)"""


def nested(spark, sf):
    return ops.nest_samples(table(spark, sf, "events"), ["event_type"], "event_id", "value", chunk=500)


@query(
    "nest_samples",
    f"""
WITH {NESTED} SELECT event_type, chunk, count(*)::INTEGER AS cells, arg_min(value, event_id) AS first,
  arg_max(value, event_id) AS last, round(sum(value), 4) AS total FROM n GROUP BY ALL
""",
)
def nest_samples(spark, sf):
    samples = F.col("samples")
    out = nested(spark, sf).select(
        "event_type", "chunk", F.size(samples).alias("cells"), F.element_at(samples, 1).alias("first"),
        F.element_at(samples, -1).alias("last"),
        F.aggregate(samples, F.lit(0.0), lambda a, x: a + x).alias("total"),
    )
    return rounded(out, total=4)


@query(
    "unnest_samples",
    f"""
WITH {NESTED} SELECT event_type, chunk,
  (row_number() OVER (PARTITION BY event_type, chunk ORDER BY event_id) - 1)::INTEGER AS cell, value FROM n
""",
)
def unnest_samples(spark, sf):
    return ops.unnest_samples(nested(spark, sf), ["event_type", "chunk"])


# --- sources and sinks ----------------------------------------------------

NAME_SQL = """CASE WHEN l_linenumber = 3 THEN l_returnflag || '_broken_' || l_linenumber::VARCHAR
  ELSE 'Cond' || l_linestatus || '_' || (CASE WHEN l_linenumber = 7 THEN '4' ELSE '37' END) || 'degree_'
    || (CASE WHEN l_linestatus = 'F' THEN 'Q' ELSE 'N' END) || '_THP1_' || ((year(l_shipdate) - 1995) * 30)::VARCHAR
    || 'min_' || (CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END) || '.fcs' END"""


def named_wells(spark, sf, *more):
    """lineitem rows with the file name their well would have; line 3 has a broken name."""
    flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    name = F.concat(
        F.lit("Cond"), status, F.lit("_"), F.when(line == 7, "4").otherwise("37"), F.lit("degree_"),
        F.when(status == "F", "Q").otherwise("N"), F.lit("_THP1_"),
        ((F.year("l_shipdate") - 1995) * 30).cast("string"), F.lit("min_"),
        F.when(flag == "A", "1").when(flag == "N", "2").otherwise("3"), F.lit(".fcs"),
    )
    broken = F.concat(flag, F.lit("_broken_"), line.cast("string"))
    return table(spark, sf, "lineitem").select(
        F.when(line == 3, broken).otherwise(name).alias("well"),
        F.col("l_extendedprice").alias("cy5"), F.col("l_quantity").alias("bdp"), *more,
    )


META_SQL = f"""named AS (SELECT {NAME_SQL} AS well, l_extendedprice AS cy5, l_quantity AS bdp FROM lineitem),
parsed AS (SELECT well, cy5, bdp, string_split(well, '_') AS f FROM named),
good AS (SELECT 'DualMarker' AS exp, f[1] AS cond, f[2][:-7]::DOUBLE AS temp, f[3] = 'Q' AS quenched, f[4] AS cell_line,
  f[5][:-4]::DOUBLE AS time, f[6][:-5]::BIGINT AS repeat, cy5, bdp FROM parsed WHERE len(f) >= 6)"""


@query(
    "well_metadata",
    f"""
WITH {META_SQL} SELECT exp, cond, temp, quenched, cell_line, time, repeat, count(*) AS n, round(sum(cy5), 2) AS total
FROM good GROUP BY ALL
""",
)
def well_metadata(spark, sf):
    good, _ = io.split_wells(named_wells(spark, sf))
    out = good.groupBy(*io.WELL_KEYS).agg(F.count("*").alias("n"), F.sum("cy5").alias("total"))
    return rounded(out, total=2)


@query("well_rejects", f"WITH {META_SQL} SELECT well, count(*) AS n FROM parsed WHERE len(f) < 6 GROUP BY well")
def well_rejects(spark, sf):
    _, rejects = io.split_wells(named_wells(spark, sf))
    return rejects.groupBy("well").agg(F.count("*").alias("n"))


@query(
    "read_wells",
    f"""
WITH {META_SQL} SELECT cond, temp, quenched, time, repeat, count(*) AS n, round(sum(cy5), 2) AS cy5, round(sum(bdp), 2) AS bdp
FROM good GROUP BY ALL
""",
)
def read_wells(spark, sf):
    folder = scratch_path(spark, "wells")
    # One writer task per well keeps the number of files at the number of wells.
    named_wells(spark, sf).repartition("well").write.partitionBy("well").csv(folder, header=True)
    raw = io.read_wells(spark, folder, "cy5 double, bdp double", glob="*.csv", well_in="directory")
    good, _ = io.split_wells(raw)
    out = good.groupBy("cond", "temp", "quenched", "time", "repeat").agg(
        F.count("*").alias("n"), F.sum("cy5").alias("cy5"), F.sum("bdp").alias("bdp")
    )
    return rounded(out, cy5=2, bdp=2)


ROUND_TRIP = f"""
WITH {CELLS} SELECT 'DualMarker' AS exp, 'C' AS cond, temp, 'THP1' AS cell_line, quenched, time, repeat,
  signal_bdp, signal_cy5, l_orderkey AS cell_id FROM cells"""


def cell_table(spark, sf):
    return cells(spark, sf).select(
        F.lit("DualMarker").alias("exp"), F.lit("C").alias("cond"), "temp", F.lit("THP1").alias("cell_line"),
        "quenched", "time", "repeat", "signal_bdp", "signal_cy5",
        F.col("l_orderkey").alias("cell_id"),
    )


@query("cells_parquet", ROUND_TRIP)
def cells_parquet(spark, sf):
    folder = scratch_path(spark, "cells")
    io.write_cells(cell_table(spark, sf), folder)
    return io.read_cells(spark, folder)


@query("cells_csv", ROUND_TRIP)
def cells_csv(spark, sf):
    folder = scratch_path(spark, "cells") + ".csv"
    io.write_cells(cell_table(spark, sf), folder, fmt="csv")
    return io.read_cells(spark, folder)


@query(
    "summary_csv",
    f"WITH {CELLS} SELECT time, repeat, quenched, round(exp(avg(ln(signal_cy5))), 4) AS signal_cy5 FROM cells GROUP BY ALL",
)
def summary_csv(spark, sf):
    folder = scratch_path(spark, "summary")
    io.write_summary(ops.geometric_means(cells(spark, sf), WELL, ["signal_cy5"]), folder)
    saved = spark.read.schema("time double, repeat long, quenched boolean, signal_cy5 double").csv(folder, header=True)
    return rounded(saved, signal_cy5=4)


@query("read_control", "SELECT count(*) AS n, round(sum(value * exp(0.016::DOUBLE * 100)), 2) AS total FROM events")
def read_control(spark, sf):
    folder = scratch_path(spark, "control")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").write.csv(folder, header=True)
    control = io.read_control(spark, folder, 3)
    rescaled = control.select(response.rescale_voltage("value", 600, 500).alias("value"))
    return rounded(rescaled.agg(F.count("*").alias("n"), F.sum("value").alias("total")), total=2)


@query(
    "round_store",
    """
SELECT vec_id AS particle_id, 2::INTEGER AS round, unnest(range(1, 65))::INTEGER AS position, round(unnest(embedding)::DOUBLE * 2, 6) AS value,
  label::DOUBLE AS rho FROM embeddings
""",
)
def round_store(spark, sf):
    folder = scratch_path(spark, "rounds")
    for number in (1, 2):
        scaled = F.transform("embedding", lambda x: x.cast("double") * number)
        particles = table(spark, sf, "embeddings").select(
            F.col("vec_id").alias("particle_id"), scaled.alias("theta"), F.col("label").cast("double").alias("rho")
        )
        io.save_round(particles, folder, "probe", number)
    saved = io.load_round(spark, folder, "probe", 2)
    out = saved.select("particle_id", "round", F.posexplode("theta").alias("position", "value"), "rho")
    return rounded(out.withColumn("position", F.col("position") + 1), value=6)


@query(
    "scenario_store",
    f"""
WITH {CELLS} SELECT 'corrupted' AS scenario, time, repeat::INTEGER AS rep, count(*) AS n, round(sum(signal_cy5 * 2), 2) AS total
FROM cells GROUP BY ALL
""",
)
def scenario_store(spark, sf):
    folder = scratch_path(spark, "scenarios")
    base = cells(spark, sf).select(
        "time", F.col("repeat").cast("int").alias("rep"), "quenched", F.lit("signal_cy5").alias("channel"),
        F.col("l_orderkey").alias("cell"), F.col("signal_cy5").alias("value"),
    )
    variants = {"uncorrupted": base, "corrupted": base.withColumn("value", F.col("value") * 2)}
    io.save_scenarios(ops.stack_scenarios(variants), folder)
    saved = io.load_scenarios(spark, folder, ["corrupted"])
    out = saved.groupBy("scenario", "time", "rep").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(out, total=2)
