"""Particle selection, prediction, scoring and calibration over the driver tables.

Customers are a population of scored particles, suppliers are particles to predict
from, embeddings are long parameter vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.operators import calibrate as cal
from cellgauge.operators import cells as cell_ops
from cellgauge.operators import particles as parts
from cellgauge.operators import predict, priors
from cellgauge.operators.discrepancy import observe
from cellgauge.plans.scale import scratch_path, settle
from cellgauge.queries.distances import ad_sql, grid_sql, placed_sql
from cellgauge.queries.draw_tables import pair_particles
from cellgauge.queries.registry import (
    CELL_ORDER,
    CELLS,
    cells,
    query,
    rounded,
    sql_gamma,
    sql_lognormal,
    sql_normal,
    sql_pool_index,
    sql_truncated,
    table,
)
from cellgauge.queries.wells import view_pool

PARTICLES = "p AS (SELECT c_custkey AS particle_id, c_acctbal AS x, round(c_acctbal, 0) AS rho FROM customer)"
KEPT = "(SELECT count(*) - floor(0.75 * count(*)) FROM p)"
RANKED = f"{PARTICLES}, r AS (SELECT *, row_number() OVER (ORDER BY rho, particle_id) AS position FROM p)"


@query("rank_by_distance", f"WITH {RANKED} SELECT particle_id, rho, position FROM r")
def rank_by_distance(spark, sf):
    return parts.rank_by_distance(pair_particles(spark, sf)).select("particle_id", "rho", "position")


@query(
    "survival_threshold",
    f"WITH {RANKED} SELECT rho AS threshold, (SELECT count(*) FROM p) AS n, {KEPT}::BIGINT AS kept FROM r WHERE position = {KEPT}",
)
def survival_threshold(spark, sf):
    return parts.survival_threshold(pair_particles(spark, sf), 0.75)


@query("keep_best", f"WITH {RANKED} SELECT particle_id, rho FROM r WHERE position <= {KEPT}")
def keep_best(spark, sf):
    return parts.keep_best(pair_particles(spark, sf), 0.75).select("particle_id", "rho")


SURVIVORS = f"{RANKED}, s AS (SELECT *, row_number() OVER (ORDER BY particle_id) AS idx FROM r WHERE position <= {KEPT})"


@query(
    "select_resample",
    f"""
WITH {SURVIVORS}, d AS (SELECT particle_id, {sql_pool_index(4, 'resample', KEPT, 'particle_id')} AS idx FROM r WHERE position > {KEPT})
SELECT particle_id, particle_id AS parent_id, x, rho, false AS replaced FROM s
UNION ALL SELECT d.particle_id, s.particle_id, s.x, s.rho, true FROM d JOIN s USING (idx)
""",
)
def select_resample(spark, sf):
    resampled, _ = parts.select_resample(pair_particles(spark, sf), 0.75, 4)
    return resampled.select("particle_id", "parent_id", F.col("theta")[0].alias("x"), "rho", "replaced")


@query(
    "gather_survivors",
    f"""
WITH {SURVIVORS}, d AS (SELECT o_orderkey, {sql_pool_index(6, 'slot', KEPT, 'o_orderkey')} AS idx FROM orders)
SELECT o_orderkey, particle_id AS parent_id, x, rho FROM d JOIN s USING (idx)
""",
)
def gather_survivors(spark, sf):
    from cellgauge.functions import draws

    best = settle(parts.keep_best(pair_particles(spark, sf), 0.75))
    survivors = cell_ops.index_pool(best, ["particle_id"])
    index = draws.pool_index(6, "slot", ["o_orderkey"], float(best.count()))
    slots = table(spark, sf, "orders").select("o_orderkey", index.alias("idx"))
    out = parts.gather_survivors(slots, survivors)
    return out.select("o_orderkey", "parent_id", F.col("theta")[0].alias("x"), "rho")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("particle_id"), F.col("embedding").cast("array<double>").alias("theta")
    )


WIDE = priors.Layout(shared=tuple(priors.Param(f"e{i}", "uniform", -1.0, 1.0) for i in range(1, 65)))


@query(
    "particle_covariance",
    """
WITH v AS (SELECT vec_id, unnest(range(1, 65)) AS i, embedding FROM embeddings),
w AS (SELECT vec_id, i, unnest(range(i, 65)) AS j, embedding FROM v)
SELECT i::INTEGER AS i, j::INTEGER AS j,
  round(covar_samp(embedding[i]::DOUBLE, embedding[j]::DOUBLE) * 2.38 * 2.38 / 64, 9) AS value FROM w GROUP BY ALL
""",
)
def particle_covariance(spark, sf):
    return rounded(parts.particle_covariance(vectors(spark, sf), 64), value=9)


@query(
    "unpack_theta",
    """SELECT vec_id AS particle_id, i::INTEGER AS position, 'e' || i::VARCHAR AS param, NULL::INTEGER AS well,
  round(embedding[i]::DOUBLE, 8) AS value FROM embeddings, range(1, 65) t(i)""",
)
def unpack_theta(spark, sf):
    return rounded(priors.unpack_theta(vectors(spark, sf), WIDE), value=8)


@query(
    "pack_theta",
    "SELECT vec_id AS particle_id, unnest(range(1, 65))::INTEGER AS position, round(unnest(embedding)::DOUBLE, 8) AS value FROM embeddings",
)
def pack_theta(spark, sf):
    packed = priors.theta_from_long(priors.unpack_theta(vectors(spark, sf), WIDE))
    out = packed.select("particle_id", F.posexplode("theta").alias("position", "value"))
    return rounded(out.withColumn("position", F.col("position") + 1), value=8)


@query(
    "slice_params",
    "SELECT vec_id AS particle_id, round(embedding[3]::DOUBLE, 8) AS e3, round(embedding[40]::DOUBLE, 8) AS e40 FROM embeddings",
)
def slice_params(spark, sf):
    named = priors.slice_params(vectors(spark, sf), WIDE, ["e3", "e40"])
    return rounded(named.select("particle_id", "e3", "e40"), e3=8, e40=8)


@query(
    "override_parameter",
    """
WITH t AS (SELECT 'n' || s_nationkey::VARCHAR AS scenario, s_suppkey::INTEGER AS well, 'mu' AS param, s_acctbal AS value FROM supplier)
SELECT scenario, well, param, CASE WHEN value < 2000 THEN 0.02 ELSE value END::DOUBLE AS value FROM t
""",
)
def override_parameter(spark, sf):
    truth = table(spark, sf, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("scenario"),
        F.col("s_suppkey").cast("int").alias("well"), F.lit("mu").alias("param"), F.col("s_acctbal").alias("value"),
    )
    changes = truth.filter("value < 2000").withColumn("value", F.lit(0.02))
    return priors.override_parameter(truth, changes)


@query(
    "abc_accept",
    f"""
WITH {PARTICLES}, s AS (SELECT particle_id, x + 1 AS x1, rho - 500 AS rho1 FROM p WHERE particle_id % 3 = 0)
SELECT particle_id, CASE WHEN rho1 <= 3000 THEN x1 ELSE x END AS x, CASE WHEN rho1 <= 3000 THEN rho1 ELSE rho END AS rho,
  coalesce(rho1 <= 3000, false) AS moved FROM p LEFT JOIN s USING (particle_id)
""",
)
def abc_accept(spark, sf):
    state = pair_particles(spark, sf)
    scored = state.filter("particle_id % 3 = 0").select(
        "particle_id", F.array(F.col("theta")[0] + 1, F.col("theta")[1]).alias("proposal"),
        (F.col("rho") - 500).alias("rho_new"),
    )
    out = parts.abc_accept(state, scored, 3000.0)
    return out.select("particle_id", F.col("theta")[0].alias("x"), "rho", "moved")


@query(
    "acceptance_repeat",
    """
WITH a AS (SELECT c_nationkey, count(*) FILTER (c_acctbal < 1000) AS accepted, count(*) AS attempted FROM customer GROUP BY 1),
b AS (SELECT *, accepted::DOUBLE / attempted AS rate FROM a)
SELECT c_nationkey, accepted, attempted, round(rate, 9) AS rate,
  CASE WHEN rate >= 1 THEN 1 WHEN rate > 0 THEN ceil(ln(0.01::DOUBLE) / ln(1 - rate)) END::BIGINT AS repeats FROM b
""",
)
def acceptance_repeat(spark, sf):
    moves = table(spark, sf, "customer").select("c_nationkey", (F.col("c_acctbal") < 1000).alias("moved"))
    rates = parts.acceptance_rate(moves, keys=["c_nationkey"])
    return rounded(rates.withColumn("repeats", parts.repeat_count("rate", 0.01)), rate=9)


@query(
    "expand_particles",
    """
SELECT t AS time, q AS quenched, cell::INTEGER AS cell, count(*) AS n, sum(c_custkey)::BIGINT AS ids
FROM customer, unnest([10.0::DOUBLE, 60.0]) a(t), unnest([true, false]) b(q), range(1, 21) c(cell) GROUP BY ALL
""",
)
def expand_particles(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("particle_id"))
    rows = predict.expand_particles(customers, {"time": [10.0, 60.0], "quenched": [True, False]}, 20)
    return rows.groupBy("time", "quenched", "cell").agg(F.count("*").alias("n"), F.sum("particle_id").alias("ids"))


# --- prediction and scoring -----------------------------------------------

ASSOCIATION_TIMES = (3600.0, 7200.0)
ASSOCIATION_CELLS = 40
ASSOCIATION_PREPARED = 10
ASSOCIATION_LAYOUT = priors.association_hierarchical("corrupted", 2)


def association_particles(spark, sf):
    """One particle per supplier: two wells' means, then the shared block."""
    key = F.col("s_suppkey")
    r = 1e-7 * (1 + key % 7)
    k = 5.0 + key % 11
    return table(spark, sf, "supplier").select(
        key.alias("particle_id"),
        F.array(r, r * 2, k, k + 1, F.lit(1e-7), F.lit(2.0), r, k, F.lit(1e-8), F.lit(0.1)).alias("theta"),
    )


def association_model(spark, sf):
    pool = settle(view_pool(spark, sf))
    return predict.Association(
        ASSOCIATION_LAYOUT, ASSOCIATION_TIMES, ASSOCIATION_CELLS, pool, pool, 8, method="md5",
        prepared=ASSOCIATION_PREPARED,
    )


A_TOTAL = "(1.01e-6::DOUBLE * 9.95e7::DOUBLE)"

ASSOCIATION_SQL = f"""pool AS (SELECT row_number() OVER (ORDER BY event_id) AS idx, value FROM events WHERE event_type = 'view'),
w AS (SELECT s_suppkey AS particle_id, rep, 1e-7::DOUBLE * (1 + s_suppkey % 7) * rep AS mean_r,
  5.0::DOUBLE + s_suppkey % 11 + (rep - 1) AS mean_k FROM supplier, range(1, 3) t(rep)),
prep AS (SELECT particle_id, rep, step, step * 1800.0::DOUBLE AS t, mean_r, mean_k,
  {sql_lognormal(8, 'prep-r', 'mean_r', '1e-7::DOUBLE', 'particle_id', 'rep', 'step', 'cell')} AS r,
  {sql_lognormal(8, 'prep-K', 'mean_k', '2.0::DOUBLE', 'particle_id', 'rep', 'step', 'cell')} AS k
  FROM w, range(0, 5) a(step), range(1, {ASSOCIATION_PREPARED + 1}) b(cell)),
bound AS (SELECT *, {A_TOTAL} * (1 - ({A_TOTAL} - k) / ({A_TOTAL}
  - k * exp(-r * 5.31e-5::DOUBLE * ({A_TOTAL} - k) * t / (k * 1.01e-6::DOUBLE)))) AS b FROM prep),
free AS (SELECT particle_id, rep, step, t, mean_r, mean_k, avg(9.95e7::DOUBLE - b / 1.01e-6::DOUBLE) AS u FROM bound GROUP BY ALL),
lagged AS (SELECT *, lag(u) OVER (PARTITION BY particle_id, rep ORDER BY step) AS u0 FROM free),
expo AS (SELECT *, sum(CASE WHEN u0 IS NULL THEN 0 ELSE 0.5 * (u + u0) * 1800 END)
  OVER (PARTITION BY particle_id, rep ORDER BY step) AS exposure FROM lagged),
cell AS (SELECT particle_id, rep, step, t AS time, cell, exposure,
  {sql_lognormal(8, 'r', 'mean_r', '1e-7::DOUBLE', 'particle_id', 'rep', 'step', 'cell')} AS r,
  {sql_lognormal(8, 'K', 'mean_k', '2.0::DOUBLE', 'particle_id', 'rep', 'step', 'cell')} AS k,
  {sql_pool_index(8, 'cell', '(SELECT count(*) FROM pool)', 'particle_id', 'rep', 'step', 'cell')} AS idx
  FROM expo, range(1, {ASSOCIATION_CELLS + 1}) c(cell) WHERE t IN (3600, 7200)),
dosed AS (SELECT cell.*, k * (1 - exp(-5.31e-5::DOUBLE * r * exposure / k)) AS dose FROM cell),
taken AS (SELECT particle_id, rep, step, cell, dose, i,
  {sql_pool_index(8, 'dose', '(SELECT count(*) FROM pool)', 'particle_id', 'rep', 'step', 'cell', 'i')} AS idx
  FROM (SELECT *, unnest(range(1, ceil(dose)::BIGINT + 1)) AS i FROM dosed)),
summed AS (SELECT particle_id, rep, step, cell, sum(least(1, dose - i + 1) * value) AS taken
  FROM taken JOIN pool USING (idx) GROUP BY ALL),
pred AS (SELECT particle_id, rep, time, cell, value + coalesce(taken, 0) AS value
  FROM dosed JOIN pool USING (idx) LEFT JOIN summed USING (particle_id, rep, step, cell))"""


@query(
    "predict_association",
    f"WITH {ASSOCIATION_SQL} SELECT particle_id, rep::INTEGER AS rep, time, cell::INTEGER AS cell, round(value, 4) AS value FROM pred",
)
def predict_association(spark, sf):
    return rounded(association_model(spark, sf)(association_particles(spark, sf)), value=4)


@query(
    "score_particles",
    f"""WITH {ASSOCIATION_SQL}, obs AS (SELECT (CASE l_linestatus WHEN 'F' THEN 3600 ELSE 7200 END)::DOUBLE AS time,
  (CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END)::BIGINT AS rep, l_extendedprice / 100 AS value FROM lineitem),
{grid_sql('obs', 'time, rep', 'value')}, {placed_sql('pred', 'time, rep', 'value', 's.particle_id', 'g', 'f')},
{ad_sql('f', 'particle_id, time, rep', 'd')}
SELECT particle_id, round(sum(ad), 5) AS rho, NULL::VARCHAR AS reason FROM d GROUP BY particle_id""",
)
def score_particles(spark, sf):
    line = table(spark, sf, "lineitem")
    seen = line.select(
        F.when(F.col("l_linestatus") == "F", 3600.0).otherwise(7200.0).alias("time"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("rep"),
        (F.col("l_extendedprice") / 100).alias("value"),
    )
    observed = observe(seen, ["time", "rep"], ["value"])
    scored = predict.score_particles(association_particles(spark, sf), association_model(spark, sf), observed)
    return rounded(scored.select("particle_id", "rho", "reason"), rho=5)


INTERNALISATION_TIMES = (10.0, 60.0)
INTERNALISATION_CELLS = 20
INTERNALISATION_LAYOUT = priors.internalisation_hierarchical(2)


def internalisation_particles(spark, sf):
    key = F.col("s_suppkey")
    lam, beta, amount = 0.06 + key % 5 / 50.0, 0.03 + key % 3 / 50.0, 0.05 + key % 4 / 40.0
    shared = [0.01, 0.005, 0.02, 0.08, 0.05, 0.05, 0.01, 0.005, 0.01, 5.0, 2.0, 8500.0, 38.0, 0.075, 0.9, -1.0]
    wells = [lam, lam + 0.01, beta, beta + 0.01, amount, amount + 0.01]
    return table(spark, sf, "supplier").select(
        key.alias("particle_id"), F.array(*wells, *[F.lit(v) for v in shared]).alias("theta")
    )


def internalisation_model(spark, sf, cells_per_sample=INTERNALISATION_CELLS, layout=INTERNALISATION_LAYOUT, method="md5"):
    pool = view_pool(spark, sf).select("idx", F.col("value").alias("cy5"), (F.col("value") / 10).alias("bdp"))
    return predict.Internalisation(
        layout, INTERNALISATION_TIMES, cells_per_sample, settle(pool), 0.95, 8, method=method
    )


def _internalisation_sql(wells: str, pool: str, times: str, count: str, cells_: int, spreads: tuple, eta: str) -> str:
    """CTEs up to ``pred``: cells of the model for the well means in CTE ``w``.

    ``pool`` is the body of a CTE with idx, cy5 and bdp; ``times`` a list of ``count``
    times; ``spreads`` the within-well spreads of the three cell parameters.
    """
    key = ("particle_id", "t_index", "rep", "quenched::INTEGER", "cell")
    shares = """lambda_i * (beta_i * p * s * a * t + lambda_i * (1 - p) * (s + beta_i * p)
      - lambda_i * (1 - p) * exp(-beta_i * t) * (beta_i * beta_i * (1 - exp(-d * t)) / d + a + beta_i)) / (s * a * a) AS internal,
    beta_i * (p * s + lambda_i * (1 - p) * exp(-beta_i * t) * (1 + beta_i * (1 - exp(-d * t)) / d)) / (s * a) AS surface"""
    return f"""pool AS ({pool}), w AS ({wells}),
slot AS (SELECT *, ({times})[t_index] AS t, 0.075::DOUBLE AS p
  FROM w, range(1, {count} + 1) a(t_index), unnest([true, false]) b(quenched), range(1, {cells_ + 1}) c(cell)),
cell AS (SELECT *, {sql_gamma(8, 'lambda', 'ml', f'{spreads[0]!r}::DOUBLE', '0.9::DOUBLE', *key)} AS lambda_i,
  {sql_gamma(8, 'beta', 'mb', f'{spreads[1]!r}::DOUBLE', '(-1.0::DOUBLE)', *key)} AS beta_i,
  {sql_lognormal(8, 'R', 'mr', f'{spreads[2]!r}::DOUBLE', *key)} AS r,
  5 * {sql_normal(8, 'noise', *key)} AS n1, 2 * {sql_normal(8, 'noise', *key, part=2)} AS n2,
  {sql_pool_index(8, 'pool', '(SELECT count(*) FROM pool)', *key)} AS idx FROM slot),
named AS (SELECT *, lambda_i + beta_i AS s, lambda_i + beta_i * p AS a, lambda_i + beta_i * p - beta_i AS d FROM cell),
shares AS (SELECT *, {shares} FROM named),
pred AS (SELECT particle_id, t AS time, quenched, rep::INTEGER AS rep, cell::INTEGER AS cell,
  8500 * greatest(0, CASE WHEN quenched THEN r * (internal + (1 - {eta}) * surface) ELSE r * (surface + internal) END)
    + pool.cy5 + n1 AS cy5,
  38 * greatest(0, r * (surface + internal)) + pool.bdp + n2 AS bdp FROM shares JOIN pool USING (idx))"""


SUPPLIER_PREDICTION = _internalisation_sql(
    """SELECT s_suppkey AS particle_id, rep, 0.06::DOUBLE + s_suppkey % 5 / 50.0::DOUBLE + 0.01::DOUBLE * (rep - 1) AS ml,
  0.03::DOUBLE + s_suppkey % 3 / 50.0::DOUBLE + 0.01::DOUBLE * (rep - 1) AS mb,
  0.05::DOUBLE + s_suppkey % 4 / 40.0::DOUBLE + 0.01::DOUBLE * (rep - 1) AS mr FROM supplier, range(1, 3) r(rep)""",
    """SELECT row_number() OVER (ORDER BY event_id) AS idx, value AS cy5, value / 10 AS bdp
  FROM events WHERE event_type = 'view'""",
    "[10.0::DOUBLE, 60.0]", "2", INTERNALISATION_CELLS, (0.01, 0.005, 0.02), "0.95::DOUBLE",
)


@query(
    "predict_internalisation",
    f"WITH {SUPPLIER_PREDICTION} SELECT * REPLACE (round(cy5, 3) AS cy5, round(bdp, 4) AS bdp) FROM pred",
)
def predict_internalisation(spark, sf):
    predicted = internalisation_model(spark, sf)(internalisation_particles(spark, sf))
    return rounded(predicted, cy5=3, bdp=4)


# --- whole runs: no SQL twin ----------------------------------------------


def _observed_association(spark, sf):
    """lineitem as an observed association experiment with two wells and two times."""
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", 3600.0).otherwise(7200.0).alias("time"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("rep"),
        (F.col("l_extendedprice") / 100).alias("value"),
    )


def _association_controls(spark, sf):
    return cal.Controls(
        ASSOCIATION_TIMES, cell_pool=settle(view_pool(spark, sf)), particle_pool=settle(view_pool(spark, sf, "click"))
    )


@query("calibrate")
def calibrate(spark, sf):
    """One round of a small pooled association run against lineitem."""
    run = cal.Run("association", "pooled", "corrupted", particles=16, trial=1, cells=200, cut=0.5, min_rate=0.0)
    state, _ = cal.run_pooled(
        spark, run, _observed_association(spark, sf), _association_controls(spark, sf), scratch_path(spark, "runs"), 3,
        max_rounds=1, max_steps=1,
    )
    return state.select("particle_id", F.size("theta").alias("m"), "rho")


@query("calibrate_hierarchical")
def calibrate_hierarchical(spark, sf):
    """Round metrics of a small run with wells."""
    run = cal.Run("association", "hierarchical", "corrupted", particles=12, trial=1, cells=100, cut=0.5, min_rate=0.0, wells=2)
    _, metrics = cal.run_hierarchical(
        spark, run, _observed_association(spark, sf), _association_controls(spark, sf), scratch_path(spark, "runs"), 3,
        max_rounds=1, max_steps=1,
    )
    return metrics.select("run_id", "round", "threshold", "trial_rate", "steps", "rate", "stop")


# --- synthetic scenarios --------------------------------------------------


def _truth_sql(name: str, mean: float, spread: float, changes: str = "") -> str:
    """A well mean drawn once per well, then altered in single wells of single scenarios."""
    draw = sql_truncated(8, name, f"{mean}::DOUBLE", f"{spread}::DOUBLE", "1", "rep")
    return f"CASE {changes} ELSE {draw} END" if changes else f"({draw})"


SCENARIO_CELLS = 200

SCENARIO_PREDICTION = _internalisation_sql(
    f"""SELECT particle_id, rep,
  {_truth_sql('mu_lambda', 0.08, 0.01, 'WHEN particle_id > 1 AND rep = 1 THEN 0.02::DOUBLE WHEN particle_id = 3 AND rep = 3 THEN 0.14::DOUBLE')} AS ml,
  {_truth_sql('mu_beta', 0.05, 0.005)} AS mb, {_truth_sql('mu_R', 0.05, 0.01)} AS mr
  FROM range(1, 4) s(particle_id), range(1, 4) r(rep)""",
    f"""SELECT row_number() OVER (ORDER BY {', '.join(CELL_ORDER)}) AS idx, signal_cy5 AS cy5, signal_bdp AS bdp
  FROM cells WHERE time = 0 AND NOT quenched AND temp = 37""",
    "(SELECT list(DISTINCT time ORDER BY time) FROM cells WHERE time > (SELECT min(time) FROM cells))",
    "(SELECT count(DISTINCT time) - 1 FROM cells)",
    SCENARIO_CELLS, (0.01, 0.05, 0.25),
    "(SELECT 1 - avg(signal_cy5) FILTER (quenched) / avg(signal_cy5) FILTER (NOT quenched) FROM cells WHERE time = 120 AND temp = 4)",
)


@query(
    "synthesise_scenarios",
    f"""WITH {CELLS}, {SCENARIO_PREDICTION}
SELECT ['uncorrupted', 'corrupted', 'corrupted2'][particle_id] AS scenario, time, rep, quenched, count(*) AS n,
  round(median(cy5), 3) AS cy5, round(median(bdp), 4) AS bdp FROM pred GROUP BY ALL""",
)
def synthesise_scenarios(spark, sf):
    """Three scenarios of the internalisation model with lineitem's own controls."""
    layout = priors.internalisation_hierarchical(3)
    named = cells(spark, sf).withColumnRenamed("signal_cy5", "cy5").withColumnRenamed("signal_bdp", "bdp")
    order = [{"signal_cy5": "cy5", "signal_bdp": "bdp"}.get(c, c) for c in CELL_ORDER]
    pool = settle(cell_ops.background_pool(named, ["cy5", "bdp"], order))
    eta = cell_ops.quench_efficiency(named, "cy5").first()["eta"]
    times = tuple(r[0] for r in cell_ops.distinct_times(named).collect())
    model = predict.Internalisation(layout, times, SCENARIO_CELLS, pool, eta, 8, method="md5")
    samples, _ = cal.synthesise_scenarios(spark, "internalisation", model, layout, 8)
    # A sample has SCENARIO_CELLS cells, so an exact median is safe here.
    out = samples.groupBy("scenario", "time", "rep", "quenched").agg(
        F.count("*").alias("n"), F.median("cy5").alias("cy5"), F.median("bdp").alias("bdp")
    )
    return rounded(out, cy5=3, bdp=4)
