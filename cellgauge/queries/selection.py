"""Selection over table-held candidates, its metrics and the stop rule.

Every supplier is a candidate and its rows of ``lineitem`` are its cells.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellgauge.operators import selection as sel
from cellgauge.operators.discrepancy import observe
from cellgauge.plans.scale import scratch_path
from cellgauge.queries.distances import ONE_CHANNEL, ad_sql, grid_sql, placed_sql
from cellgauge.queries.registry import CELLS, cells, query, rounded, sql_pool_index, sql_uniform, table

SEED, TRIAL, CUT, C, MIN_RATE = 11, 3, 0.5, 0.1, 0.15

SCORES = f"""{CELLS}, {grid_sql('cells', 'quenched', 'signal_cy5')},
{placed_sql('cells', 'quenched', 'signal_cy5', 's.l_suppkey', 'g', 'f')}, {ad_sql('f', 'l_suppkey, quenched', 'a')}, {ONE_CHANNEL},
traits AS (SELECT l_suppkey, round(avg(signal_cy5), 4) AS trait, ln(count(*)) AS log_prior FROM cells GROUP BY l_suppkey),
scores AS MATERIALIZED (SELECT l_suppkey AS candidate_id, row_number() OVER (ORDER BY trait, l_suppkey) AS place,
  CASE WHEN m = (SELECT count(*) FROM g_r) THEN round(s, 6) ELSE 'infinity'::DOUBLE END AS rho, log_prior FROM d JOIN traits USING (l_suppkey))"""


def candidates(spark, sf):
    df = cells(spark, sf)
    order, prior = F.round(F.avg("signal_cy5"), 4), F.log(F.count(F.lit(1)))
    found = sel.candidates(df, observe(df, ["quenched"], ["signal_cy5"]), "l_suppkey", order, prior)
    return rounded(found, rho=6)


@query("table_candidates", f"WITH {SCORES} SELECT candidate_id, place, rho, round(log_prior, 9) AS log_prior FROM scores")
def table_candidates(spark, sf):
    return rounded(candidates(spark, sf), log_prior=9)


# One iteration of the recursion is the start of a round or one step of all particles.
RUN = f"""WITH RECURSIVE {SCORES},
run AS (
  SELECT 0 AS round, 0 AS step, 0 AS total, candidate_id AS id, place, rho, log_prior, 0::BIGINT AS moves, false AS moving,
    NULL::DOUBLE AS threshold, NULL::BIGINT AS width, NULL::BIGINT AS n_moving, NULL::DOUBLE AS trial_rate, NULL::BIGINT AS repeat,
    NULL::BIGINT AS accepted, NULL::DOUBLE AS rate, NULL::VARCHAR AS stop FROM scores
  UNION ALL
  (WITH ranked AS (SELECT *, row_number() OVER (ORDER BY rho, id) AS position, count(*) OVER () - floor({CUT} * count(*) OVER ()) AS kept
      FROM run WHERE step = total AND stop IS NULL),
    best AS (SELECT *, row_number() OVER (ORDER BY id) AS idx FROM ranked WHERE position <= kept),
    slots AS (SELECT id, {sql_pool_index(SEED, "resample-' || (round + 1)::VARCHAR || '", 'kept', 'id')} AS idx FROM ranked WHERE position > kept),
    filled AS (SELECT round, id, place, rho, log_prior, false AS moving FROM best
      UNION ALL SELECT round, slots.id, place, rho, log_prior, true FROM slots JOIN best USING (idx)),
    begun AS (SELECT round + 1 AS round, 0 AS step, {TRIAL} AS total, id, place, rho, log_prior, 0::BIGINT AS moves, moving,
      max(rho) FILTER (NOT moving) OVER () AS threshold, greatest(1, ceil(2.38::DOUBLE * coalesce(stddev_samp(place) OVER (), 0)))::BIGINT AS width FROM filled),
    drawn AS (SELECT *, {sql_pool_index(SEED, 'step', '2 * width', 'round', 'step + 1', 'id')} AS k,
      {sql_uniform(SEED, 'accept', 'round', 'step + 1', 'id')} AS u FROM run WHERE step < total),
    tried AS (SELECT drawn.*, s.place AS p1, s.rho AS r1, s.log_prior AS l1,
      moving AND coalesce(s.rho <= threshold AND ln(u) <= least(0, s.log_prior - drawn.log_prior), false) AS taken
      FROM drawn LEFT JOIN scores s ON s.place = drawn.place + CASE WHEN k <= width THEN -k ELSE k - width END),
    moved AS (SELECT round, step + 1 AS step, total, id, CASE WHEN taken THEN p1 ELSE place END AS place, CASE WHEN taken THEN r1 ELSE rho END AS rho,
      CASE WHEN taken THEN l1 ELSE log_prior END AS log_prior, moves + taken::INTEGER AS moves, moving, threshold, width,
      sum(moves + taken::INTEGER) OVER () AS done, count(*) FILTER (moving) OVER () AS n, trial_rate, repeat FROM tried),
    tested AS (SELECT * REPLACE (CASE WHEN step = {TRIAL} THEN done::DOUBLE / (n * {TRIAL}) ELSE trial_rate END AS trial_rate) FROM moved),
    planned AS (SELECT * REPLACE (CASE WHEN step <> {TRIAL} THEN repeat WHEN trial_rate >= 1 THEN 1
        WHEN trial_rate > 0 THEN ceil(ln({C}::DOUBLE) / ln(1 - trial_rate)) END::BIGINT AS repeat) FROM tested),
    sized AS (SELECT * REPLACE (CASE WHEN step = {TRIAL} THEN greatest({TRIAL}, coalesce(repeat, {TRIAL})) ELSE total END::INTEGER AS total) FROM planned),
    ended AS (SELECT *, CASE WHEN step = total THEN done::DOUBLE / (n * total) END AS rate FROM sized)
    SELECT round, step, total, id, place, rho, log_prior, moves, moving, threshold, width, NULL, NULL, NULL, NULL, NULL, NULL FROM begun
    UNION ALL SELECT round, step, total, id, place, rho, log_prior, moves, moving, threshold, width, n, trial_rate, repeat, done::BIGINT, rate,
      CASE WHEN step = total AND NOT rate >= {MIN_RATE} THEN 'min_accept' END FROM ended))"""


def selected(spark, sf):
    config = sel.Selection(
        "suppliers", scratch_path(spark, "selection"), SEED, TRIAL, c=C, cut=CUT, min_rate=MIN_RATE, method="md5"
    )
    scores = candidates(spark, sf)
    return (*sel.select(spark, config, scores), scores)


@query(
    "select_candidates",
    f"{RUN} SELECT id AS particle_id, s.candidate_id, run.rho FROM run JOIN scores s USING (place) WHERE stop IS NOT NULL",
)
def select_candidates(spark, sf):
    """A particle per supplier, selected to the stop rule."""
    final, _, scores = selected(spark, sf)
    return final.join(scores.select("place", "candidate_id"), "place").select("particle_id", "candidate_id", "rho")


@query(
    "round_metrics",
    f"""{RUN} SELECT DISTINCT round, threshold, width, n_moving AS moving, round(trial_rate, 9) AS trial_rate, repeat, total AS steps, accepted,
  round(rate, 9) AS rate, stop FROM run WHERE step = total AND round > 0""",
)
def round_metrics(spark, sf):
    """The rows that the run appended round by round."""
    _, metrics, _ = selected(spark, sf)
    return rounded(metrics.drop("run_id", "seconds"), trial_rate=9, rate=9)


# --- T3 over a table of rounds: users are runs, their events are rounds ---

ROUNDS = """rounds AS (SELECT user_id, row_number() OVER w AS round, min(value) OVER w AS threshold,
  (CASE event_type WHEN 'purchase' THEN 0 ELSE value / 500 END)::DOUBLE AS rate, sum(value) OVER w AS seconds
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


@query(
    "stop_rule",
    f"""
WITH {ROUNDS}, r AS (SELECT *, CASE WHEN threshold < 3 THEN 'target' WHEN seconds > 3000 THEN 'budget' WHEN NOT rate >= 0.002 THEN 'min_accept'
  WHEN round >= 12 THEN 'max_rounds' END AS stop FROM rounds)
SELECT user_id, round, stop FROM r WHERE stop IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round) = 1
""",
)
def stop_rule(spark, sf):
    events = table(spark, sf, "events")
    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rounds = events.select(
        "user_id", F.row_number().over(so_far).cast("long").alias("round"), F.min("value").over(so_far).alias("threshold"),
        F.when(F.col("event_type") == "purchase", 0.0).otherwise(F.col("value") / 500).alias("rate"),
        F.sum("value").over(so_far).alias("seconds"),
    )
    return sel.first_stop(rounds, ["user_id"], min_rate=0.002, target=3.0, max_minutes=50.0, max_rounds=12)
