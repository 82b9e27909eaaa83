"""Closed-form responses, uptake and doses over tables of cell parameters.

``part`` holds the parameters of one cell per row; ``events`` is a control pool and,
by user, a long time series.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.functions import draws, response
from cellgauge.operators import predict, uptake
from cellgauge.queries.registry import query, rounded, sql_normal, sql_pool_index, table
from cellgauge.queries.wells import view_pool

TIMES = [0.0, 10.0, 60.0, 120.0]

RATES = """rates AS (SELECT p_partkey, p_size / 100.0::DOUBLE AS lam, (p_retailprice - 850) / 2000 AS beta,
  (p_partkey % 10) / 50.0::DOUBLE AS p FROM part),
timed AS (SELECT *, unnest([0.0::DOUBLE, 10.0, 60.0, 120.0]) AS t FROM rates),
named AS (SELECT *, lam + beta AS s, lam + beta * p AS a, lam - beta * (1 - p) AS d FROM timed),
phi AS (SELECT *, CASE WHEN abs(d * t) < 1e-6 THEN 1 - d * t / 2 ELSE (1 - exp(-d * t)) / (d * t) END AS phi FROM named),
shares AS (SELECT *,
  CASE WHEN abs(d) < 1e-5 THEN lam * (beta * p * s * a * t + lam * (1 - p) * (s + beta * p)
      - lam * (1 - p) * exp(-beta * t) * (beta * beta * t * phi + a + beta)) / (s * a * a) ELSE
  (lam * d * (beta * p * s * a * t + lam * (1 - p) * (s + beta * p))
    + lam * lam * (1 - p) * (beta * beta * exp(-a * t) - a * a * exp(-beta * t))) / (s * a * a * d) END AS internal,
  CASE WHEN abs(d) < 1e-5 THEN beta * (p * s + lam * (1 - p) * exp(-beta * t) * (1 + beta * t * phi)) / (s * a) ELSE
  beta * (p * s * d + lam * (1 - p) * (a * exp(-beta * t) - beta * exp(-a * t))) / (s * a * d) END AS surface,
  beta * (p * s * d + lam * beta * (lam * p - 1) * exp(-a * t) + lam * p * exp(-beta * t)) / (s * a * d) AS published
  FROM phi)"""


def rates(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_size") / 100.0).alias("lam"),
        ((F.col("p_retailprice") - 850) / 2000).alias("beta"),
        (F.col("p_partkey") % 10 / 50.0).alias("p"),
    )
    return part.withColumn("t", F.explode(F.lit(TIMES)))


@query(
    "compartment_response",
    f"WITH {RATES} SELECT p_partkey, t, round(surface, 6) AS surface, round(internal, 6) AS internal FROM shares",
)
def compartment_response(spark, sf):
    surface, internal = response.compartment_response("t", "lam", "beta", "p")
    return rates(spark, sf).select(
        "p_partkey", "t", F.round(surface, 6).alias("surface"), F.round(internal, 6).alias("internal")
    )


# The published form has a pole at d = 0; values next to it are nulled on both sides.
@query(
    "compartment_reference_form",
    f"WITH {RATES} SELECT p_partkey, t, CASE WHEN abs(d) > 1e-5 THEN round(published, 6) END AS surface FROM shares",
)
def compartment_reference_form(spark, sf):
    surface, _ = response.compartment_response("t", "lam", "beta", "p", form="reference")
    safe = F.abs(F.col("lam") - F.col("beta") * (1 - F.col("p"))) > 1e-5
    return rates(spark, sf).select("p_partkey", "t", F.when(safe, F.round(surface, 6)).alias("surface"))


# p_size 25 carries exactly the capacity at which the equal-capacity branch applies.
ASSOCIATION = """assoc AS (SELECT p_partkey, p_brand, p_size * 1e-8::DOUBLE AS r,
  CASE WHEN p_size = 25 THEN 1.01e-6::DOUBLE * 9.95e7::DOUBLE ELSE p_retailprice / 50 END AS k FROM part)"""

BOUND = """CASE WHEN 1.01e-6::DOUBLE * 9.95e7::DOUBLE = k
    THEN r * 5.31e-5::DOUBLE * 9.95e7::DOUBLE * 9.95e7::DOUBLE * 1.01e-6::DOUBLE * t / (k + r * 5.31e-5::DOUBLE * 9.95e7::DOUBLE * t)
    ELSE 1.01e-6::DOUBLE * 9.95e7::DOUBLE * (1 - (1.01e-6::DOUBLE * 9.95e7::DOUBLE - k) / (1.01e-6::DOUBLE * 9.95e7::DOUBLE
      - k * exp(-(r * 5.31e-5::DOUBLE * (1.01e-6::DOUBLE * 9.95e7::DOUBLE - k) * t) / (k * 1.01e-6::DOUBLE)))) END"""


def association_cells(spark, sf):
    full = response.Geometry().volume * response.Geometry().concentration
    return table(spark, sf, "part").select(
        "p_partkey", "p_brand", (F.col("p_size") * 1e-8).alias("r"),
        F.when(F.col("p_size") == 25, F.lit(full)).otherwise(F.col("p_retailprice") / 50).alias("k"),
    )


@query(
    "association_response",
    f"""WITH {ASSOCIATION}, timed AS (SELECT *, unnest([3600.0::DOUBLE, 14400.0, 86400.0]) AS t FROM assoc)
SELECT p_partkey, t, round({BOUND}, 7) AS bound FROM timed""",
)
def association_response(spark, sf):
    timed = association_cells(spark, sf).withColumn("t", F.explode(F.lit([3600.0, 14400.0, 86400.0])))
    out = uptake.bound_particles(timed, "r", "k").select("p_partkey", "t", "bound")
    return rounded(out, bound=7)


@query(
    "saturating_uptake",
    f"""WITH {ASSOCIATION}, e AS (SELECT *, 9.95e7::DOUBLE * 3600 * (p_partkey % 24 + 1) AS u FROM assoc)
SELECT p_partkey, round(k * (1 - exp(-5.31e-5::DOUBLE * r * u / k)), 7) AS dose FROM e""",
)
def saturating_uptake(spark, sf):
    exposure = 9.95e7 * 3600 * (F.col("p_partkey") % 24 + 1)
    out = association_cells(spark, sf).select(
        "p_partkey", response.saturating_uptake("r", "k", exposure).alias("dose")
    )
    return rounded(out, dose=7)


def dose_sql(weight: str) -> str:
    return f"""
WITH pool AS (SELECT row_number() OVER (ORDER BY event_id) AS idx, value FROM events WHERE event_type = 'view'),
cell AS (SELECT p_partkey, p_size / 4.0::DOUBLE - 0.25 AS dose, p_retailprice AS background FROM part),
i AS (SELECT *, unnest(range(1, ceil(dose)::BIGINT + 1)) AS i FROM cell),
d AS (SELECT *, {sql_pool_index(5, "dose", "(SELECT count(*) FROM pool)", "p_partkey", "i")} AS idx FROM i),
w AS (SELECT p_partkey, sum(({weight}) * value) AS taken FROM d JOIN pool USING (idx) GROUP BY 1)
SELECT p_partkey, dose, round(background + coalesce(taken, 0), 4) AS value FROM cell LEFT JOIN w USING (p_partkey)"""


def dosed(spark, sf, form):
    doses = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") / 4.0 - 0.25).alias("dose"), F.col("p_retailprice").alias("background")
    )
    out = uptake.fractional_dose_sum(doses, ["p_partkey"], view_pool(spark, sf), 5, "dose", form=form)
    return rounded(out.select("p_partkey", "dose", "value"), value=4)


@query("fractional_dose", dose_sql("least(1, greatest(0, dose - i + 1))"))
def fractional_dose(spark, sf):
    return dosed(spark, sf, "balanced")


@query("fractional_dose_reference", dose_sql("CASE WHEN i < ceil(dose) THEN 1 ELSE dose - floor(dose) END"))
def fractional_dose_reference(spark, sf):
    return dosed(spark, sf, "reference")


@query(
    "fractional_dose_join",
    dose_sql("least(1, greatest(0, dose - i + 1))"),
)
def fractional_dose_join(spark, sf):
    doses = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") / 4.0 - 0.25).alias("dose"), F.col("p_retailprice").alias("background")
    )
    pool = view_pool(spark, sf)
    out = uptake.fractional_dose_join(doses, ["p_partkey"], pool, pool.count(), 5, "dose")
    return rounded(out.select("p_partkey", "dose", "value"), value=4)


@query(
    "assemble_signal",
    f"""
WITH {RATES}, c AS (SELECT p_partkey, t, surface, internal, p_partkey % 2 = 0 AS quenched, p_partkey / 1000.0::DOUBLE - 0.01 AS r,
  5 * {sql_normal(3, "noise", "p_partkey", "t::BIGINT")} AS noise FROM shares)
SELECT p_partkey, t, quenched,
  round(8500 * greatest(0, CASE WHEN quenched THEN r * (internal + (1 - 0.9::DOUBLE) * surface) ELSE r * (surface + internal) END)
    + 30 + noise, 3) AS cy5,
  round(38 * greatest(0, r * (surface + internal)) + 2 - noise, 3) AS bdp FROM c
""",
)
def assemble_signal(spark, sf):
    surface, internal = response.compartment_response("t", "lam", "beta", "p")
    noise = draws.normal(3, "noise", ["p_partkey", F.col("t").cast("long")], 0.0, 5.0)
    df = rates(spark, sf).select(
        "p_partkey", "t", surface.alias("surface"), internal.alias("internal"),
        (F.col("p_partkey") % 2 == 0).alias("quenched"), (F.col("p_partkey") / 1000.0 - 0.01).alias("R"),
        noise.alias("noise_1"), (-noise).alias("noise_2"), F.lit(8500.0).alias("alpha_1"), F.lit(38.0).alias("alpha_2"),
        F.lit(30.0).alias("back_cy5"), F.lit(2.0).alias("back_bdp"), F.lit(0.9).alias("eta"),
    )
    out = predict.assemble_signal(df).select("p_partkey", "t", "quenched", "cy5", "bdp")
    return rounded(out, cy5=3, bdp=3)


def seconds_since(day: str, ts: str):
    """Seconds from the start of a day, whatever the session's time zone."""
    whole = F.datediff(ts, F.lit(day)) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole + F.date_part(F.lit("SECOND"), ts).cast("double")


@query(
    "cumulative_trapezoid",
    """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE - 1704067200 AS t, value FROM events),
l AS (SELECT *, lag(t) OVER w AS t0, lag(value) OVER w AS v0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
a AS (SELECT *, CASE WHEN t0 IS NULL THEN 0.5 * (value + 50) * t ELSE 0.5 * (value + v0) * (t - t0) END AS area FROM l)
SELECT user_id, event_id, round(sum(area) OVER (PARTITION BY user_id ORDER BY t, event_id) / 1e6, 3) AS integral FROM a
""",
)
def cumulative_trapezoid(spark, sf):
    series = table(spark, sf, "events").select(
        "user_id", "event_id", "value",
        seconds_since("2024-01-01", "ts").alias("t"),
    )
    out = uptake.cumulative_trapezoid(series, ["user_id"], ["t", "event_id"], "t", "value", 50.0)
    return out.select("user_id", "event_id", F.round(F.col("integral") / 1e6, 3).alias("integral"))


FREE = f"""{ASSOCIATION}, timed AS (SELECT *, unnest(range(0, 49)) AS step FROM assoc),
placed AS (SELECT p_brand, step, step * 1800.0::DOUBLE AS t, r, k FROM timed),
free AS (SELECT p_brand, step, t, avg(9.95e7::DOUBLE - ({BOUND}) / 1.01e-6::DOUBLE) AS u FROM placed GROUP BY ALL)"""


def free(spark, sf):
    fine = uptake.fine_grid(association_cells(spark, sf), 48)
    bound = uptake.bound_particles(fine, "r", "k")
    return uptake.mean_free_concentration(bound, ["p_brand", "step", "t"], "bound")


@query(
    "mean_free_concentration",
    f"WITH {FREE} SELECT p_brand, step::INTEGER AS step, round(u / 1e6, 6) AS u FROM free",
)
def mean_free_concentration(spark, sf):
    return free(spark, sf).select("p_brand", "step", F.round(F.col("u") / 1e6, 6).alias("u"))


@query(
    "align_time",
    f"""
WITH {FREE}, l AS (SELECT *, lag(t) OVER w AS t0, lag(u) OVER w AS u0 FROM free WINDOW w AS (PARTITION BY p_brand ORDER BY step)),
a AS (SELECT *, CASE WHEN t0 IS NULL THEN 0.5 * (u + 9.95e7::DOUBLE) * t ELSE 0.5 * (u + u0) * (t - t0) END AS area FROM l),
c AS (SELECT *, sum(area) OVER (PARTITION BY p_brand ORDER BY step) AS exposure FROM a)
SELECT p_brand, t AS time, round(exposure / 1e9, 4) AS exposure FROM c
WHERE t IN (3600, 7200, 14400, 28800, 57600, 86400)
""",
)
def align_time(spark, sf):
    from cellgauge.operators.calibrate import ASSOCIATION_TIMES

    integral = uptake.cumulative_trapezoid(
        free(spark, sf), ["p_brand"], ["step"], "t", "u", 9.95e7, out="exposure", max_rows=49
    )
    aligned = uptake.align_time(integral, ASSOCIATION_TIMES)
    return aligned.select("p_brand", "time", F.round(F.col("exposure") / 1e9, 4).alias("exposure"))
