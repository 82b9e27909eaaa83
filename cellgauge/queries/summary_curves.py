"""Histograms, densities and reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.operators import priors, summaries
from cellgauge.queries.calibration import WIDE, vectors
from cellgauge.queries.registry import CELLS, WELL, cells, query, rounded, table


@query(
    "density_histogram",
    f"""
WITH {CELLS}, v AS (SELECT time, repeat, quenched, signal_cy5 / 25000 AS v FROM cells),
b AS (SELECT time, repeat, quenched, least(floor(v / (3.0::DOUBLE / 20)), 19)::INTEGER AS bin FROM v WHERE v BETWEEN 0 AND 3),
c AS (SELECT time, repeat, quenched, bin, count(*) AS count FROM b GROUP BY ALL)
SELECT time, repeat, quenched, bin, round(bin * 0.15::DOUBLE, 6) AS left, count,
  round(count / (0.15::DOUBLE * sum(count) OVER (PARTITION BY time, repeat, quenched)), 8) AS density FROM c
""",
)
def density_histogram(spark, sf):
    scaled = cells(spark, sf).withColumn("v", F.col("signal_cy5") / 25000)
    out = summaries.density_histogram(scaled, WELL, "v", *summaries.SIGNAL_BINS)
    return rounded(out, left=6, density=8)


KDE = """q AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi,
  0.9::DOUBLE * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34::DOUBLE)
    * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS h FROM events GROUP BY event_type),
curve AS (SELECT event_type, i AS point, i * (300.0::DOUBLE / 99) AS x,
  sum(exp(-0.5 * pow((i * (300.0::DOUBLE / 99) - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
  FROM events JOIN q USING (event_type), range(0, 100) t(i) GROUP BY ALL)"""


def event_curve(spark, sf):
    return summaries.kde_curve(table(spark, sf, "events"), ["event_type"], "value", 0.0, 300.0, 100)


@query(
    "kde_curve",
    f"WITH {KDE} SELECT event_type, point::INTEGER AS point, round(x, 6) AS x, round(density, 8) AS density FROM curve",
)
def kde_curve(spark, sf):
    return rounded(event_curve(spark, sf), x=6, density=8)


@query(
    "curve_peak",
    f"WITH {KDE} SELECT event_type, round(max(density), 8) AS peak, round(arg_max(x, density), 6) AS x FROM curve GROUP BY 1",
)
def curve_peak(spark, sf):
    return rounded(summaries.curve_peak(event_curve(spark, sf), ["event_type"]), peak=8, x=6)


BY_HAND = """least(greatest(floor(v / 50.0::DOUBLE), 0), 19)::INTEGER"""


@query(
    "association_histogram",
    f"""
WITH v AS (SELECT event_type, value * 2.2::DOUBLE AS v FROM events), b AS (SELECT event_type, {BY_HAND} AS bin FROM v WHERE v BETWEEN 0 AND 1000),
c AS (SELECT event_type, bin, count(*) AS count FROM b GROUP BY ALL)
SELECT event_type, bin, round(bin * 50.0::DOUBLE, 6) AS left, count,
  round(count / (50.0::DOUBLE * sum(count) OVER (PARTITION BY event_type)), 10) AS density FROM c
""",
)
def association_histogram(spark, sf):
    """A18 with the bins of the association model."""
    scaled = table(spark, sf, "events").withColumn("v", F.col("value") * 2.2)
    return rounded(summaries.density_histogram(scaled, ["event_type"], "v", *summaries.ASSOCIATION_BINS), left=6, density=10)


@query(
    "bandwidths",
    f"WITH {KDE} SELECT event_type, n AS m, lo AS low, hi AS high, round(h, 8) AS h FROM q",
)
def bandwidths(spark, sf):
    return rounded(summaries.bandwidths(table(spark, sf, "events"), ["event_type"], "value"), h=8)


@query(
    "mixture_lognormal",
    """
WITH p AS (SELECT p_brand, 1 + p_size / 10.0::DOUBLE AS m, p_retailprice / 2000 AS sd FROM part),
l AS (SELECT p_brand, sqrt(ln(1 + pow(sd / m, 2))) AS s, ln(m) - ln(1 + pow(sd / m, 2)) / 2 AS mu FROM p),
x AS (SELECT l.*, i, i * (30.0::DOUBLE / 99) AS x FROM l, range(0, 100) t(i))
SELECT p_brand, i::INTEGER AS point, round(x, 6) AS x,
  round(avg(CASE WHEN x > 0 THEN exp(-0.5 * pow((ln(x) - mu) / s, 2)) / (x * s * sqrt(2 * pi())) ELSE 0 END), 8) AS density
FROM x GROUP BY ALL
""",
)
def mixture_lognormal(spark, sf):
    part = table(spark, sf, "part").select(
        "p_brand", (1 + F.col("p_size") / 10.0).alias("m"), (F.col("p_retailprice") / 2000).alias("sd")
    )
    out = summaries.mixture_curve(part, ["p_brand"], summaries.lognormal_of("m", "sd"), 0.0, 30.0, 100)
    return rounded(out, x=6, density=8)


@query(
    "mixture_gamma",
    """
WITH p AS (SELECT p_brand, 0.05::DOUBLE + p_size / 500.0::DOUBLE AS m, p_retailprice / 50000 AS sd,
  (p_partkey % 5 + 1) / 4.0::DOUBLE * (CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END) AS w FROM part),
g AS (SELECT *, 4 / (w * w) AS k, i, i * (0.3::DOUBLE / 99) AS x FROM p, range(0, 100) t(i)),
z AS (SELECT *, k + sign(w) * (x - m) / sd * sqrt(k) AS g FROM g)
SELECT p_brand, i::INTEGER AS point, round(x, 6) AS x,
  round(avg(CASE WHEN g > 0 THEN exp((k - 1) * ln(g) - g - lgamma(k)) * sqrt(k) / sd ELSE 0 END), 6) AS density
FROM z GROUP BY ALL
""",
)
def mixture_gamma(spark, sf):
    side = F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1)
    part = table(spark, sf, "part").select(
        "p_brand", (0.05 + F.col("p_size") / 500.0).alias("m"), (F.col("p_retailprice") / 50000).alias("sd"),
        ((F.col("p_partkey") % 5 + 1) / 4.0 * side).alias("w"),
    )
    out = summaries.mixture_curve(part, ["p_brand"], summaries.gamma_of("m", "sd", "w"), 0.0, 0.3, 100)
    return rounded(out, x=6, density=6)


@query(
    "recovery_report",
    """
WITH u AS (SELECT 'e' || i::VARCHAR AS param, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i)),
q AS (SELECT param, count(*) AS n, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.975) AS upper FROM u GROUP BY param),
t AS (SELECT 'e' || i::VARCHAR AS param, embedding[i]::DOUBLE AS truth FROM embeddings, range(1, 65) t(i) WHERE vec_id = 0)
SELECT param, NULL::INTEGER AS well, n, round(lower, 8) AS lower, round(median, 8) AS median, round(upper, 8) AS upper,
  round(truth, 8) AS truth, truth >= lower AND truth <= upper AS covered FROM q JOIN t USING (param)
""",
)
def recovery_report(spark, sf):
    long = priors.unpack_theta(vectors(spark, sf), WIDE)
    truth = long.filter("particle_id = 0").select("param", "well", "value")
    out = summaries.recovery_report(long.select("param", "well", "value"), truth)
    return rounded(out, lower=8, median=8, upper=8, truth=8)
