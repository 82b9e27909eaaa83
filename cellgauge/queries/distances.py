"""Empirical distributions and distances over the driver tables.

Candidates are suppliers; a supplier's rows are its predicted cells, and the whole
table is the observed population.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.operators import cells as cell_ops
from cellgauge.operators import discrepancy as disc
from cellgauge.operators import ecdf, paired
from cellgauge.plans.scale import settle
from cellgauge.queries.registry import CELL_ORDER, CELLS, CHANNELS, WELL, cells, query, rounded, table


@query(
    "sample_range",
    f"""WITH {CELLS} SELECT time, repeat, quenched, min(signal_cy5) AS lo, max(signal_cy5) AS hi, count(*) AS n
FROM cells GROUP BY ALL""",
)
def sample_range(spark, sf):
    return ecdf.sample_range(cells(spark, sf), WELL, "signal_cy5")


def grid_sql(source: str, keys: str, value: str, name: str = "g") -> str:
    """Knots by direct counting of the values strictly below each of them."""
    return f"""{name}_r AS (SELECT {keys}, min({value}) AS lo, (max({value}) + 0.001::DOUBLE - min({value})) / 999 AS step,
  count(*) AS n FROM {source} GROUP BY {keys}),
{name}_k AS (SELECT {name}_r.*, k, lo + k * step AS x FROM {name}_r, range(0, 1000) t(k)),
{name}_v AS (SELECT {keys}, {value} AS v, count(*) AS c FROM {source} GROUP BY {keys}, {value}),
{name}_c AS (SELECT {keys}, v, sum(c) OVER (PARTITION BY {keys} ORDER BY v) AS upto FROM {name}_v),
{name} AS (SELECT {', '.join(f'{name}_k.{k.strip()}' for k in keys.split(','))}, lo, step, n, k, x,
  coalesce(upto, 0)::DOUBLE / n AS p
  FROM {name}_k ASOF LEFT JOIN {name}_c ON {' AND '.join(f'{name}_k.{k.strip()} = {name}_c.{k.strip()}' for k in keys.split(','))} AND {name}_k.x > {name}_c.v)"""


def placed_sql(source: str, keys: str, value: str, extra: str, grid: str, name: str) -> str:
    """Distribution value of every row by interpolation between the two knots around it."""
    on = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    return f"""{name}_a AS (SELECT s.{', s.'.join(k.strip() for k in keys.split(','))}, {extra}, s.{value} AS v,
    least(greatest(floor((s.{value} - r.lo) / r.step), 0), 998)::BIGINT AS k, r.lo, r.step
  FROM {source} s JOIN {grid}_r r ON {on('s', 'r')}),
{name} AS (SELECT a.* EXCLUDE (k, lo, step), b.p + least(greatest((v - b.x) / b.step, 0), 1) * (c.p - b.p) AS f
  FROM {name}_a a JOIN {grid} b ON {on('a', 'b')} AND b.k = a.k
  JOIN {grid} c ON {on('a', 'c')} AND c.k = a.k + 1)"""


def ad_sql(placed: str, groups: str, name: str) -> str:
    """The statistic with the reversed pairing written out as a self-join."""
    return f"""{name}_o AS (SELECT {groups}, least(greatest(f, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS f,
    row_number() OVER (PARTITION BY {groups} ORDER BY f) AS i, count(*) OVER (PARTITION BY {groups}) AS n FROM {placed}),
{name} AS (SELECT {groups}, max(a.n) AS n,
    sqrt(-max(a.n) - sum((2 * a.i - 1) / a.n::DOUBLE * (ln(a.f) + ln(1 - b.f)))) AS ad
  FROM {name}_o a JOIN (SELECT {groups}, n + 1 - i AS i, f FROM {name}_o) b USING ({groups}, i) GROUP BY {groups})"""


@query(
    "ecdf_grid",
    f"WITH {CELLS}, {grid_sql('cells', 'time, repeat, quenched', 'signal_cy5')} "
    "SELECT time, repeat, quenched, k::INTEGER AS k, round(x, 5) AS x, round(p, 9) AS p FROM g",
)
def ecdf_grid(spark, sf):
    grid = ecdf.ecdf_grid(cells(spark, sf), WELL, "signal_cy5")
    return rounded(ecdf.grid_long(grid, WELL), x=5, p=9)


@query(
    "ecdf_lookup",
    f"""WITH {CELLS}, {grid_sql('cells', 'repeat', 'signal_cy5')},
{placed_sql('cells', 'repeat', 'signal_cy5', 's.l_orderkey, s.l_linenumber', 'g', 'f')}
SELECT repeat, l_orderkey, l_linenumber, v AS signal_cy5, round(f, 8) AS f FROM f""",
)
def ecdf_lookup(spark, sf):
    df = cells(spark, sf).select("repeat", "l_orderkey", "l_linenumber", "signal_cy5")
    grid = settle(ecdf.ecdf_grid(df, ["repeat"], "signal_cy5"))
    return rounded(ecdf.ecdf_lookup(df, grid, ["repeat"], "signal_cy5"), f=8)


@query(
    "order_index",
    f"""WITH {CELLS}, o AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY signal_cy5, {', '.join(CELL_ORDER)}) AS i,
  count(*) OVER (PARTITION BY repeat) AS n FROM cells)
SELECT repeat, l_orderkey, l_linenumber, signal_cy5, i, n, n + 1 - i AS mirror FROM o""",
)
def order_index(spark, sf):
    numbered = ecdf.order_index(cells(spark, sf), ["repeat"], ["signal_cy5", *CELL_ORDER])
    return numbered.select("repeat", "l_orderkey", "l_linenumber", "signal_cy5", "i", "n", "mirror")


@query(
    "ad_distance",
    f"""WITH {CELLS}, {grid_sql('cells', 'repeat', 'signal_cy5')},
{placed_sql('cells', 'repeat', 'signal_cy5', 's.l_suppkey', 'g', 'f')}, {ad_sql('f', 'l_suppkey, repeat', 'd')}
SELECT l_suppkey, repeat, n, round(ad, 6) AS ad FROM d""",
)
def ad_distance(spark, sf):
    df = cells(spark, sf)
    grid = settle(ecdf.ecdf_grid(df, ["repeat"], "signal_cy5"))
    out = ecdf.anderson_darling(df, grid, ["repeat"], ["l_suppkey"], "signal_cy5")
    return rounded(out, ad=6)


@query(
    "channel_correlation",
    f"WITH {CELLS} SELECT time, repeat, quenched, round(corr(signal_cy5, signal_bdp), 8) AS r FROM cells GROUP BY ALL",
)
def channel_correlation(spark, sf):
    return rounded(disc.channel_correlation(cells(spark, sf), WELL, *CHANNELS), r=8)


@query(
    "pair_samples",
    f"""WITH {CELLS}, o AS (SELECT repeat, quenched, corr(signal_cy5, signal_bdp) AS r_obs FROM cells GROUP BY ALL),
s AS (SELECT l_suppkey, repeat, quenched, corr(signal_cy5, signal_bdp) AS r FROM cells GROUP BY ALL)
SELECT l_suppkey, repeat, quenched, round(r, 7) AS r, round(r_obs, 7) AS r_obs FROM s JOIN o USING (repeat, quenched)""",
)
def pair_samples(spark, sf):
    df = cells(spark, sf)
    keys = ["repeat", "quenched"]
    observed = settle(disc.channel_correlation(df, keys, *CHANNELS).withColumnRenamed("r", "r_obs"))
    predicted = disc.channel_correlation(df, ["l_suppkey", *keys], *CHANNELS)
    return rounded(disc.pair_samples(predicted, observed, keys), r=7, r_obs=7)


ONE_CHANNEL = "d AS (SELECT l_suppkey, sum(ad) AS s, count(*) AS m FROM a GROUP BY l_suppkey)"


def reason_sql(samples: str) -> str:
    return f"CASE WHEN m = {samples} THEN round(s, 6) END AS rho, CASE WHEN m < {samples} THEN 'missing sample' END AS reason"


def one_channel_sql(keys: str) -> str:
    return f"""WITH {CELLS}, {grid_sql('cells', keys, 'signal_cy5')},
{placed_sql('cells', keys, 'signal_cy5', 's.l_suppkey', 'g', 'f')}, {ad_sql('f', 'l_suppkey, ' + keys, 'a')}, {ONE_CHANNEL}
SELECT l_suppkey, {reason_sql('(SELECT count(*) FROM g_r)')} FROM d"""


@query("discrepancy_hier_1ch", one_channel_sql("quenched, repeat"))
def discrepancy_hier_1ch(spark, sf):
    df = cells(spark, sf)
    out = disc.discrepancy_hier(df, df, ["quenched", "repeat"], ["signal_cy5"], ["l_suppkey"])
    return rounded(out, rho=6)


@query("discrepancy_pooled_1ch", one_channel_sql("quenched"))
def discrepancy_pooled_1ch(spark, sf):
    df = cells(spark, sf)
    out = disc.discrepancy_pooled(
        cell_ops.pool_replicates(df, "repeat"), df, ["quenched", "repeat"], ["signal_cy5"], ["l_suppkey"],
        replicate="repeat",
    )
    return rounded(out, rho=6)


def two_channel_sql(keys: str) -> str:
    return f"""WITH {CELLS},
{grid_sql('cells', keys, 'signal_cy5', 'g')}, {placed_sql('cells', keys, 'signal_cy5', 's.l_suppkey', 'g', 'f')},
{ad_sql('f', 'l_suppkey, ' + keys, 'a')},
{grid_sql('cells', keys, 'signal_bdp', 'h')}, {placed_sql('cells', keys, 'signal_bdp', 's.l_suppkey', 'h', 'e')},
{ad_sql('e', 'l_suppkey, ' + keys, 'b')},
o AS (SELECT {keys}, corr(signal_cy5, signal_bdp) AS r_obs FROM cells GROUP BY ALL),
q AS (SELECT l_suppkey, {keys}, corr(signal_cy5, signal_bdp) AS r FROM cells GROUP BY ALL),
t AS (SELECT l_suppkey, a.ad + 0.5::DOUBLE * b.ad + 0.5::DOUBLE * abs(r_obs - r) AS term
  FROM a JOIN b USING (l_suppkey, {keys}) JOIN q USING (l_suppkey, {keys}) JOIN o USING ({keys})),
d AS (SELECT l_suppkey, sum(term) AS s, count(*) AS m FROM t GROUP BY l_suppkey)
SELECT l_suppkey, {reason_sql('(SELECT count(*) FROM g_r)')} FROM d"""


@query("discrepancy_hier_2ch", two_channel_sql("quenched, repeat"))
def discrepancy_hier_2ch(spark, sf):
    df = cells(spark, sf)
    out = disc.discrepancy_hier(df, df, ["quenched", "repeat"], CHANNELS, ["l_suppkey"])
    return rounded(out, rho=6)


@query("discrepancy_pooled_2ch", two_channel_sql("quenched"))
def discrepancy_pooled_2ch(spark, sf):
    df = cells(spark, sf)
    out = disc.discrepancy_pooled(
        cell_ops.pool_replicates(df, "repeat"), df, ["quenched", "repeat"], CHANNELS, ["l_suppkey"],
        replicate="repeat",
    )
    return rounded(out, rho=6)


@query(
    "custom_metric",
    f"""WITH {CELLS}, {grid_sql('cells', 'repeat', 'signal_cy5')},
{placed_sql('cells', 'repeat', 'signal_cy5', 's.l_suppkey', 'g', 'f')},
d AS (SELECT l_suppkey, repeat, abs(avg(f) - 0.5) AS gap FROM f GROUP BY ALL)
SELECT l_suppkey, CASE WHEN count(*) = 3 THEN round(sum(gap), 7) END AS rho,
  CASE WHEN count(*) < 3 THEN 'missing sample' END AS reason FROM d GROUP BY l_suppkey""",
)
def custom_metric(spark, sf):
    """the distance swapped for the mean distribution value's gap to one half."""

    def mean_gap(df, grid, keys, sample, value, max_rows=None):
        placed = ecdf.ecdf_lookup(df, grid, keys, value)
        return placed.groupBy(*sample, *keys).agg(F.abs(F.avg("f") - 0.5).alias("ad"))

    df = cells(spark, sf)
    observed = disc.observe(df, ["repeat"], ["signal_cy5"])
    out = disc.discrepancy(df, observed, ["l_suppkey"], metric=mean_gap)
    return rounded(out, rho=7)


def pair_sql(part: str, finish: str) -> str:
    """Both samples of a supplier and condition in one order of values, and the gap of their distributions after each."""
    return f"""WITH {CELLS}, o AS (SELECT quenched, signal_cy5 AS x, count(*) AS c FROM cells GROUP BY ALL),
m AS (SELECT quenched, count(*) AS m FROM cells GROUP BY ALL),
k AS (SELECT l_suppkey, quenched, count(*) AS n FROM cells GROUP BY ALL),
b AS (SELECT l_suppkey, quenched, signal_cy5 AS x, 1.0::DOUBLE / n AS d FROM cells JOIN k USING (l_suppkey, quenched)
  UNION ALL SELECT l_suppkey, quenched, x, -c::DOUBLE / m FROM o JOIN k USING (quenched) JOIN m USING (quenched)),
v AS (SELECT l_suppkey, quenched, x, sum(d) AS d FROM b GROUP BY ALL),
g AS (SELECT *, sum(d) OVER w AS gap, lead(x) OVER w - x AS width FROM v WINDOW w AS (PARTITION BY l_suppkey, quenched ORDER BY x)),
t AS (SELECT l_suppkey, quenched, {finish}(sum({part} * coalesce(width, 0))) AS term FROM g GROUP BY ALL)
SELECT l_suppkey, CASE WHEN count(*) = (SELECT count(*) FROM m) THEN round(sum(term), 4) END AS rho,
  CASE WHEN count(*) < (SELECT count(*) FROM m) THEN 'missing sample' END AS reason FROM t GROUP BY l_suppkey"""


def _paired(spark, sf, metric):
    df = cells(spark, sf)
    return rounded(disc.discrepancy(df, disc.observe(df, ["quenched"], ["signal_cy5"]), ["l_suppkey"], metric=metric), rho=4)


@query("earth_movers_distance", pair_sql("abs(gap)", ""))
def earth_movers_distance(spark, sf):
    """suppliers by the work that turns their cells into the observed ones."""
    return _paired(spark, sf, paired.EARTH_MOVERS)


@query("energy_distance", pair_sql("2 * gap * gap", "sqrt"))
def energy_distance(spark, sf):
    """suppliers by the energy distance of their cells to the observed ones."""
    return _paired(spark, sf, paired.ENERGY)
