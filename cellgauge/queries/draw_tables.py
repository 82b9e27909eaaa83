"""Keyed draws, priors and densities with the driver tables as keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.functions import densities, draws
from cellgauge.operators import particles as parts
from cellgauge.operators import priors
from cellgauge.plans.scale import scratch_path
from cellgauge.queries.registry import (
    query,
    rounded,
    sql_gamma,
    sql_lognormal,
    sql_normal,
    sql_pool_index,
    sql_truncated,
    sql_uniform,
    table,
)


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


def drawn(spark, sf, column, places=7):
    return orders(spark, sf).select("o_orderkey", F.round(column, places).alias("x"))


@query("uniform_draws", f"SELECT o_orderkey, round(2 + 3 * {sql_uniform(1, 'u', 'o_orderkey')}, 7) AS x FROM orders")
def uniform_draws(spark, sf):
    return drawn(spark, sf, draws.uniform(1, "u", ["o_orderkey"], 2.0, 5.0))


@query("normal_draws", f"SELECT o_orderkey, round(10 + 4 * {sql_normal(1, 'z', 'o_orderkey')}, 7) AS x FROM orders")
def normal_draws(spark, sf):
    return drawn(spark, sf, draws.normal(1, "z", ["o_orderkey"], 10.0, 4.0))


TRUNCATED_MEAN = "o_totalprice / 100000.0::DOUBLE - 1"


@query(
    "truncated_draws",
    f"""WITH o AS (SELECT o_orderkey, greatest({TRUNCATED_MEAN}, 0) AS m, (o_orderkey % 3)::DOUBLE AS s FROM orders)
SELECT o_orderkey, round({sql_truncated(1, 't', 'm', 's', 'o_orderkey')}, 7) AS x FROM o""",
)
def truncated_draws(spark, sf):
    mean = F.greatest(F.col("o_totalprice") / 100000.0 - 1, F.lit(0.0))
    sd = (F.col("o_orderkey") % 3).cast("double")
    return drawn(spark, sf, draws.truncated_normal(1, "t", ["o_orderkey"], mean, sd))


@query(
    "half_cauchy_draws",
    f"SELECT o_orderkey, round(0.25::DOUBLE * tan(pi() / 2 * ({sql_uniform(1, 'c', 'o_orderkey')})), 6) AS x FROM orders",
)
def half_cauchy_draws(spark, sf):
    return drawn(spark, sf, draws.half_cauchy(1, "c", ["o_orderkey"], 0.25), 6)


@query(
    "lognormal_draws",
    f"""WITH o AS (SELECT o_orderkey, 1 + o_totalprice / 100000 AS m FROM orders)
SELECT o_orderkey, round({sql_lognormal(1, 'l', 'm', '0.5::DOUBLE', 'o_orderkey')}, 7) AS x FROM o""",
)
def lognormal_draws(spark, sf):
    mean = 1 + F.col("o_totalprice") / 100000
    return drawn(spark, sf, draws.lognormal_by_moments(1, "l", ["o_orderkey"], mean, 0.5))


@query(
    "lognormal_scale_draws",
    f"SELECT o_orderkey, round(1.0 * {sql_lognormal(1, 'w', '0.05::DOUBLE', '0.25::DOUBLE', 'o_orderkey')}, 7) AS x FROM orders",
)
def lognormal_scale_draws(spark, sf):
    return drawn(spark, sf, draws.lognormal_with_scale(1, "w", ["o_orderkey"], 1.0, 0.05, 0.25))


@query(
    "gamma_draws",
    f"""WITH o AS (SELECT o_orderkey, 1 + o_totalprice / 100000 AS m, (o_orderkey % 4 + 1) / 2.5::DOUBLE AS w,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS g FROM orders)
SELECT o_orderkey, round({sql_gamma(1, 'g', 'm', '0.3::DOUBLE', '(w * g)', 'o_orderkey')}, 7) AS x FROM o""",
)
def gamma_draws(spark, sf):
    mean = 1 + F.col("o_totalprice") / 100000
    side = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    skew = (F.col("o_orderkey") % 4 + 1) / 2.5 * side
    return drawn(spark, sf, draws.gamma_by_moments(1, "g", ["o_orderkey"], mean, 0.3, skew))


@query(
    "draw_with_replacement",
    f"SELECT o_orderkey, {sql_pool_index(1, 'i', '(SELECT count(*) FROM supplier)', 'o_orderkey')} AS idx FROM orders",
)
def draw_with_replacement(spark, sf):
    size = table(spark, sf, "supplier").count()
    return orders(spark, sf).select("o_orderkey", draws.pool_index(1, "i", ["o_orderkey"], size * 1.0).alias("idx"))


@query(
    "log_density",
    """SELECT o_orderkey,
  round(CASE WHEN o_totalprice / 1000 BETWEEN 50 AND 300 THEN -ln(250.0::DOUBLE) END, 7) AS uniform,
  round(-0.5 * pow((o_totalprice / 1000 - 200) / 40, 2) - ln(40.0::DOUBLE) - 0.5 * ln(2 * pi()), 7) AS normal,
  round(ln(2 / (pi() * 30 * (1 + pow(o_totalprice / 30000, 2)))), 7) AS half_cauchy FROM orders""",
)
def log_density(spark, sf):
    x = F.col("o_totalprice") / 1000
    bounded = densities.log_density("uniform", x, 50, 300)
    return orders(spark, sf).select(
        "o_orderkey",
        F.round(F.when(bounded > float("-inf"), bounded), 7).alias("uniform"),
        F.round(densities.log_density("normal", x, 200, 40), 7).alias("normal"),
        F.round(densities.log_density("half_cauchy", x, 0, 30), 7).alias("half_cauchy"),
    )


# --- priors ---------------------------------------------------------------


def sql_prior(layout: priors.Layout, source: str, key: str, seed: int) -> str:
    """CTEs ``sh`` (shared block) and ``th`` (all entries, named) for every key."""
    shared = []
    for p in layout.shared:
        u = sql_uniform(seed, p.name, key)
        if p.dist == "uniform":
            shared.append(f"{p.a!r}::DOUBLE + {p.b - p.a!r}::DOUBLE * ({u}) AS {p.name}")
        else:
            shared.append(f"{p.b!r}::DOUBLE * tan(pi() / 2 * ({u})) AS {p.name}")
    wells = [
        f"{sql_truncated(seed, g.name, g.mean, g.spread, key, str(w))} AS {g.name}_{w}"
        for g in layout.groups
        for w in range(1, layout.wells + 1)
    ]
    return f"sh AS (SELECT {key}, {', '.join(shared)} FROM {source}), th AS (SELECT *, {', '.join(wells) or '1 AS one'} FROM sh)"


def sql_log_prior(layout: priors.Layout) -> str:
    terms = []
    for p in layout.shared:
        if p.dist == "uniform":
            terms.append(f"(-ln({p.b - p.a!r}::DOUBLE))")
        else:
            terms.append(f"ln(2 / (pi() * {p.b!r}::DOUBLE * (1 + pow({p.name} / {p.b!r}::DOUBLE, 2))))")
    for g in layout.groups:
        for w in range(1, layout.wells + 1):
            z = f"(({g.name}_{w} - {g.mean}) / {g.spread})"
            terms.append(f"(-0.5 * pow({z}, 2) - ln({g.spread}) - 0.5 * ln(2 * pi()))")
    return " + ".join(terms)


ASSOC = priors.association_hierarchical("corrupted", 3)
INTERN = priors.internalisation_hierarchical(3)


def customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey"))


SCALED = ", ".join(
    f"round({n}{' * 1e7' if '_r' in n else ''}, 5) AS {n}" for n in ASSOC.names
)


@query("prior_table", f"WITH {sql_prior(ASSOC, 'customer', 'c_custkey', 9)} SELECT c_custkey, {SCALED} FROM th")
def prior_table(spark, sf):
    table_ = priors.draw_prior(customers(spark, sf), ASSOC, 9, key="c_custkey")
    named = priors.slice_params(table_, ASSOC)
    scaled = [F.round(F.col(n) * (1e7 if "_r" in n else 1), 5).alias(n) for n in ASSOC.names]
    return named.select("c_custkey", *scaled)


@query(
    "log_prior",
    f"""WITH {sql_prior(INTERN, 'customer', 'c_custkey', 9)}
SELECT c_custkey, round({sql_log_prior(INTERN)}, 4) AS log_prior FROM th""",
)
def log_prior(spark, sf):
    drawn_table = priors.draw_prior(customers(spark, sf), INTERN, 9, key="c_custkey")
    out = drawn_table.select("c_custkey", priors.log_prior(INTERN).alias("log_prior"))
    return rounded(out, log_prior=4)


def stored_prior(spark, layout):
    """The prior as a file that is read like any other table."""
    folder = scratch_path(spark, "prior")
    priors.prior_rows(spark, layout).coalesce(1).write.csv(folder, header=True)
    return spark.read.schema(priors.PRIOR_SCHEMA).csv(folder, header=True)


@query("prior_from_table", f"WITH {sql_prior(ASSOC, 'customer', 'c_custkey', 9)} SELECT c_custkey, {SCALED} FROM th")
def prior_from_table(spark, sf):
    """The sampler of every entry is chosen by a row of a file."""
    table_ = priors.draw_prior_rows(customers(spark, sf), stored_prior(spark, ASSOC), 9, key="c_custkey")
    named = priors.slice_params(table_, ASSOC)
    return named.select("c_custkey", *[F.round(F.col(n) * (1e7 if "_r" in n else 1), 5).alias(n) for n in ASSOC.names])


@query(
    "log_prior_from_table",
    f"""WITH {sql_prior(INTERN, 'customer', 'c_custkey', 9)}
SELECT c_custkey, round({sql_log_prior(INTERN)}, 4) AS log_prior FROM th""",
)
def log_prior_from_table(spark, sf):
    """The density of every entry is chosen by a row of a file."""
    drawn_table = priors.draw_prior(customers(spark, sf), INTERN, 9, key="c_custkey")
    out = priors.log_prior_rows(drawn_table, stored_prior(spark, INTERN), ["c_custkey"])
    return rounded(out, log_prior=4)


PAIR = priors.Layout(
    shared=(priors.Param("x", "uniform", 0.0, 8000.0), priors.Param("s", "half_cauchy", 0.0, 10.0)), nonnegative=("s",)
)


def pair_particles(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("particle_id"),
        F.array("c_acctbal", (F.col("c_nationkey") - 3).cast("double")).alias("theta"),
        F.round("c_acctbal", 0).alias("rho"),
    )


@query(
    "support_guard",
    """SELECT c_custkey AS particle_id, c_nationkey - 3 >= 0 AS inside,
  CASE WHEN c_nationkey - 3 >= 0 AND c_acctbal BETWEEN 0 AND 8000
    THEN round(-ln(8000.0::DOUBLE) + ln(2 / (pi() * 10 * (1 + pow((c_nationkey - 3) / 10.0::DOUBLE, 2)))), 7) END AS log_prior
FROM customer""",
)
def support_guard(spark, sf):
    density = priors.log_prior(PAIR)
    return pair_particles(spark, sf).select(
        "particle_id",
        priors.support_guard(PAIR).alias("inside"),
        F.round(F.when(density > float("-inf"), density), 7).alias("log_prior"),
    )


FACTOR = [[300.0, 0.0], [-1.5, 2.0]]

PROPOSAL = f"""prop AS (SELECT c_custkey AS particle_id, c_acctbal AS x0, c_nationkey - 3 AS s0,
  c_acctbal + 300 * {sql_normal(2, 'step', 'c_custkey', '1')} AS x1,
  c_nationkey - 3 - 1.5 * {sql_normal(2, 'step', 'c_custkey', '1')} + 2 * {sql_normal(2, 'step', 'c_custkey', '2')} AS s1
  FROM customer)"""


def proposals(spark, sf):
    import numpy as np

    return parts.propose(pair_particles(spark, sf), np.array(FACTOR), 2, "step")


@query("propose", f"WITH {PROPOSAL} SELECT particle_id, round(x1, 6) AS x, round(s1, 6) AS s FROM prop")
def propose(spark, sf):
    p = F.col("proposal")
    return proposals(spark, sf).select("particle_id", F.round(p[0], 6).alias("x"), F.round(p[1], 6).alias("s"))


def _pair_density(x: str, s: str) -> str:
    return (
        f"CASE WHEN {s} >= 0 AND {x} BETWEEN 0 AND 8000 "
        f"THEN -ln(8000.0::DOUBLE) + ln(2 / (pi() * 10 * (1 + pow({s} / 10.0::DOUBLE, 2)))) END"
    )


@query(
    "mh_filter",
    f"""WITH {PROPOSAL}, d AS (SELECT *, {_pair_density('x1', 's1')} AS new, {_pair_density('x0', 's0')} AS old FROM prop)
SELECT particle_id, round(x1, 6) AS x, round(s1, 6) AS s FROM d
WHERE new IS NOT NULL AND (old IS NULL OR ln({sql_uniform(2, 'accept', 'particle_id')}) <= least(0, new - old))""",
)
def mh_filter(spark, sf):
    passed = parts.mh_filter(
        proposals(spark, sf), priors.log_prior(PAIR, "proposal"), priors.log_prior(PAIR, "theta"), 2, "accept"
    )
    p = F.col("proposal")
    return passed.select("particle_id", F.round(p[0], 6).alias("x"), F.round(p[1], 6).alias("s"))
