"""Parameter layouts, prior tables and prior densities.

A particle is one row: ``particle_id`` and ``theta``, an array with the well block
(one mean per group and well) followed by the shared block. Everything about one
particle is computed inside its row, so densities and guards need no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.functions import densities, draws
from cellgauge.plans.scale import match, spread


@dataclass(frozen=True)
class Param:
    """A shared parameter; ``a`` and ``b`` are bounds, or 0 and the half-Cauchy scale."""

    name: str
    dist: str
    a: float
    b: float


@dataclass(frozen=True)
class Group:
    """A per-well mean drawn around a shared mean with a shared spread."""

    name: str
    mean: str
    spread: str


@dataclass(frozen=True)
class Layout:
    """Names and priors of all entries of ``theta``."""

    shared: tuple[Param, ...]
    groups: tuple[Group, ...] = ()
    wells: int = 0
    nonnegative: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        block = [f"{g.name}_{w}" for g in self.groups for w in range(1, self.wells + 1)]
        return block + [p.name for p in self.shared]

    def at(self, name: str, theta: str = "theta") -> Column:
        return F.element_at(theta, self.names.index(name) + 1)

    def well_at(self, group: str, well: Column, theta: str = "theta") -> Column:
        """The group's mean of the well numbered in a column."""
        start = self.names.index(f"{group}_1")
        return F.element_at(theta, (well + start).cast("int"))


# Priors of the two models, pooled and with wells.

INTERNALISATION_POOLED = Layout(
    shared=(
        Param("sigma_lambda", "uniform", 0.0, 0.3),
        Param("sigma_beta", "uniform", 0.0, 0.1),
        Param("sigma_R", "uniform", 0.0, 1.0),
        Param("mu_lambda", "uniform", 0.0, 0.5),
        Param("mu_beta", "uniform", 0.0, 0.2),
        Param("mu_R", "uniform", 0.0, 1.0),
        Param("sigma_1", "uniform", 0.0, 10.0),
        Param("sigma_2", "uniform", 0.0, 3.0),
        Param("alpha_1", "uniform", 5000.0, 12000.0),
        Param("alpha_2", "uniform", 20.0, 80.0),
        Param("p", "uniform", 0.0, 0.15),
        Param("omega_lambda", "uniform", -2.0, 1.0),
        Param("omega_beta", "uniform", -2.0, 1.0),
    ),
    nonnegative=("sigma_lambda", "sigma_beta", "sigma_R", "sigma_1", "sigma_2"),
)


def internalisation_hierarchical(wells: int) -> Layout:
    return Layout(
        shared=(
            Param("sigma_lambda", "uniform", 0.0, 0.3),
            Param("sigma_beta", "uniform", 0.0, 0.1),
            Param("sigma_R", "uniform", 0.0, 1.0),
            Param("m_lambda", "uniform", 0.06, 0.2),
            Param("m_beta", "uniform", 0.03, 0.1),
            Param("m_R", "uniform", 0.0, 1.0),
            Param("s_lambda", "half_cauchy", 0.0, 0.01),
            Param("s_beta", "half_cauchy", 0.0, 0.008),
            Param("s_R", "half_cauchy", 0.0, 0.27),
            Param("sigma_1", "uniform", 0.0, 10.0),
            Param("sigma_2", "uniform", 0.0, 3.0),
            Param("alpha_1", "uniform", 7000.0, 10000.0),
            Param("alpha_2", "uniform", 30.0, 45.0),
            Param("p", "uniform", 0.0, 0.1),
            Param("omega_lambda", "uniform", -2.0, 1.0),
            Param("omega_beta", "uniform", -2.0, 1.0),
        ),
        groups=(
            Group("mu_lambda", "m_lambda", "s_lambda"),
            Group("mu_beta", "m_beta", "s_beta"),
            Group("mu_R", "m_R", "s_R"),
        ),
        wells=wells,
        nonnegative=(
            "sigma_lambda", "sigma_beta", "sigma_R", "s_lambda", "s_beta", "s_R", "sigma_1", "sigma_2",
        ),
    )


def association_pooled(scenario: str) -> Layout:
    sigma_r, sigma_k = {
        "uncorrupted": (1e-6, 5.0),
        "corrupted": (2e-6, 5.0),
        "corrupted2": (1e-6, 10.0),
    }[scenario]
    return Layout(
        shared=(
            Param("sigma_r", "uniform", 0.0, sigma_r),
            Param("sigma_K", "uniform", 0.0, sigma_k),
            Param("mu_r", "uniform", 0.0, 1e-6),
            Param("mu_K", "uniform", 0.0, 50.0),
        ),
        nonnegative=("sigma_r", "sigma_K"),
    )


def association_hierarchical(scenario: str, wells: int) -> Layout:
    sigma_r, spread_k = {
        "uncorrupted": (1e-6, 0.5),
        "corrupted": (1e-6, 5.0),
        "corrupted2": (2e-6, 5.0),
    }[scenario]
    return Layout(
        shared=(
            Param("sigma_r", "uniform", 0.0, sigma_r),
            Param("sigma_K", "uniform", 0.0, 5.0),
            Param("m_r", "uniform", 0.0, 1e-6),
            Param("m_K", "uniform", 0.0, 50.0),
            Param("s_r", "half_cauchy", 0.0, 3e-7),
            Param("s_K", "half_cauchy", 0.0, spread_k),
        ),
        groups=(Group("mu_r", "m_r", "s_r"), Group("mu_K", "m_K", "s_K")),
        wells=wells,
        nonnegative=("sigma_r", "sigma_K", "m_r", "m_K", "s_r", "s_K"),
    )


def dimension_table(spark: SparkSession, layout: Layout) -> DataFrame:
    """The parameter dimension: position, param, well (null when shared), dist, a, b."""
    rows = []
    for g in layout.groups:
        for w in range(1, layout.wells + 1):
            rows.append((len(rows) + 1, g.name, w, "truncated_normal", None, None))
    for p in layout.shared:
        rows.append((len(rows) + 1, p.name, None, p.dist, p.a, p.b))
    return spark.createDataFrame(rows, "position int, param string, well int, dist string, a double, b double")


# --- priors held in a table ------------------------------------------------

#: F1 as rows: one for every entry of ``theta``. A ``well_mean`` is normal around two other entries.
PRIOR_SCHEMA = (
    "position int, param string, well int, dist string, a double, b double, mean_at int, spread_at int, nonnegative boolean"
)
SHARED_DISTS = ("uniform", "half_cauchy")
WELL_MEAN = "well_mean"


def prior_rows(spark: SparkSession, layout: Layout) -> DataFrame:
    """A layout as a prior table, to be written, edited and read by anything that knows rows."""
    rows = []
    for g in layout.groups:
        at = [layout.names.index(name) + 1 for name in (g.mean, g.spread)]
        rows += [(len(rows) + w, g.name, w, WELL_MEAN, None, None, *at, True) for w in range(1, layout.wells + 1)]
    for p in layout.shared:
        rows.append((len(rows) + 1, p.name, None, p.dist, p.a, p.b, None, None, p.name in layout.nonnegative))
    return spark.createDataFrame(rows, PRIOR_SCHEMA)


def check_prior(prior: DataFrame) -> int:
    """The length of ``theta``; an error names what a prior table lacks. The table has one row an entry, not a particle."""
    rows = prior.select([c.split()[0] for c in PRIOR_SCHEMA.split(", ")]).collect()
    at = {r["position"]: r for r in rows}
    if sorted(at) != list(range(1, len(rows) + 1)):
        raise ValueError("positions must run from 1 without gaps or repeats")
    for r in rows:
        if r["dist"] == WELL_MEAN:
            around = [at.get(r["mean_at"]), at.get(r["spread_at"])]
            if None in around or any(x["dist"] == WELL_MEAN for x in around):
                raise ValueError(f"entry {r['position']} needs a mean and a spread that are shared entries")
        elif r["dist"] not in SHARED_DISTS or r["b"] is None or (r["dist"] == "uniform" and r["a"] is None):
            raise ValueError(f"entry {r['position']} has no distribution this engine can draw: {r['dist']!r}")
    return len(rows)


def log_prior_rows(
    particles: DataFrame, prior: DataFrame, ids: Sequence[str] = ("particle_id",), *, theta: str = "theta", truncated: bool = False
) -> DataFrame:
    """A17 from a table: ``ids`` and ``log_prior``, one density a row of the prior, added up by particle.

    The prior goes to the particles; the entries of one are rows of one task and are added
    before anything moves. -inf outside the support; null where ``theta`` has another length.
    """
    entries = check_prior(prior)
    # outer, as the filter on empty arrays that goes with the other would evaluate theta twice; its null positions meet nothing
    long = particles.select(*ids, theta, F.posexplode_outer(theta).alias("__at", "__value")).withColumn("position", F.col("__at") + 1)
    rows = match(long, prior, ["position"], "inner", broadcast=True)  # one row an entry
    value, mean, spread = F.col("__value"), F.get(theta, F.col("mean_at") - 1), F.get(theta, F.col("spread_at") - 1)
    around = (densities.truncated_normal_log if truncated else densities.normal_log)(value, mean, spread)
    density = F.when(F.col("dist") == WELL_MEAN, around).otherwise(densities.log_density_by_name(F.col("dist"), value, F.col("a"), F.col("b")))
    inside = ~F.col("nonnegative") | (value >= 0)
    sums = rows.groupBy(*ids).agg(
        F.sum(F.when(inside, density).otherwise(F.lit(0.0))).alias("__sum"), F.bool_and(F.coalesce(inside, F.lit(False))).alias("__inside"),
        F.count(density).alias("__found"), F.max(F.size(theta)).alias("__size"),
    )
    whole = (F.col("__found") == entries) & (F.col("__size") == entries)
    return sums.select(*ids, F.when(whole, F.when(F.col("__inside"), F.col("__sum")).otherwise(densities.MINUS_INFINITY)).alias("log_prior"))


def draw_prior_rows(df: DataFrame, prior: DataFrame, seed: int, *, key: str = "particle_id", method: str = "md5") -> DataFrame:
    """R9 from a table: ``key``, ``theta`` and ``exhausted`` for every row of ``df``, the same numbers as :func:`draw_prior`.

    The sampler of an entry is chosen by its row. Shared entries come first; well means are
    drawn around those of their own particle.
    """
    entries = check_prior(prior)
    slots = spread(df.select(key)).select(key, F.explode(F.sequence(F.lit(1), F.lit(entries))).alias("position"))
    rows = match(slots, prior, ["position"], "inner", broadcast=True)  # one row an entry
    a, b = F.col("a"), F.col("b")
    (u,) = draws.uniforms(seed, F.col("param"), [key], 1, method)
    shared = F.when(F.col("dist") == "uniform", a + (b - a) * u).when(F.col("dist") == "half_cauchy", b * F.tan(math.pi / 2.0 * u))
    drawn = rows.select(key, F.struct("position", "param", "well", "dist", "mean_at", "spread_at", shared.alias("value")).alias("__e"))
    vectors = drawn.groupBy(key).agg(F.array_sort(F.collect_list("__e")).alias("__e"))  # one layout's length a particle
    at = lambda place: F.get("__e", F.col("__x")[place] - 1)["value"]
    long = vectors.select(key, "__e", F.explode("__e").alias("__x"))
    around = draws.truncated_normal(seed, F.col("__x")["param"], [F.col(key), F.col("__x")["well"]], at("mean_at"), at("spread_at"), method)
    value = F.when(F.col("__x")["dist"] == WELL_MEAN, around).otherwise(F.col("__x")["value"])
    filled = long.select(key, F.struct(F.col("__x")["position"].alias("position"), value.alias("value")).alias("__v"))
    packed = filled.groupBy(key).agg(F.array_sort(F.collect_list("__v"))["value"].alias("theta"))
    return packed.withColumn("exhausted", F.exists("theta", lambda x: x.isNull()))


# --- vectors and named columns --------------------------------------------


def slice_params(df: DataFrame, layout: Layout, names: Sequence[str] | None = None) -> DataFrame:
    """Entries of ``theta`` as named columns."""
    names = layout.names if names is None else names
    return df.select("*", *[layout.at(name).alias(name) for name in names])


def pack_theta(df: DataFrame, layout: Layout) -> DataFrame:
    """Named columns back into ``theta``."""
    rest = [c for c in df.columns if c not in layout.names and c != "theta"]
    return df.select(*rest, F.array(*[F.col(n).cast("double") for n in layout.names]).alias("theta"))


def unpack_theta(df: DataFrame, layout: Layout, ids: Sequence[str] = ("particle_id",)) -> DataFrame:
    """One row per particle and entry: position, param, well, value."""
    long = df.select(*ids, F.posexplode("theta").alias("__at", "value")).select(
        *ids, (F.col("__at") + 1).alias("position"), "value"
    )
    names = dimension_table(df.sparkSession, layout).select("position", "param", "well")
    return match(long, names, ["position"], "inner", broadcast=True)


def theta_from_long(df: DataFrame, ids: Sequence[str] = ("particle_id",)) -> DataFrame:
    """Rows of (position, value) back into ``theta``; at most one layout's length per particle."""
    entries = F.array_sort(F.collect_list(F.struct("position", "value")))
    return df.groupBy(*ids).agg(entries.alias("__e")).select(*ids, F.col("__e")["value"].alias("theta"))


# --- densities and draws --------------------------------------------------


def support_guard(layout: Layout, theta: str = "theta") -> Column:
    """True where no spread and no well mean is negative.

    The guard covers the well means of every group.
    """
    names = list(layout.nonnegative)
    names += [f"{g.name}_{w}" for g in layout.groups for w in range(1, layout.wells + 1)]
    inside = F.lit(True)
    for name in names:
        inside = inside & (layout.at(name, theta) >= 0)
    return inside


def log_prior(layout: Layout, theta: str = "theta", *, truncated: bool = False) -> Column:
    """Log prior density of a particle; -inf outside the support.

    Well means are drawn from a normal cut off at 0 but scored, as published, with
    the whole normal; ``truncated=True`` scores the distribution they are drawn from.
    """
    normal_log = densities.truncated_normal_log if truncated else densities.normal_log
    total = F.lit(0.0)
    for p in layout.shared:
        total = total + densities.log_density(p.dist, layout.at(p.name, theta), p.a, p.b)
    for g in layout.groups:
        mean, spread = layout.at(g.mean, theta), layout.at(g.spread, theta)
        for w in range(1, layout.wells + 1):
            total = total + normal_log(layout.at(f"{g.name}_{w}", theta), mean, spread)
    return F.when(support_guard(layout, theta), total).otherwise(F.lit(densities.MINUS_INFINITY))


def draw_prior(df: DataFrame, layout: Layout, seed: int, *, key: str = "particle_id", method: str = "md5", deal: bool = True) -> DataFrame:
    """R9 on any table of keys: ``theta`` drawn from the prior for every row, dealt to all cores first unless they are.

    First the shared block, then the well block given it. ``exhausted`` is true where
    a truncated draw found no value; those particles have a null entry.
    """
    shared = {}
    for p in layout.shared:
        if p.dist == "uniform":
            shared[p.name] = draws.uniform(seed, p.name, [key], p.a, p.b, method)
        elif p.dist == "half_cauchy":
            shared[p.name] = draws.half_cauchy(seed, p.name, [key], p.b, method)
        else:
            raise ValueError(f"no sampler for {p.dist!r}")
    drawn = (spread(df) if deal else df).select("*", *[column.alias(name) for name, column in shared.items()])
    for g in layout.groups:
        drawn = drawn.select(
            "*",
            *[
                draws.truncated_normal(seed, g.name, [F.col(key), F.lit(w)], g.mean, g.spread, method).alias(
                    f"{g.name}_{w}"
                )
                for w in range(1, layout.wells + 1)
            ],
        )
    # not one array of the draws: the optimizer would make them all anew for every entry read from it
    blocks = [[n for n in layout.names if n not in shared], list(shared)]
    packed = F.concat(*[F.array(*[F.col(n) for n in block]) for block in blocks if block])
    return drawn.select(*df.columns, packed.alias("theta")).withColumn(
        "exhausted", F.exists("theta", lambda x: x.isNull())
    )


def prior_table(spark: SparkSession, layout: Layout, n: int, seed: int, *, method: str = "md5") -> DataFrame:
    """``n`` particles drawn from the prior, numbered from 1."""
    ids = spark.range(1, n + 1).withColumnRenamed("id", "particle_id")
    return draw_prior(ids, layout, seed, method=method, deal=False)


def override_parameter(truth: DataFrame, overrides: DataFrame) -> DataFrame:
    """Corrupted variants of a parameter table.

    Both tables have (scenario, well, param, value); ``well`` is null when shared.
    """
    changes = overrides.withColumnRenamed("value", "__value")
    joined = match(truth, changes, ["scenario", "well", "param"], "left", broadcast=False)
    return joined.withColumn("value", F.coalesce("__value", "value")).drop("__value")
