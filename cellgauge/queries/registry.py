"""Registration of queries, and the roles the driver tables play in them.

``lineitem`` is the cell table: 7 times x 3 replicates x 2 conditions. It has no
unique key, so order-dependent queries order by :data:`CELL_ORDER`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WELL = ["time", "repeat", "quenched"]
CHANNELS = ["signal_cy5", "signal_bdp"]
CELL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "signal_cy5", "signal_bdp", "l_discount", "l_tax", "l_shipdate"]


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as cells: one measured pair of signals with its well."""
    rows = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_shipdate",
        ((F.year("l_shipdate") - 1995) * 30).cast("double").alias("time"),
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).cast("long").alias("repeat"),
        (F.col("l_linestatus") == "F").alias("quenched"),
        F.when(F.col("l_linenumber") == 7, 4.0).otherwise(37.0).alias("temp"),
        F.col("l_extendedprice").alias("signal_cy5"),
        F.col("l_quantity").alias("signal_bdp"),
    )


CELLS = """cells AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_shipdate,
    ((year(l_shipdate) - 1995) * 30)::DOUBLE AS time,
    (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)::BIGINT AS repeat,
    l_linestatus = 'F' AS quenched,
    (CASE WHEN l_linenumber = 7 THEN 4 ELSE 37 END)::DOUBLE AS temp,
    l_extendedprice AS signal_cy5, l_quantity AS signal_bdp
  FROM lineitem)"""


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    for column, places in digits.items():
        df = df.withColumn(column, F.round(column, places))
    return df


# --- SQL twins of the keyed draws -----------------------------------------


def sql_uniform(seed: int, stream: str, *keys: str, part: int = 0) -> str:
    text = ", ".join([f"'{seed}'", f"'{stream}'", *[f"({k})::VARCHAR" for k in keys]])
    word = f"substr(md5(concat_ws('|', {text})), {1 + 8 * part}, 8)"
    return f"((('0x' || {word})::UBIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE"


def sql_normal(seed: int, stream: str, *keys: str, part: int = 0) -> str:
    first, second = (sql_uniform(seed, stream, *keys, part=part + i) for i in range(2))
    return f"(sqrt(-2.0::DOUBLE * ln({first})) * cos(2.0::DOUBLE * pi() * ({second})))"


def sql_lognormal(seed: int, stream: str, mean: str, sd: str, *keys: str) -> str:
    s2 = f"ln(1 + ({sd} / {mean}) * ({sd} / {mean}))"
    return f"exp(ln({mean}) - {s2} / 2 + sqrt({s2}) * {sql_normal(seed, stream, *keys)})"


def sql_pool_index(seed: int, stream: str, size: str, *keys: str) -> str:
    return f"(floor(({sql_uniform(seed, stream, *keys)}) * {size}) + 1)::BIGINT"


def sql_truncated(seed: int, stream: str, mean: str, sd: str, *keys: str, tries: int = 40) -> str:
    attempt = f"{mean} + {sd} * {sql_normal(seed, stream, *keys, 'i')}"
    listed = f"list_transform(range(1, {tries + 1}), lambda i: {attempt})"
    return f"CASE WHEN {sd} = 0 THEN {mean} ELSE list_filter({listed}, lambda x: x >= 0)[1] END"


def sql_gamma(seed: int, stream: str, mean: str, sd: str, skew: str, *keys: str, tries: int = 12) -> str:
    """Rejection sampling over keyed tries, as a list whose first accepted entry is taken."""
    shape = f"(4.0::DOUBLE / (({skew}) * ({skew})))"
    d = f"({shape} - 1.0::DOUBLE / 3.0::DOUBLE)"
    z = sql_normal(seed, stream, *keys, "i")
    u3 = sql_uniform(seed, stream, *keys, "i", part=2)
    tried = f"list_transform(range(1, {tries + 1}), lambda i: {{'z': {z}, 'u': {u3}}})"
    cubed = f"list_transform({tried}, lambda e: {{'z': e.z, 'u': e.u, 'v': pow(1 + e.z / (3 * sqrt({d})), 3)}})"
    kept = (
        f"list_filter({cubed}, lambda e: CASE WHEN e.v > 0 THEN "
        f"ln(e.u) < e.z * e.z / 2 + {d} - {d} * e.v + {d} * ln(e.v) ELSE false END)"
    )
    return f"({mean} + {sd} * sign({skew}) * ({d} * {kept}[1].v - {shape}) / sqrt({shape}))"
