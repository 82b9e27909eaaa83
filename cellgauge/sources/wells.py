"""Sources and sinks: wells, cells, controls, rounds and scenarios."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_SCHEMA = (
    "exp string, cond string, temp double, cell_line string, quenched boolean, "
    "time double, repeat long, signal_bdp double, signal_cy5 double, cell_id long"
)
COMMITS = "_commits"  # one row for every round written whole
COMMIT_SCHEMA = "run_id string, round int, written long, attempt string"
ROUND_SCHEMA = (
    "particle_id long, theta array<double>, rho double, run_id string, round int"
)
SCENARIO_SCHEMA = (
    "time double, rep int, quenched boolean, channel string, cell long, value double, "
    "scenario string"
)
WELL_KEYS = ["exp", "cond", "temp", "cell_line", "quenched", "time", "repeat"]


def read_cells(spark: SparkSession, path: str, schema: str = CELL_SCHEMA) -> DataFrame:
    """The long cell table, from Parquet or from headered CSV (``.csv`` in the path)."""
    if ".csv" in path:
        return spark.read.schema(schema).csv(path, header=True)
    return spark.read.schema(schema).parquet(path)


def read_wells(
    spark: SparkSession, path: str, schema: str, *, glob: str = "*", well_in: str = "file"
) -> DataFrame:
    """Every exported well below ``path`` as one table with a ``well`` column.

    The well's name is the file name, or with ``well_in="directory"`` the ``well=...``
    directory a file lies in. Hidden files are skipped by the reader.
    """
    raw = spark.read.schema(schema).option("pathGlobFilter", glob)
    raw = raw.option("recursiveFileLookup", "true").csv(path, header=True)
    if well_in == "file":
        name = F.col("_metadata.file_name")
    elif well_in == "directory":
        name = F.regexp_extract(F.col("_metadata.file_path"), r"well=([^/]+)/[^/]*$", 1)
    else:
        raise ValueError("well_in is 'file' or 'directory'")
    return raw.select("*", name.alias("well"))


def well_metadata(name: Column | str) -> Column:
    """S3: a struct of the fields in ``<cond>_<temp><6>_<Q>_<line>_<time><3>_<repeat>.<ext>``.

    Null for a name that does not follow the pattern.
    """
    name = F.col(name) if isinstance(name, str) else name
    part = F.split(name, "_")

    def trimmed(i: int, suffix: int) -> Column:
        text = F.get(part, F.lit(i))
        return F.substring(text, F.lit(1), F.length(text) - suffix)

    temp = trimmed(1, 6).try_cast("double")
    time = trimmed(4, 3).try_cast("double")
    repeat = trimmed(5, 4).try_cast("long")
    valid = (F.size(part) >= 6) & temp.isNotNull() & time.isNotNull() & repeat.isNotNull()
    return F.when(
        valid,
        F.struct(
            F.get(part, F.lit(0)).alias("cond"),
            temp.alias("temp"),
            (F.get(part, F.lit(2)) == "Q").alias("quenched"),
            F.get(part, F.lit(3)).alias("cell_line"),
            time.alias("time"),
            repeat.alias("repeat"),
        ),
    )


def split_wells(df: DataFrame, name: str = "well", exp: str = "DualMarker") -> tuple[DataFrame, DataFrame]:
    """Rows with metadata columns, and the reject table of rows whose well name is malformed."""
    parsed = df.withColumn("__meta", well_metadata(name))
    good = parsed.filter(F.col("__meta").isNotNull()).select(
        F.lit(exp).alias("exp"), "__meta.*", *df.columns
    )
    return good, parsed.filter(F.col("__meta").isNull()).drop("__meta")


def read_control(spark: SparkSession, path: str, position: int) -> DataFrame:
    """One column of a headered control export, by zero-based position, named ``value``."""
    export = spark.read.csv(path, header=True)  # without inference: only the header is read here
    chosen = export.columns[position]
    return export.select(F.col(f"`{chosen}`").cast("double").alias("value"))


def write_table(
    df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write a table; an existing folder is an error unless asked otherwise."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def write_cells(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """All wells as one table; Parquet is partitioned by time."""
    partitions = ["time"] if fmt == "parquet" else []
    write_table(df, path, fmt=fmt, partition_by=partitions, mode=mode)


def write_summary(df: DataFrame, path: str, *, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """The per-well summary."""
    write_table(df, path, fmt=fmt, mode=mode)


def save_round(particles: DataFrame, path: str, run_id: str, round_no: int) -> None:
    """Write one round of particles; writing the round again replaces it.

    Rows go to a folder of this attempt, then one row says that it is whole. Until then
    readers see the round as it was, so a driver lost in mid-write loses nothing; an
    attempt without its row is never read.
    """
    spark = particles.sparkSession
    attempt = uuid.uuid4().hex
    folder = f"{path}/run_id={run_id}/round={round_no}/attempt={attempt}"
    particles.select("particle_id", "theta", "rho").write.parquet(folder)
    done = spark.createDataFrame([(run_id, round_no, time.time_ns(), attempt)], COMMIT_SCHEMA)
    done.coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")


def load_round(spark: SparkSession, path: str, run_id: str, round_no: int | None = None) -> DataFrame:
    """The last whole writing of a round, or of all rounds of a run; other folders are not read."""
    commits = spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/{COMMITS}").filter(F.col("run_id") == run_id)
    if round_no is not None:
        commits = commits.filter(F.col("round") == round_no)
    last = commits.groupBy("round").agg(F.max_by("attempt", "written").alias("attempt")).collect()  # a row a round
    if not last:
        return spark.createDataFrame([], ROUND_SCHEMA)
    folders = [f"{path}/run_id={run_id}/round={r['round']}/attempt={r['attempt']}" for r in last]
    rounds = spark.read.schema(f"{ROUND_SCHEMA}, attempt string").option("basePath", path).parquet(*folders)
    return rounds.drop("attempt")


def save_scenarios(samples: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Samples, true parameters or pools of several scenarios, one folder each."""
    write_table(samples, path, partition_by=["scenario"], mode=mode)


def load_scenarios(
    spark: SparkSession, path: str, scenarios: Sequence[str] | None = None, schema: str = SCENARIO_SCHEMA
) -> DataFrame:
    """The chosen scenarios; the others are not read."""
    table = spark.read.schema(schema).parquet(path)
    return table if scenarios is None else table.filter(F.col("scenario").isin(list(scenarios)))
