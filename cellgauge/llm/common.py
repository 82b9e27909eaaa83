"""What the text operators share: words, ASCII case, query registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the space and the code points 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

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


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; all-ASCII values take the faster built-in."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have yet, whatever their case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return names


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def bounded_sample(df: DataFrame, rows: int, total: int, *keys: str) -> DataFrame:
    """``rows`` rows at most, about evenly spread, by the hash of ``keys``; all of a smaller table.

    ``total`` is the table's row count. A threshold on the hash thins the rows before
    any of them moves, so the final sort sees little more than it returns.
    """
    hashed = F.xxhash64(*keys, F.lit("sample"))
    share = min(1.0, (1.1 * rows + 50) / max(total, 1))
    thinned = df.filter(F.pmod(hashed, F.lit(1 << 40)) < int(share * (1 << 40)))
    order, = fresh(df, "sample_hash")
    return thinned.withColumn(order, hashed).orderBy(order, *keys).limit(rows).drop(order)
