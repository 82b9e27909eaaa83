"""Run queries against their SQL twins and print what differs.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [tuple(normal(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(body, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def differences(spark_df, con, sql):
    """None when equal, otherwise a short text."""
    got_names, got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_names, want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} vs {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    off = [(g, w) for g, w in zip(got, want) if g != w]
    types = {(type(a).__name__, type(b).__name__) for g, w in zip(got[:50], want[:50]) for a, b in zip(g, w) if a is not None and b is not None and type(a) is not type(b)}
    if off:
        return f"{len(off)} of {len(got)} rows differ, such as {off[:2]}"
    return f"types {types}" if types else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            df = run(spark, sf)
            if name in oracles:
                result = differences(df, con, oracles[name]) or "equal"
            else:
                result = f"{df.count()} rows, no oracle"
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:600]}"
        bad += result != "equal" and "no oracle" not in result
        print(f"{name:28s} {time.time() - began:6.1f}s {result}", flush=True)
    print("bad:", bad)
