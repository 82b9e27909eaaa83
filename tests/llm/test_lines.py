import hashlib

from pyspark.sql import functions as F

from cellgauge.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(texts, min_docs=10, min_chars=1):
    split = [(t or "").split("\n") for t in texts]
    seen = {}
    for part in split:
        for key in {lower(line.strip(SPACE)) for line in part}:
            seen[key] = seen.get(key, 0) + 1
    gone = lambda line: len(k := lower(line.strip(SPACE))) >= min_chars and seen[k] >= min_docs
    return [("\n".join(line for line in part if not gone(line)), len(part), sum(map(gone, part))) for part in split]


def check(df, rows, **options):
    want = sorted(brute([t for _, t in rows], **options))
    done = lines.dedup_lines(df, **options)
    assert sorted((r.kept_text, r.n_lines, r.n_dropped) for r in done.collect()) == want


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for options in ({}, {"min_docs": 2}, {"min_docs": 1}, {"min_docs": 2, "min_chars": 6}):
        check(awkward.withColumn("n_lines", F.lit("x")).withColumn("row_id", F.lit(1)), rows, **options)
    assert lines.dedup_lines(awkward.limit(0)).count() == 0


def test_shared_lines_keep_the_rest_in_place(spark):
    texts = [f"first {i}\n  Shared Line\t\nmiddle\nSHARED line\nlast {i % 4}\n" for i in range(12)] + ["shared line", "É shared", "é shared"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    check(df, rows)
    one = lines.dedup_lines(df).filter("doc_id = 3").first()
    assert (one.kept_text, one.n_lines, one.n_dropped) == ("first 3\nlast 3\n", 6, 3)


def test_many_frequent_lines_are_joined_with_salts(spark, awkward, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check(awkward, rows, min_docs=2)
    texts = [f"own {i}\nshared\nShared \nlast {i % 3}" for i in range(200)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5), list(enumerate(texts)))


def test_query_digest(spark, sf):
    from cellgauge.llm.queries import QUERIES

    row = QUERIES["op7_line_dedup"](spark, sf).filter("n_dropped = 0").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").first()
    assert row.kept_sha256 == hashlib.sha256(row.text.encode()).hexdigest()
