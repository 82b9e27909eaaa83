import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellgauge.llm import resample


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def features(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [text for _, text in docs]), (t, target)):
        for text in texts:
            for f in features(text, longest)[1]:
                counts[place(f)] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (big_s + buckets) / ((a + 1) * (big_t + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        words, found = features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(f)] for f in found)
        rows.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    ready = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0]))
    ranks = {id(r): i + 1 for i, r in enumerate(ready[: len(ready) * percent // 100])}
    return [(str(r[0]), *r[1:], str(ranks.get(id(r)))) for r in rows]


def check(df, target, keep=None, **options):
    want = brute([(r.doc_id, r.text) for r in df.collect()], [r.text for r in target.collect()], **options)
    made = resample.resample(df, target, keep=keep, **options)
    got = [(str(r.doc_id), r.n_words, r.n_features, r.weight, r.score, str(r.rank)) for r in made.collect()]
    assert sorted(got) == sorted(want)
    return made


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select("text")


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 101}, {"min_words": 1, "percent": 50}, {"longest": 2, "min_words": 0, "percent": 100}])
def test_awkward_rows(spark, awkward, benchmark, options):
    clashing = awkward.withColumn("RANK", F.lit("x")).withColumn("resample_id", F.lit(1)).withColumn("score", F.lit(0))
    made = check(clashing, benchmark, **options)
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "resample_id", "n_words", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark, awkward, benchmark):
    assert resample.resample(awkward.limit(0), benchmark).count() == 0
    check(awkward, benchmark.limit(0), longest=2, min_words=1, percent=40)


def test_runs_of_words_on_the_table(spark, documents, benchmark):
    check(documents.repartition(7), benchmark, keep=["doc_id"], longest=2)


def test_ties_are_drawn_by_id(spark, benchmark):
    df = spark.createDataFrame([(i // 4, "the same words " * 10) for i in range(400)], "doc_id bigint, text string")
    made = resample.resample(df, benchmark)
    ranks = sorted(r["rank"] for r in made.filter("rank is not null").collect())
    assert ranks == list(range(1, 41))
    order = [(-r.score, r.doc_id) for r in made.filter("rank is not null").orderBy("rank").collect()]
    assert order == sorted(order)


def test_slices_hold_whole_texts():
    texts = pa.array(["a" * n for n in (5, 0, 30, 2, 2, 2, 9)] + [None])
    parts = list(resample.slices(texts, 10))
    assert pa.concat_arrays([p for _, p in parts]).to_pylist() == texts.to_pylist()
    assert [at for at, _ in parts] == [0, 2, 3, 6]
    whole, cut = resample.feature_buckets(texts, 2), [resample.feature_buckets(p, 2) for _, p in parts]
    assert np.array_equal(whole[0], np.concatenate([n for n, _ in cut]))
