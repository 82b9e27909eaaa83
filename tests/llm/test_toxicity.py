import zlib

import numpy as np
from pyspark.sql import functions as F

from cellgauge.llm import toxicity

LEARNT = "crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"


def area(scores, marks):
    """Chance that a marked row scores above an unmarked one."""
    pos, neg = [s for s, m in zip(scores, marks) if m], [s for s, m in zip(scores, marks) if not m]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_held_out_rows(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(documents.filter(LEARNT), labels.filter(LEARNT))
    held = labels.filter(f"not ({LEARNT})").join(documents, "doc_id")
    rows = toxicity.score_toxicity(held, model).select("doc_id", "toxic", "score").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert area([r.score for r in rows], [r.toxic for r in rows]) > 0.95
    assert np.mean([(r.score >= 0.5) == r.toxic for r in rows]) > 0.95


def test_risk_is_corrected_by_the_prior():
    rng = np.random.default_rng(1)
    prior, n = 0.3, 4000
    hidden = rng.random(n) < prior
    make = lambda toxic: np.stack([(rng.random(len(toxic)) < np.where(toxic, 0.9, 0.05)).astype(np.float32) for _ in range(4)], 1)
    positive, unlabelled = make(np.ones(1000, bool)), make(hidden)
    w, b = toxicity.fit_nnpu(positive, unlabelled, prior)
    assert ((unlabelled @ w + b > 0) == hidden).mean() > 0.95


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (5, 0, 0), (None, 1, 1), (8, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(awkward, labels)
    rows = toxicity.score_toxicity(awkward.withColumn("SCORE", F.lit("x")), model)
    assert [c.lower() for c in rows.columns].count("score") == 1
    scores = rows.collect()
    assert len(scores) == awkward.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if not (r.text or "").strip()}) == 1
    assert toxicity.score_toxicity(awkward.limit(0), model).count() == 0
    empty = toxicity.train(awkward.limit(0), labels.limit(0))
    assert empty.score("anything") < 0.5
