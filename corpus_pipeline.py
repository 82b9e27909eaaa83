"""From raw documents to token ids: five stages over the whole table, each written before the next reads it."""

from __future__ import annotations

import pathlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from cellgauge.llm import bpe, decontam, langid, lines, simhash  # noqa: E402
from cellgauge.llm.common import in_fold, table  # noqa: E402
from cellgauge.plans.scale import scratch_path  # noqa: E402


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; only what the operator calls ``und`` goes, whatever the score.

    The model learns from the documents at hand, but for those held out as in the query.
    """
    model = langid.train(docs.filter(~in_fold(F.col("doc_id"), 4, 2)))
    found = langid.identify(docs, model, out="__language")
    return found.filter(F.col("__language.lang") != langid.UNKNOWN).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text."""
    done = lines.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.keep_first(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    marked = decontam.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter(~F.col("contaminated")).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, their digest, and that of what they decode to."""
    ranks, pattern = bpe.production_ranks(spark)
    return bpe.digests(docs, ranks, pattern).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("byte_bpe", encode_texts),
]

#: Classifiers, components of near copies and merges have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
