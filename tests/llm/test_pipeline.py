import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cellgauge.llm import bpe, langid
from tests.llm.test_decontam import brute as brute_items
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import expected as brute_groups

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count()
        kept.append(len(after))
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "language_id":
            lost = [r.text for d, r in before.items() if d not in after]
            assert len(lost) <= 0.01 * len(before)
        elif name == "line_dedup":
            want = dict(zip(before, brute_lines([r.text for r in before.values()])))
            assert {d: r.text for d, r in after.items()} == {d: w[0] for d, w in want.items()}
            assert all(r.n_chars == len(r.text) for d, r in after.items() if want[d][2])
        elif name == "simhash_near_dedup":
            groups = brute_groups([(d, r.text) for d, r in before.items()])
            assert sorted(after) == sorted({c for _, _, c in groups})
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            held = brute_items([(d, r.text) for d, r in before.items()], items)
            assert sorted(after) == sorted(d for d in before if not held[d])
        else:
            with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as ranks:
                library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
            for d, r in after.items():
                ids = library.encode_ordinary(before[d].text or "")
                assert bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in ids)
                assert r.decoded_sha256 == hashlib.sha256((before[d].text or "").encode()).hexdigest()
    assert kept[3] < kept[2] and kept[4] < kept[3] and kept[5] == kept[4] > 0.7 * kept[0]
    run = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert sorted(run) == sorted((d, r.ids_sha256) for d, r in after.items())


def test_awkward_rows(spark, awkward):
    docs = awkward.withColumn("row_id", F.lit(1)).withColumn("score", F.lit(2)).withColumn("items", F.lit(3))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            if name != "byte_bpe":
                assert out.columns == table.columns, name
            assert out.count() <= table.count()


def test_low_scores_of_many_languages_stay(spark, monkeypatch):
    names = [f"l{i}" for i in range(12)]
    even = langid.Model([[n] for n in names], np.zeros((langid.DIMENSIONS + 1, len(names)), np.float32), {})
    monkeypatch.setattr(langid, "train", lambda *_, **__: even)
    docs = spark.createDataFrame([(1, "a clean short text"), (2, "12 34"), (3, None), (4, "")], "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()] == [1]
