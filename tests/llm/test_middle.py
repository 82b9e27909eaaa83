import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cellgauge.llm import middle

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, seed=1, fim=90, spm=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(pre), len(mid), out


def check(df, **options):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = []
    for doc_id, text in rows:
        n, form, pre, mid, out = brute(doc_id, text)
        want.append((str(doc_id), n, form, str(pre), str(mid), sha(out), sha(text or ""), out))
    made = middle.fill_in_middle(df, with_text=True, **options)
    got = [(str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output_sha256, r.restored_sha256, r.fim_text) for r in made.collect()]
    assert sorted(got) == sorted(want)
    return made


@pytest.mark.parametrize("chunk", [1, 3, middle.CHUNK_UNITS])
def test_awkward_rows(spark, awkward, chunk):
    clashing = awkward.withColumn("form", F.lit("x")).withColumn("fim_id", F.lit(1))
    made = check(clashing, chunk_units=chunk)
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "fim_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "fim_text"]
    assert middle.fill_in_middle(awkward.limit(0)).count() == 0


def test_marks_and_their_parts(spark):
    texts = ["a<P>b", "<S>", "x <M> y", "<", "<P", "P>", "S><", "a<S b<", "<<P<S<M", "M>M>", "é<ß>" * 50, "<S" * 40, "ab" * 30 + "<P"]
    rows = [(i * 100 + k, t) for i, t in enumerate(texts) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    made = check(df, chunk_units=2)
    forms = {r.form for r in made.collect()}
    assert forms == {"plain", "psm", "spm"}
    assert {r.form for r in made.filter("doc_id < 300").collect()} == {"plain"}  # the first three hold whole marks


def test_equal_rows_come_back_as_often(spark):
    df = spark.createDataFrame([(1, "one two three")] * 500 + [(2, "one two three")], "doc_id bigint, text string").repartition(6)
    made = check(df, partitions=3)
    assert made.filter("doc_id = 1").count() == 500


def test_slices_end_between_units():
    text = "abc def, ghi" * 40 + "z" * 50 + " é.ß\n" + "q" * 9
    for size in (1, 2, 7, 64):
        lengths = [n for part in middle.unit_lengths(text, size) for n in part]
        assert lengths == [len(u) for u in re.findall("[A-Za-z]+|[^A-Za-z]", text)]
    assert middle.unit_offsets(text, [0, 2, 3, len(lengths)], list(middle.unit_lengths(text, 7))) == [0, 4, 7, len(text)]


def test_output_alone_restores(spark, sf, documents):
    df = documents.select("doc_id", "text")
    made = middle.fill_in_middle(df, keep=["doc_id"], with_text=True).join(df, "doc_id")
    parts = {"psm": "^<P>(?s)(.*)<S>(.*)<M>(.*)$", "spm": "^<S>(?s)(.*)<P>(.*)<M>(.*)$"}
    for form, pattern in parts.items():
        p, m, s = (1, 3, 2) if form == "psm" else (2, 3, 1)
        back = F.concat(*[F.regexp_extract("fim_text", pattern, g) for g in (p, m, s)])
        assert made.filter(F.col("form") == form).filter(back != F.col("text")).count() == 0
    assert made.filter(F.sha2(F.col("text").cast("binary"), 256) != F.col("restored_sha256")).count() == 0


def test_one_shuffle_of_the_texts(spark, documents):
    made = middle.fill_in_middle(documents.select("doc_id", "text"), keep=["doc_id"])
    lineage = made.rdd.toDebugString().decode()
    assert lineage.count("ShuffledRDD") == 1
