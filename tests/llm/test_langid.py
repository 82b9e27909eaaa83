import numpy as np

from cellgauge.llm import langid

LEARNT = "crc32(cast(cast(doc_id as string) as binary)) % 4 != 2"


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(documents.filter(LEARNT))
    assert sorted(map(sorted, model.families)) == [["de", "en"], ["es", "fr"]] and len(model.machines) == 2
    rows = langid.identify(documents.filter(f"not ({LEARNT})"), model).select("lang", "language.*").toDF("lang", "pred", "score").collect()
    assert np.mean([r.lang == r.pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_pieces_do_not_change_features(monkeypatch):
    text = "Schöne Grüße, the quick brown fox " * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.array_equal(whole, langid.features(text))


def test_awkward_rows(spark, awkward):
    model = langid.train(awkward)
    rows = {r.doc_id: r for r in langid.identify(awkward, model).collect()}
    assert all(tuple(rows[i].language) == ("und", 0.0) for i in (1, 2, 3, 8))
    assert all(rows[i].language.lang in ("en", "fr", "de") for i in (4, 5, 7, 9))
    assert langid.identify(awkward, model).count() == awkward.count()
    untaught = langid.train(awkward.limit(0))
    assert {r.language.lang for r in langid.identify(awkward, untaught).collect()} == {"und"}
    assert langid.identify(awkward.limit(0), model).count() == 0


def test_three_of_a_family_vote():
    words = {"da": "og hvad ikke", "sv": "och inte vad", "no": "ikkje kva og", "fr": "pas quoi et"}
    texts = [f"{w} {i}" for i in range(20) for w in words.values()]
    model = langid.fit(texts, [k for _ in range(20) for k in words])
    assert len(model.machines) == 3
    assert [model.predict(t)[0] for t in words.values()] == list(words)


def test_letters_are_what_unicode_calls_letters(spark):
    texts = ["² ½ ③", "Ⅷ ⅷ", "€ + ∑ ©", "٣ 7 _", "", None, "ª", "x²", "日本", "ʰ"]
    model = langid.fit(["the quick one"] * 5 + ["le vif un"] * 5, ["en"] * 5 + ["fr"] * 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.language.lang for r in langid.identify(df, model).collect()}
    assert {i for i, lang in got.items() if lang == langid.UNKNOWN} == {0, 1, 2, 3, 4, 5}


def test_training_is_the_same_where_the_texts_are(spark, documents):
    rows = documents.filter("lang is not null").collect()
    here = langid.fit([r.text for r in rows], [r.lang for r in rows])
    there = langid.train(documents.repartition(5), max_rows=10**6)
    for text in [r.text for r in rows[:60]]:
        assert here.predict(text)[0] == there.predict(text)[0]
        assert abs(here.predict(text)[1] - there.predict(text)[1]) < 1e-3


def test_packed_features_are_short_for_long_texts():
    x = langid.features("".join(chr(97 + i % 26) + chr(97 + i * i % 26) for i in range(400_000)))
    packed, back = langid.pack(x), np.zeros(langid.DIMENSIONS, np.float32)
    langid.unpack(packed, back)
    assert np.array_equal(x, back) and len(packed) <= 6 * langid.DIMENSIONS
