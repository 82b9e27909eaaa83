import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cellgauge.llm import bpe

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return bpe.read_ranks(lines)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(df, library):
    for r in df.collect():
        ids = library.encode_ordinary(r.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest()), r.doc_id
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_whole_table_equals_the_library(spark, documents, ranks, library):
    check(bpe.digests(documents, ranks, PATTERN), library)


def test_awkward_rows(spark, awkward, ranks, library):
    clashing = awkward.withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(-1))
    made = bpe.digests(clashing, ranks, PATTERN)
    assert made.count() == awkward.count()
    check(made, library)
    assert bpe.digests(awkward.limit(0), ranks, PATTERN).count() == 0


def test_ids_decode_apart_from_encoding(spark, awkward, ranks):
    ids = bpe.encode(awkward, ranks, PATTERN, out="IDS")
    assert ids.columns == [*awkward.columns, "IDS"]
    back = bpe.decode(ids, ranks, "IDS")
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())


def test_small_corpora_and_a_short_memory_change_nothing(ranks, library):
    rng = random.Random(5)
    letters = "aaabcdeé ñ\n\t 12.,'s漢字🙂 "
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(300)] + ["a" * 3000, " " * 999, "ha" * 500]
    encoder = bpe.Encoder(bpe.Vocabulary(ranks, PATTERN), remember=50)
    for corpus in bpe._corpora(texts, 200):
        for text, ids in zip(corpus, encoder.corpus(corpus)):
            assert ids.tolist() == library.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("seed", range(12))
def test_ranks_in_any_order(seed):
    """Made-up ranks, where merges make pairs of lower rank than their own."""
    rng = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 320:
        tokens.add(bytes(rng.choices(b"abc", k=rng.randint(2, 6))))
    more = sorted(t for t in tokens if len(t) > 1)
    rng.shuffle(more)
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(more)}
    library = tiktoken.Encoding("own", pat_str=r"[^ ]+| ", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rng.choices("abc", k=rng.randint(1, 24))) for _ in range(400)]
    vocabulary = bpe.Vocabulary(ranks, "")
    ids, counts = bpe.replay([w.encode() for w in words], vocabulary)
    at = 0
    for w, k in zip(words, counts.tolist()):
        assert ids[at : at + k].tolist() == library.encode_ordinary(w), w
        at += k
