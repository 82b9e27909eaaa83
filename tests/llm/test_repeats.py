import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.llm import repeats
from cellgauge.llm.repeats import Shape


def brute(texts, length):
    """Removed runs of each text, from a dictionary of all strings."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            s = r[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(int)))
        out.append([(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
    return raws, out


def check(df, texts, length, **options):
    raws, want = brute(texts, length)
    rows = df.collect()
    assert len(rows) == len(texts)
    by = {}
    for t, raw, spans in zip(texts, raws, want):
        by[t] = (raw, spans)
    for r in rows:
        raw, spans = by[r.text]
        assert [(s.low, s.high) for s in r.spans] == spans, (r.doc_id, spans)
        kept = b"".join(raw[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(raw)]))
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(raw), len(raw) - len(kept), kept)


def tangled(seed, n=60):
    """Few letters, shared passages, near copies, periods: many repeats that cross and touch."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abé ", k=k))
    passages = [word(rng.randint(8, 60)) for _ in range(8)]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(passages) if rng.random() < 0.4 else word(rng.randint(0, 20)) for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.1:
            t += rng.choice(["ab", "x", "abc "]) * rng.randint(5, 30)
        out.append(t)
    return out + [out[3], None, "", out[5] + "z"]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    texts = tangled(seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    shape = Shape(16, 10)
    check(repeats.remove_repeats(df, shape=shape), texts, 16)
    check(repeats.remove_repeats(df, shape=shape, bucket_bytes=64), texts, 16)
    check(repeats.remove_repeats(df, shape=shape, hot_contexts=2), texts, 16)


def test_whole_table(spark, documents):
    texts = [r.text for r in documents.collect()]
    done = repeats.remove_repeats(documents)
    check(done, texts, 200)
    assert done.agg(F.sum("n_removed")).first()[0] > 0


def test_pieces_do_not_change_anchors(monkeypatch):
    raw = np.frombuffer("".join(random.Random(2).choices("abcd ", k=5000)).encode() + b"q" * 700, np.uint8)
    whole = repeats.anchors(raw, Shape())
    monkeypatch.setattr(repeats, "PIECE", 97)
    assert all(np.array_equal(a, b) for a, b in zip(whole, repeats.anchors(raw, Shape())))


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merge_gives_sorted_rotations_and_common_prefixes(shards):
    rng = random.Random(shards)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(1, 12))) + b"\x00" for _ in range(40)]
    order, transforms = [], []
    cuts = np.linspace(0, len(strings), shards + 1).astype(int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = strings[a:b]
        sizes = np.array([len(s) for s in part])
        flat = np.frombuffer(b"".join(part), np.uint8)
        starts = np.cumsum(sizes) - sizes
        sa = repeats.shard_order(flat, starts, sizes)
        which = np.repeat(np.arange(len(part)), sizes)
        rotation = [(part[w] * 30)[p - starts[w] :][:20] for w, p in ((which[i], i) for i in sa)]
        assert rotation == sorted(rotation)
        order.append(rotation)
        transforms.append(np.array([(part[which[i]] * 2)[i - starts[which[i]] - 1 + sizes[which[i]]] for i in sa], np.uint8))
    shard, common = repeats.merge_transforms(transforms, 20)
    at = [iter(r) for r in order]
    merged = [next(at[s]) for s in shard]
    assert merged == sorted(merged)
    for x, y, k in zip(merged, merged[1:], common[1:]):
        assert k == next((i for i in range(20) if x[i] != y[i]), 20)


def test_awkward_rows(spark, awkward):
    texts = [r.text for r in awkward.collect()]
    clashing = awkward.withColumn("kept", F.lit(1)).withColumn("row_key", F.lit(2)).withColumn("row_marks", F.lit(3))
    check(repeats.remove_repeats(clashing), texts, 200)
    assert repeats.remove_repeats(awkward.limit(0)).count() == 0
