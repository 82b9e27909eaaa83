import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cellgauge.llm import simhash
from cellgauge.llm.components import connected_components


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(items, near):
    """items: (id, value); smallest id reachable by links of near values."""
    root = {v: v for _, v in items}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = list(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if near(a, b):
                root[find(a)] = find(b)
    least = {}
    for d, v in items:
        if d is not None:
            least[find(v)] = min(least.get(find(v), d), d)
    return [(d, v, least.get(find(v))) for d, v in items]


def expected(rows):
    items = [(d, brute_fingerprint(t)) for d, t in rows]
    return sorted(brute_components(items, lambda a, b: (a ^ b).bit_count() <= 3), key=repr)


def got(df):
    return sorted(((r["id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in df.collect()), key=repr)


def test_whole_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(simhash.near_duplicates(documents)) == expected(rows)


def test_spark_hash_is_the_fingerprint_hash(spark):
    row = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()
    assert row[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(simhash.near_duplicates(awkward)) == expected(rows)
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 5, 6, 7, 8, 9, 10]
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def test_one_id_and_two_texts(spark):
    a, b = "a first text that nothing else is like, about rivers and hills", "quite another text on the price of salt in old towns"
    rows = [(2, b), (5, a), (5, b), (7, a), (5, a), (None, b)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, b), (2, b), (5, a), (5, a)]


def near_values(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = {rng.getrandbits(64) for _ in range(n)}
    for c in centres:
        for _ in range(n // 6):
            v = c
            for _ in range(rng.randint(0, 7)):
                v ^= 1 << rng.randrange(64)
            out.add(v)
    return sorted(out)


def test_trie_finds_every_pair():
    values = np.array(near_values(600, 1), np.uint64)
    found = set()
    for a, b in simhash.trie_pairs(values, np.zeros(len(values)), 3):
        found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 3}
    assert found == want and want


def test_cut_blocks_lose_no_link(spark):
    values = near_values(400, 2)
    items = [(i, v) for i, v in enumerate(values)]
    want = {d: c for d, _, c in brute_components(items, lambda a, b: (a ^ b).bit_count() <= 3)}
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in items], "id bigint, fp bigint")
    for rows in (simhash.TRIE_ROWS, 1, 7):
        links = simhash.hamming_links(df, trie_rows=rows)
        roots = connected_components(links, "a", "b")
        assert links.count() < 4 * 12 * len(values)
        named = df.join(roots, df.fp == roots.node, "left").select("id", F.coalesce("root", "fp").alias("root"))
        least = named.groupBy("root").agg(F.min("id").alias("least"))
        assert {r.id: r.least for r in named.join(least, "root").collect()} == want


def test_chain_is_one_component(spark):
    links = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    roots = connected_components(links, "a", "b")
    assert roots.filter("root != 0").count() == 0 and roots.count() == 399
