import random
import re

import pytest
from pyspark.sql import functions as F

from cellgauge.llm import decontam

ITEM = (
    "A train leaves the old station at 9 and travels 120 km to meet Alice near the river. "
    "How many minutes does Alice wait if the train needs 3 hours and she arrives 15 minutes early?"
)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, "Three words only"), (3, None), (4, ""), (None, "the cat sat on the mat today"), (5, ITEM)]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def marked(spark, benchmark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return {r.doc_id: r["items"] for r in decontam.mark(df, benchmark).collect()}


def test_parameters_may_change_but_must_agree(spark, benchmark):
    other = ITEM.replace("Alice", "Robert").replace("120", "45").replace(" 9 ", " 7 ").replace("15", "10").replace(" 3 ", " 2 ")
    swapped = ITEM.replace("meet Alice", "meet Robert").replace("does Alice", "does Wendy")
    embedded = "Some words before it. " * 20 + other + " And more after it." * 20
    got = marked(spark, benchmark, [ITEM, other, swapped, embedded, ITEM.lower(), ITEM.upper(), "Nothing of it at all, just words.", None, ""])
    assert got[0] == got[1] == got[3] == got[4] == [1, 5]
    assert got[2] == got[6] == got[7] == got[8] == []


def test_order_and_share_count(spark, benchmark):
    words = ITEM.split()
    half = " ".join(words[: len(words) // 2])
    most = " ".join(words[:-3])
    mixed = " ".join(words[len(words) // 2 :] + words[: len(words) // 2])
    longer = " ".join([*words[:18], "really", *words[18:]])
    got = marked(spark, benchmark, [half, most, mixed, "Three words only", "Here are three words only.", longer])
    assert got[0] == got[2] == got[4] == [] and got[1] == got[5] == [1, 5] and got[3] == [2]


def test_repeated_windows_inside_an_item(spark):
    series = "What comes next in the series 2, 4, 6, 8, 10, 12?"
    names = "She invited Anna, Bob, Carl, Dora, Emil, Fay, Gus and Hal to dinner on the same evening"
    items = spark.createDataFrame([(1, series), (2, names)], "item_id bigint, text string")
    renamed = names.replace("Anna", "Ivy").replace("Bob", "Jon").replace("Carl", "Kim").replace("Dora", "Liz")
    other = "What comes next in the series 3, 6, 9, 12, 15, 18?"
    got = marked(spark, items, [series, f"Some words before it. {series} And more after it.", names, renamed, other, "2, 4, 6, 8, 10, 12"])
    assert got == {0: [1], 1: [1], 2: [2], 3: [2], 4: [1], 5: []}


def test_one_slot_does_not_hide_an_item(spark):
    filler = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    filler[20] = filler[70] = "7"
    edited = [*filler[:70], "8", *filler[71:]]
    two = "a shop sells pencils for 7 cents and rubbers for 9 cents so what does the whole class of children pay"
    one = "the box on the old table holds 3 red balls and 3 blue balls and you draw some of them without looking at any"
    long = f"then {ITEM} {' '.join(filler[:20])} and Alice left with Alice by the evening train with Alice to go home"
    table = "2 4 6 8 10 12 14 16 18 20 22 24 are next"
    texts = [" ".join(filler), two, one, long, table]
    items = spark.createDataFrame(list(enumerate(texts, 1)), "item_id bigint, text string")
    got = marked(spark, items, [
        " ".join(edited), two.replace("7", "5").replace("9", "5"), one.replace("3 red", "4 red").replace("3 blue", "6 blue"),
        long.replace("Alice", "Robert").replace("left with Robert", "left with Wendy"), table, "1 5 9 " * 20, table.replace(" 4 ", " 5 "),
        f"{two} for 7 cents and rubbers for 9 euro so",
    ])
    assert got == {0: [1], 1: [2], 2: [3], 3: [4], 4: [5], 5: [], 6: [5], 7: [2]}


def brute(docs, items, width=decontam.WINDOW, share=decontam.MIN_SHARE):
    """Plain lower-case windows in order; the tables have no numbers or names in their items."""
    clean = lambda t: [w for w in (re.sub(r"^\W+|\W+$", "", x).lower() for x in (t or "").split()) if w]
    at = {}
    sizes = {}
    for i, t in items:
        w = clean(t)
        sizes[i] = max(1, len(w) - width + 1)
        for k in range(sizes[i]):
            at.setdefault(tuple(w[k : k + width]), []).append((i, k))
    out = {}
    for d, t in docs:
        w, seen = clean(t), {}
        for k in range(max(1, len(w) - width + 1)):
            for i, p in at.get(tuple(w[k : k + width]), ()):
                band = max(decontam.MIN_BAND, sizes[i] // 4)
                for layer in (0, band // 2):
                    seen.setdefault((i, layer, (k - p + layer) // band), set()).add(p)
        out[d] = sorted({key[0] for key, p in seen.items() if len(p) >= share * sizes[key[0]]})
    return out


def test_whole_tables_equal_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    got = {r.doc_id: r["items"] for r in decontam.mark(documents, benchmark).collect()}
    assert got == want and sum(map(bool, want.values())) > 10


def test_pieces_change_nothing(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["Anna", "ran", "5", "km", "--", "home.", "Then", "to", "Rome,"]) for _ in range(400))
    whole = sorted(decontam._windows(text, decontam.Canon(), 5, None))
    monkeypatch.setattr(decontam, "PIECE", 7)
    assert sorted(decontam._windows(text, decontam.Canon(remember=3), 5, None)) == whole


def test_awkward_rows(spark, awkward, benchmark):
    rows = awkward.withColumn("items", F.lit(1)).withColumn("row_hash", F.lit(2)).withColumn("item", F.lit(3))
    out = decontam.mark(rows, benchmark)
    assert out.count() == rows.count() and out.filter("contaminated").count() == 0
    twice = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM), (1, "other text")], "doc_id bigint, text string")
    assert sorted(r["items"] for r in decontam.mark(twice, benchmark).collect()) == [[], [1, 5], [1, 5], [1, 5]]
    assert decontam.mark(rows.limit(0), benchmark).count() == 0
    assert decontam.mark(rows, benchmark.limit(0)).filter("contaminated").count() == 0
