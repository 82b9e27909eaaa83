import random
import re

from pyspark.sql import functions as F

from cellgauge.llm import quality

SPACE = "[\x20\x09-\x0d]"


def brute(text):
    text = text or ""
    words = [w for w in re.split(SPACE + "+", text) if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.sub(SPACE, "", line)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def check(spark, rows, labels):
    judged, rules = quality.judge(rows, labels)
    texts = {r.doc_id: r.text for r in rows.collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = judged.collect()
    assert len(found) == rows.count()
    for r in found:
        assert tuple(r[n] for n in names) == brute(texts[r.doc_id]), r
        assert not (r.base_failed and r.kept)
    return found, rules


def test_whole_table_equals_brute_force(spark, sf, documents):
    found, rules = check(spark, documents, spark.read.parquet(f"{sf}/labels.parquet"))
    covers = lambda r: any(rule.covers({n: F_(r) for n, F_ in FEATURE.items()}) for rule in rules)
    assert all(r.kept == (not r.base_failed and not covers(r)) for r in found)


FEATURE = {
    "n_words": lambda r: float(r.n_words), "chars_per_word": lambda r: r.word_chars / max(r.n_words, 1),
    "symbols_per_word": lambda r: r.n_symbols / max(r.n_words, 1), "dup_lines": lambda r: float(r.n_dup_lines),
    "repeat_share": lambda r: r.n_repeat_words / max(r.n_words, 1),
}


def test_held_out_rows(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged, rules = quality.judge(documents, labels)
    held = judged.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").join(labels, "doc_id").collect()
    clean, junk = [r.kept for r in held if r.quality == 1 and not r.base_failed], [r.kept for r in held if r.quality == 0]
    assert sum(clean) / len(clean) > 0.98
    assert 1 <= len(rules) <= 16 and all(not rule.verdict for rule in rules)
    assert sum(junk) / len(junk) < 0.5
    passed = [r for r in held if not r.base_failed]  # what the learned list adds to the base rule
    assert sum(r.quality == 0 and not r.kept for r in passed) > 0.8 * sum(r.quality == 0 for r in passed)
    assert sum(r.quality == (1 if r.kept else 0) for r in passed) > sum(r.quality == 1 for r in passed)


def test_rules_hold_no_idle_tests():
    rng = random.Random(7)
    rows = []
    for _ in range(1200):
        row = {n: rng.random() for n in quality.FEATURES}
        row["target"] = int(0.3 < row["repeat_share"] < 0.5 and row["n_words"] > 0.6)
        rows.append(row)
    for rule in quality.learn_rules(rows):
        sides = [(t.feature, t.above) for t in rule.tests]
        assert len(sides) == len(set(sides))
    t = quality.Test
    assert quality._tightest([t("a", True, 1.0), t("a", True, 3.0), t("a", False, 9.0), t("a", False, 7.0)]) == (t("a", True, 3.0), t("a", False, 7.0))
    first, idle = t("n_words", True, 0.6), t("dup_lines", True, 0.0)
    assert quality._prune((idle, first), [{"n_words": i / 10, "dup_lines": 1.0, "target": int(i > 6)} for i in range(10)]) == (first,)


def test_one_class_and_all_failed_tables(spark):
    good = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(40)], "doc_id bigint, text string")
    for quality_value in (0, 1):
        labels = good.selectExpr("doc_id", f"{quality_value} as quality")
        judged, rules = quality.judge(good, labels)
        assert rules == [] and judged.filter("kept").count() == 40
    short = good.withColumn("text", F.lit("a b"))
    judged, rules = quality.judge(short, good.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert rules == [] and judged.filter("kept").count() == 0


def test_sequential_covering_finds_the_planted_rules():
    rng = random.Random(6)
    rows = []
    for _ in range(900):
        row = {n: rng.random() for n in quality.FEATURES}
        row["target"] = int(row["symbols_per_word"] > 0.8 or (row["dup_lines"] > 0.7 and row["n_words"] <= 0.4))
        rows.append(row)
    rules = quality.learn_rules(rows)
    wrong = sum(any(rule.covers(r) for rule in rules) != bool(r["target"]) for r in rows)
    assert wrong < 27
    assert quality.learn_rules([]) == [] and quality.learn_rules([r | {"target": 0} for r in rows]) == []


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(4, 0, 1), (4, 1, 0), (9, None, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    one_each = awkward.filter("doc_id is not null").withColumn("n_words", F.lit(1)).withColumn("windows", F.lit(2))
    check(spark, one_each, labels)
    judged, rules = quality.judge(awkward.limit(0), labels.limit(0))
    assert judged.count() == 0 and rules == []
