"""Quality rules: text statistics and learned decision lists, in native columns only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import SPACE, fresh, in_fold, query, table
from cellgauge.plans.scale import match, settle

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows the rules are learned from at most; the ones with the smallest hash of their id.
MAX_ROWS = 20_000


def text_statistics(text: Column) -> dict[str, Column]:
    """Columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text has none of each."""
    body = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+", -1))
    lines = F.filter(F.split(body, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    return {
        "words": words,
        "word_chars": F.length(F.translate(body, SPACE, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """64-bit hash of every window of ``width`` words, in order."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words inside windows found twice or more; ``hashes`` are a text's windows in order.

    Only texts with a repeat sort their windows: equal ones stand side by side then, and
    the covered words are the union of [start, start + width).
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def equal(row, k, by):
        return F.coalesce(F.get(row, k + by)["h"] == F.get(row, k)["h"], F.lit(False))

    def twice(row):
        kept = F.transform(row, lambda e, k: F.when(equal(row, k, F.lit(-1)) | equal(row, k, F.lit(1)), e["i"]))
        return F.array_sort(F.filter(kept, lambda i: i.isNotNull()))

    def covered(starts):
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, s: F.struct(
            (acc["n"] + s + width - F.greatest(s, acc["end"])).alias("n"), (s + width).alias("end")
        )
        return F.aggregate(starts, begin, step, lambda acc: acc["n"])

    # one-element arrays bind an array to a name, so that it is made once for each text
    held = F.get(F.transform(F.array(placed), lambda row: covered(twice(row))), F.lit(0))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(held)


def statistics(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words and the base statistics of every row."""
    made = text_statistics(F.col(text_column))
    step = documents.select(F.col(id_column).alias("doc_id"), *[c.alias(n) for n, c in made.items()])
    step = step.withColumn("windows", window_hashes(F.col("words")))
    return step.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"),
    )


# --------------------------------------------------------------------------
# Learned decision lists
# --------------------------------------------------------------------------

#: What rules may test, as expressions over the statistics.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "CAST(n_dup_lines AS DOUBLE)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    verdict: bool

    def covers(self, row: dict) -> bool:
        return all(t.holds(row) for t in self.tests)

    def condition(self) -> Column:
        return reduce(lambda a, b: a & b, [F.expr(t.sql()) for t in self.tests])


def _thresholds(rows: Sequence[dict], feature: str, most: int = 32) -> list[float]:
    values = sorted({row[feature] for row in rows})
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
    return cuts if len(cuts) <= most else [cuts[i * len(cuts) // most] for i in range(most)]


def _grow(rows: list[dict], longest: int) -> tuple[Test, ...]:
    """Add the test with the best information gain until only the target class is covered."""
    from math import log2

    tests: list[Test] = []
    covered = rows
    while len(tests) < longest:
        pos = sum(r["target"] for r in covered)
        if not pos or pos == len(covered):
            break
        base, best = log2(pos / len(covered)), (0.0, None)
        for feature in FEATURES:
            for cut in _thresholds(covered, feature):
                over = [r["target"] for r in covered if r[feature] > cut]
                over_pos, over_all = sum(over), len(over)
                for above, p, n in ((True, over_pos, over_all), (False, pos - over_pos, len(covered) - over_all)):
                    if p and (gain := p * (log2(p / n) - base)) > best[0] + 1e-9:
                        best = (gain, Test(feature, above, cut))
        if best[1] is None:
            break
        tests.append(best[1])
        covered = [r for r in covered if best[1].holds(r)]
    return tuple(tests)


def _tightest(tests: Sequence[Test]) -> tuple[Test, ...]:
    """Without tests that another one of the same feature and side implies."""
    best: dict[tuple[str, bool], Test] = {}
    for t in tests:
        held = best.get((t.feature, t.above))
        if held is None or (t.threshold > held.threshold) == t.above:
            best[t.feature, t.above] = t
    return tuple(best.values())


def _prune(tests: tuple[Test, ...], rows: Sequence[dict]) -> tuple[Test, ...]:
    """Leave out one test at a time, whichever helps most, while the corrected precision does not fall."""
    score = _precision(tests, rows)[0]
    while len(tests) > 1:
        shorter = [tests[:i] + tests[i + 1 :] for i in range(len(tests))]
        scores = [_precision(s, rows)[0] for s in shorter]
        if max(scores) < score:
            break
        score = max(scores)
        tests = shorter[scores.index(score)]
    return tests


def _precision(tests: Sequence[Test], rows: Sequence[dict]) -> tuple[float, int]:
    covered = [r["target"] for r in rows if all(t.holds(r) for t in tests)]
    return (sum(covered) + 1) / (len(covered) + 2), len(covered)


def learn_rules(
    rows: Sequence[dict], *, precision: float = 0.9, min_cover: int = 3, longest: int = 4, most_rules: int = 16
) -> list[Rule]:
    """Sequential covering of the rows to drop (``target`` 1), as an ordered list of rules.

    Two thirds of the rows grow a conjunction of thresholds, the rest prune it: any test
    goes while that does not lower its corrected precision there. A rule below
    ``precision`` or ``min_cover`` on the rows in hand ends the list, so clean texts are
    kept unless a rule is sure. No rows, or one class only, give no rule.
    """
    left = list(rows)
    rules: list[Rule] = []
    while len(rules) < most_rules and any(r["target"] for r in left):
        grown = _grow([r for i, r in enumerate(left) if i % 3], longest)
        hold = [r for i, r in enumerate(left) if i % 3 == 0]
        if not grown:
            break
        tests = _prune(_tightest(grown), hold)
        score, size = _precision(tests, left)
        if score < precision or size < min_cover:
            break
        rules.append(Rule(tests, False))
        left = [r for r in left if not rules[-1].covers(r)]
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The rules as one ordered conditional expression over the statistics; kept by default."""
    out = None
    for rule in rules:
        out = F.when(rule.condition(), rule.verdict) if out is None else out.when(rule.condition(), rule.verdict)
    return F.lit(True) if out is None else out.otherwise(True)


def training_rows(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[dict]:
    """At most ``max_rows`` labelled rows with their features, by the hash of their id; one of five ids is left for tests.

    A document with several labels counts as bad if one says so; null labels are left out.
    """
    one = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = match(stats, one, ["doc_id"], "inner", broadcast=False).filter(~in_fold(F.col("doc_id"), 5, 0))
    order, = fresh(stats, "order_hash")
    rows = (
        joined.select(F.xxhash64("doc_id").alias(order), (F.col("quality") == 0).cast("int").alias("target"), *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])
        .orderBy(order, "target", *FEATURES).limit(max_rows)
    )
    return [r.asDict() for r in rows.collect()]


def judge(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, max_rows: int = MAX_ROWS) -> tuple[DataFrame, list[Rule]]:
    """Statistics, ``base_failed`` and ``kept`` of every row, and the rules learned from ``labels``.

    A row per input row, repeated ids too. Null and empty texts have no words and fail the
    base rule. Without labels nothing is learned and ``kept`` is the base rule's. Input
    columns other than id and text are left behind, so none can clash.
    """
    stats = settle(statistics(documents, id_column, text_column))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rules = learn_rules(training_rows(stats.filter(~failed), labels, max_rows))  # what the base drops teaches nothing
    out = stats.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


@query("op6_quality_rules")
def op6_quality_rules(spark, sf):
    judged, _ = judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged
