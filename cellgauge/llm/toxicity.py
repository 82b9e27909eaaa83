"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.llm.common import bounded_sample, in_fold, query, table
from cellgauge.plans.scale import match, settle

#: Rows the classifier is fitted on at most.
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
#: Words the classifier looks at: those whose document frequencies tell the two samples apart most.
VOCABULARY = 1_024

_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else 0x20 for b in range(256))


def words_of(text: str | None) -> frozenset[bytes]:
    """The distinct lower-cased words of a text, cut at ASCII characters other than letters."""
    return frozenset((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split())


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def word_sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([sorted(words_of(t.as_py())) for t in batch], pa.list_(pa.binary()))


def choose_words(sample: DataFrame, positive: int, unlabelled: int, most: int = VOCABULARY) -> list[bytes]:
    """The words with the largest likelihood ratio between both samples' document frequencies.

    ``sample`` has a flag and the distinct words of every text; only ``most`` words leave Spark.
    """
    counted = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.col("positive").cast("double")).alias("p"), F.sum((~F.col("positive")).cast("double")).alias("u")
    )
    rate = (F.col("p") + F.col("u")) / float(positive + unlabelled)

    def part(seen, size):
        hit = F.when(seen > 0, seen * F.ln(seen / (size * rate))).otherwise(0.0)
        miss = F.when(size - seen > 0, (size - seen) * F.ln((size - seen) / (size * (1 - rate)))).otherwise(0.0)
        return hit + miss

    gain = part(F.col("p"), F.lit(float(positive))) + part(F.col("u"), F.lit(float(unlabelled)))
    often = counted.filter(F.col("p") + F.col("u") >= 5).select("word", F.coalesce(gain, F.lit(0.0)).alias("gain"))
    return sorted(bytes(r.word) for r in often.orderBy(F.col("gain").desc(), "word").limit(most).collect())


def presence(sample: DataFrame, words: Sequence[bytes]) -> DataFrame:
    """The flag, and which of the words each text has, as bits."""
    at = {w: i for i, w in enumerate(words)}

    @F.arrow_udf("binary")
    def bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = np.zeros((len(batch), len(at)), bool)
            for row, held in enumerate(batch):
                out[row, [at[w] for w in held.as_py() if w in at]] = True
            yield pa.array([r.tobytes() for r in np.packbits(out, axis=1)], pa.binary())

    return sample.select("positive", "id", "h", bits("words").alias("bits"))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 300, rate: float = 0.05, decay: float = 1e-4):
    """Weights and bias that lower the non-negative PU risk of the logistic loss.

    With class prior ``p`` the risk is ``p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])``.
    When the second part, the estimated risk on negatives, falls below zero it has been
    overfitted: that step then goes up its gradient instead of down the whole risk.
    """
    w, bias = np.zeros(positive.shape[1]), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        fp, fu = positive @ w + bias, unlabelled @ w + bias
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
        into_p = prior * (gp - 1 / len(fp)) - prior * gp  # of the whole risk
        if negative < 0:
            into_p, gu = prior * gp, -gu
        grad = np.append(positive.T @ into_p.astype(np.float32) + unlabelled.T @ gu.astype(np.float32) + decay * w, into_p.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


class Model:
    """Words with their weights, and a bias."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        hits = self.weights.keys() & words_of(text)
        return float(_sigmoid(self.bias + sum(self.weights[w] for w in sorted(hits))))


def train(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
    prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, vocabulary: int = VOCABULARY,
) -> Model:
    """Fit on bounded samples: confirmed toxic documents, and any documents whatever their label.

    A document is confirmed when a row of ``labels`` has toxic 1; other rows only give the
    class prior, their share of toxic ones, unless ``prior`` is set. Without a toxic row
    every score is the share 0.001. Words are found and counted where the texts are: the
    driver sees ``vocabulary`` words and that many bits of each drawn text. The caller leaves out what may not be learned from.
    """
    marks = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    marks = settle(marks)
    seen, toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return Model({}, float(np.log(0.001 / 0.999)))
    share = min(0.9, max(0.001, toxic / seen)) if prior is None else prior
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    keys = texts.select("id", "h")
    chosen = bounded_sample(marks.filter("toxic = 1").select("id"), max_positive, toxic, "id")
    positive = match(keys, chosen, ["id"], "left_semi", broadcast=True).distinct().orderBy(F.xxhash64("id"), "h").limit(max_positive)
    unlabelled = bounded_sample(keys, max_unlabelled, texts.count(), "id").distinct()
    drawn = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    drawn = settle(drawn)  # bounded, as are the two limits
    sample = match(texts, drawn, ["id", "h"], "inner", broadcast=True).select("positive", "id", "h", word_sets("text").alias("words"))
    sample = settle(sample.dropDuplicates(["positive", "id", "h"]))
    sizes = dict(sample.groupBy("positive").count().collect())
    if not (sizes.get(True) and sizes.get(False)):
        return Model({}, float(np.log(share / (1 - share))))
    words = choose_words(sample, sizes[True], sizes[False], vocabulary)
    held = {True: [], False: []}
    for r in presence(sample, words).orderBy(F.xxhash64("id"), "h", "id").collect():
        held[r.positive].append(np.unpackbits(np.frombuffer(r.bits, np.uint8), count=len(words)))
    p, u = (np.array(held[flag], np.float32).reshape(-1, len(words)) for flag in (True, False))
    w, bias = fit_nnpu(p, u, share)
    return Model(dict(zip(words, w.tolist())), bias)


def score_toxicity(documents: DataFrame, model: Model, text_column: str = "text", out: str = "score") -> DataFrame:
    """Add each whole text's score from 0 to 1; null and empty texts have the score of no words.

    Only the text counts, so repeated texts tie. A clashing column is replaced.
    """

    @F.arrow_udf("double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(t.as_py()) for t in batch], pa.float64())

    return documents.withColumn(out, udf(F.col(text_column).cast("string")))


@query("op8_toxicity")
def op8_toxicity(spark, sf):
    documents, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    held = in_fold(F.col("doc_id"), 5, 0)
    model = train(documents.filter(~held), labels.filter(~held))
    scored = score_toxicity(documents, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
