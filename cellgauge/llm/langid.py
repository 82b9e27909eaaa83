"""Language identification: a family first, then linear support vector machines inside it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.llm.common import in_fold, query, table

#: Families of closely related languages, by ISO 639-1 code; any other value is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
UNKNOWN = "und"
#: Training rows of all languages together at most, in equal shares.
MAX_ROWS = 6_000
DIMENSIONS = 4_096
PIECE = 1 << 20

_LIKE_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers such as a superscript two
_FOLD = np.array([b if b >= 0x80 or 97 <= b <= 122 else 0x20 for b in range(256)], np.uint32)


def has_letter(text: str | None) -> bool:
    """Whether a text has a character that Unicode calls a letter."""
    return text is not None and any(m[0].isalpha() for m in _LIKE_LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Square roots of a whole text's shares of hashed byte trigrams, a unit vector; lower case, letters only.

    Long texts are counted piece by piece, so memory does not grow with them.
    """
    raw = b"  " + text.lower().encode("utf-8", "replace") + b"  "
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(raw) - 2, PIECE):
        b = _FOLD[np.frombuffer(raw, np.uint8, min(PIECE + 2, len(raw) - at), at)]
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=DIMENSIONS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, *, steps: int = 150, rate: float = 0.1, decay: float = 1e-5):
    """Multinomial logistic regression by Adam on all rows."""
    w = np.zeros((x.shape[1] + 1, classes), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    goal = np.eye(classes, dtype=np.float32)[y]
    weight = (1 / np.bincount(y, minlength=classes))[y][:, None].astype(np.float32) / classes
    for step in range(1, steps + 1):
        error = (softmax(x @ w[:-1] + w[-1]) - goal) * weight
        m, v, w = _adam(np.vstack([x.T @ error + decay * w[:-1], error.sum(0)]), m, v, w, step, rate)
    return w


def fit_svm(x: np.ndarray, sign: np.ndarray, *, steps: int = 150, rate: float = 0.1, cost: float = 100.0):
    """Linear support vector machine with the squared hinge loss: weights, then the bias."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    for step in range(1, steps + 1):
        slack = np.maximum(0, 1 - sign * (x @ w[:-1] + w[-1]))
        pull = (-2 * share * sign * slack).astype(np.float32)
        m, v, w = _adam(np.append(x.T @ pull + w[:-1] / (cost * x.shape[1]), pull.sum()), m, v, w, step, rate)
    return w


def _adam(grad, m, v, w, step, rate):
    m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
    return m, v, (w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    """One classifier of families, and one machine for each pair of languages of a family."""

    families: list[list[str]]
    family_weights: np.ndarray | None
    machines: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: the family's probability times the mean of the language's pairwise ones."""
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        share = np.ones(1) if self.family_weights is None else softmax((x @ self.family_weights[:-1] + self.family_weights[-1])[None])[0]
        best = int(share.argmax())
        members = self.families[best]
        if len(members) == 1:
            return members[0], float(share[best])
        votes, odds = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            w = self.machines[a, b]
            margin = float(x @ w[:-1] + w[-1])
            p = 1 / (1 + np.exp(-4 * np.clip(margin, -10, 10)))
            votes[a if margin > 0 else b] += 1
            odds[a] += p / (len(members) - 1)
            odds[b] += (1 - p) / (len(members) - 1)
        won = max(members, key=lambda name: (votes[name], odds[name], name))
        return won, float(min(1.0, share[best] * odds[won]))


def fit(texts: list[str], langs: list[str], families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Families and machines from labelled texts; rows without a letter are left out."""
    rows = [(t, y) for t, y in zip(texts, langs) if has_letter(t)]
    x = np.empty((len(rows), DIMENSIONS), np.float32)
    for i, (text, _) in enumerate(rows):
        x[i] = features(text)
    return fit_features(x, [y for _, y in rows], families)


def fit_features(x: np.ndarray, langs: list[str], families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Families and machines from one row of features a text."""
    if not langs:
        return Model([], None, {})
    family_of = {code: name for name, codes in families.items() for code in codes}
    names = sorted(set(langs))
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(family_of.get(name, f"only {name}"), []).append(name)
    members = [groups[g] for g in sorted(groups)]
    y = np.array(langs)
    place = {name: i for i, group in enumerate(members) for name in group}
    weights = fit_softmax(x, np.array([place[name] for name in y]), len(members)) if len(members) > 1 else None
    machines = {}
    for group in members:
        for a, b in combinations(group, 2):
            both = (y == a) | (y == b)
            machines[a, b] = fit_svm(x[both], np.where(y[both] == a, 1.0, -1.0))
    return Model(members, weights, machines)


def pack(x: np.ndarray) -> bytes:
    """The places of the features that are not 0, then their values: under 25 KB however long the text."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def unpack(packed: bytes, out: np.ndarray) -> None:
    n = len(packed) // 6
    out[np.frombuffer(packed, "<u2", n)] = np.frombuffer(packed, "<f4", n, 2 * n)


@F.arrow_udf(T.BinaryType())
def packed_features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Packed features; null for texts without a letter."""
    for batch in texts:
        yield pa.array([pack(features(t)) if has_letter(t) else None for t in (v.as_py() for v in batch)], pa.binary())


def train(documents: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", *, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` rows with text and lang, in equal shares for each language.

    Features are made where the texts are; the driver sees ``max_rows`` packed rows of them,
    and a count for every language.
    """
    known = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"))
    known = known.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return fit([], [])
    each = max(1, max_rows // len(counts))
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.1 * (each + 20) / r["count"]))])
    order = F.xxhash64("id", F.lit("sample"))
    thinned = known.filter(F.pmod(order, F.lit(1 << 40)) < F.element_at(shares, F.col("lang")) * (1 << 40))
    drawn = thinned.select("lang", "id", order.alias("order"), packed_features("text").alias("features"))
    first = Window.partitionBy("lang").orderBy("order", "id")
    chosen = drawn.withColumn("number", F.row_number().over(first)).filter(F.col("number") <= each)
    rows = [r for r in chosen.orderBy("order", "id").select("lang", "features").collect() if r.features is not None]
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for place, row in zip(x, rows):
        unpack(row.features, place)
    return fit_features(x, [r.lang for r in rows])


def identify(documents: DataFrame, model: Model, text_column: str = "text", out: str = "language") -> DataFrame:
    """Add a struct (lang, score) for every whole text; ``und`` and 0 for null texts and texts without a letter.

    Only the text counts, so repeated rows repeat their result. A model of an empty table
    calls everything ``und``. A clashing column is replaced.
    """

    @F.arrow_udf("struct<lang:string,score:double>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"]
            )

    return documents.withColumn(out, udf(F.col(text_column).cast("string")))


@query("op1_language_id")
def op1_language_id(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held = in_fold(F.col("doc_id"), 4, 2)
    model = train(documents.filter(~held))
    return identify(documents, model).select(
        "doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )
