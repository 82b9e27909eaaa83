"""Importance resampling towards a target distribution, with Arrow kernels over whole batches."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.llm.common import fresh, query, table
from cellgauge.plans import scale

#: What stands between words once A-Z is lower-cased: ASCII that is neither digit nor a-z.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
SLICE_BYTES = 4 << 20  # text that the kernels take at a time; a longer text is a slice of its own
H_RANGE = 4294967296  # values of the eight hex digits that a draw is made from


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive pieces of a text column of about ``most`` bytes, whole texts each, with where they start."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        upto = max(upto, at + 1)
        yield at, texts.slice(at, upto - at)
        at = upto


def feature_buckets(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of every text, and for runs of 1 to ``longest`` words the text and bucket of each occurrence.

    Words are encoded by a dictionary; a run of k words is its first k - 1 words, already
    numbered, beside the next index. Only distinct pairs are hashed: the checksum of the
    shorter run goes on over a space and the next word.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=SEPARATOR)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(real), owner.filter(real).to_numpy()
    n_words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    coded = words.dictionary_encode()
    index, vocabulary = coded.indices.to_numpy(), [w.encode() for w in coded.dictionary.to_pylist()]
    runs = []
    number = index.astype(np.int64)
    crc = np.fromiter((zlib.crc32(w) for w in vocabulary), np.int64, len(vocabulary))
    for k in range(1, longest + 1):
        if k > 1:
            inside = owner[k - 1 :] == owner[: max(0, len(owner) - k + 1)]  # the run does not leave its text
            pair = number[: len(inside)] * max(1, len(vocabulary)) + index[k - 1 :]
            distinct, place = np.unique(pair[inside], return_inverse=True)
            number = np.zeros(len(inside), np.int64)
            number[inside] = place
            first, last = np.divmod(distinct, max(1, len(vocabulary)))
            crc = np.fromiter((zlib.crc32(b" " + vocabulary[b], int(crc[a])) for a, b in zip(first, last)), np.int64, len(distinct))
            at = np.flatnonzero(inside)
        else:
            at = np.arange(len(index))
        runs.append((owner[at], pc.take(pa.array(crc % buckets), pa.array(number[at])).to_numpy()))
    return n_words, runs


def bucket_counts(texts: DataFrame, text_column: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of a whole table by bucket. Each task adds up its own; ``buckets`` rows reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in slices(batch.column(0)):
                for _, bucket in feature_buckets(some, longest, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    parts = texts.select(F.col(text_column).cast("string")).mapInArrow(counted, "bucket bigint, n bigint")
    total = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, each count raised by one, rounded down."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    gain = lambda s, t: math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
    return np.array([gain(s, t) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(
    documents: DataFrame, gains: np.ndarray, text_column: str = "text", *, longest: int = LONGEST, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add n_words, n_features and weight, the sum of the gains of a text's features; ``keep`` names the other columns.

    A null text has no words, a text without words the weight 0. Clashing columns are replaced.
    """
    new = ["n_words", "n_features", "weight"]
    kept = [c for c in (documents.columns if keep is None else keep) if c.lower() not in new]
    text, = fresh(documents, "text_to_weigh")
    shared = documents.sparkSession.sparkContext.broadcast(pa.array(gains))  # one number a bucket

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value
        for batch in batches:
            for at, some in slices(batch.column(len(kept))):
                n_words, runs = feature_buckets(some, longest, len(values))
                n_features, weight = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
                for owner, bucket in runs:
                    ends = np.cumsum(np.bincount(owner, minlength=len(some)))
                    upto = np.concatenate([[0], np.cumsum(pc.take(values, pa.array(bucket)).to_numpy())])
                    starts = np.concatenate([[0], ends[:-1]])
                    weight += upto[ends] - upto[starts]
                    n_features += ends - starts
                columns = [pa.array(n_words), pa.array(n_features), pa.array(weight)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(some)).columns[: len(kept)], *columns], [*kept, *new])

    schema = T.StructType([*[documents.schema[c] for c in kept], *[T.StructField(n, T.LongType()) for n in new]])
    return documents.select(*kept, F.col(text_column).cast("string").alias(text)).mapInArrow(weighed, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that only the seed and the id decide; a null id counts as the text ''."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(float(H_RANGE)))))


def resample(
    documents: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
    longest: int = LONGEST, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Draw ``percent`` of the documents, likelier the more they read like ``target``, without replacement.

    Counts features of both tables by hashed bucket, gives each document the sum of its
    features' gains and adds a Gumbel draw, which makes the highest scores a draw in
    proportion to the weights. Adds n_words, n_features, weight, score and rank (1, 2, 3 ...
    among the drawn, null for the others) to the columns ``keep`` (default: all but the
    text). Each row is a document; null and wordless texts weigh 0 and, as all with fewer
    than ``min_words`` words, are not drawn. Equal scores are drawn by the smaller id (a null
    id first), then by a hash of the row. Empty tables give empty tables or gains of an
    empty target. Clashing columns are replaced.

    Three passes over the texts and none of them moves: what is shuffled are bucket counts,
    then one row of numbers a document, by ranges of the score.
    """
    kept = [c for c in documents.columns if c != text_column] if keep is None else list(keep)
    kept = [c for c in kept if c.lower() not in ("n_words", "n_features", "weight", "score", "rank")]
    gains = bucket_gains(bucket_counts(documents, text_column, longest, buckets), bucket_counts(target, text_column, longest, buckets))
    key, ready, place = fresh(documents, "resample_id", "resample_ready", "resample_place")
    keyed = documents.withColumn(key, F.col(id_column))
    rows = weigh(keyed, gains, text_column, longest=longest, keep=[*kept, key])
    rows = rows.withColumn("score", F.col("weight") + noise(F.col(key), seed)).withColumn(ready, F.col("n_words") >= min_words)
    rows = scale.settle(rows)  # a range shuffle reads its input twice
    numbered = scale.number_rows(rows, [F.col(ready).desc(), F.col("score").desc(), F.col(key).asc_nulls_first()], place)
    drawn = numbered.filter(ready).count() * percent // 100
    rank = F.when(F.col(place) <= drawn, F.col(place))
    return numbered.select(*kept, "n_words", "n_features", "weight", "score", rank.alias("rank"))


SQL = r"""
WITH RECURSIVE
crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
words AS (SELECT 0 AS kind, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL SELECT 1, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
bytes AS (SELECT word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT word FROM words)),
coded AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c // 256))) % 10000 AS bucket FROM bytes, crc_table),
found AS (SELECT kind, id, bucket FROM words JOIN coded USING (word)),
held AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM found GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM held),
summed AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM found JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM documents LEFT JOIN summed ON id = doc_id),
placed AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS ready FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= ready * 10 // 100 THEN place END::BIGINT AS rank FROM placed
"""


@query("op13_target_resampling", SQL)
def op13_target_resampling(spark, sf):
    drawn = resample(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("text"), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
