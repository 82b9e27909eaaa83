"""Line deduplication across documents, in native columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import SPACE, ascii_lower, fresh, query, table
from cellgauge.plans.scale import BROADCAST_BYTES, settle_observed

MIN_DOCS = 10
MIN_CHARS = 1
KEY_BYTES = 64  # of a frequent key where it is sent
SALTS = 32  # tasks that share a frequent line when there are too many to send


def line_keys(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Array with one 96-bit key per line; null for lines shorter than ``min_chars`` once normalised."""

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    # one step for each transform: inside a lambda an expression used twice runs twice
    trimmed = F.transform(lines, lambda line: F.btrim(line, F.lit(SPACE)))
    plain = F.transform(trimmed, ascii_lower)
    key = lambda line: F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))
    return F.transform(plain, lambda line: F.when(F.length(line) >= min_chars, key(line)))


def dedup_lines(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    *,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Drop every line whose normalised key occurs in ``min_docs`` rows or more.

    Lines are split at ``\\n``; the key is the line without white space at both ends,
    A-Z lower-cased, hashed to 96 bits. Adds ``kept_text``, ``n_lines`` (before) and
    ``n_dropped``; a clashing input column is replaced. Each input row is one
    document, repeated ids too. Null and empty texts have one empty line, which is
    kept when ``min_chars`` is 1 or more. An empty table gives an empty table.

    Keys are counted with a map-side combine and the frequent ones settled. While their
    counted size allows it they go to the lines, so that no line meets its like in one
    task; beyond that only (row, position, key) moves for a semi join, salted by row so
    that a line of a third of all rows is spread. Texts move once, to meet their dropped
    positions.
    """
    rows = documents.drop("kept_text", "n_lines", "n_dropped")
    rid, tid, keys, pos, key, drop = fresh(rows, "row_id", "row_hash", "line_keys", "line_pos", "line_key", "line_drop")
    text = F.col(text_column)
    # rows of equal id and text share their positions, so this pair is all the identity that is needed
    keyed = rows.select(F.col(id_column).alias(rid), F.xxhash64(text).alias(tid), line_keys(text, min_chars).alias(keys))
    frequent = (
        keyed.select(F.explode_outer(F.array_distinct(keys)).alias(key))
        .filter(F.col(key).isNotNull())
        .groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs).select(key)
    )
    frequent, seen = settle_observed(frequent, rows=F.count(F.lit(1)))
    places = keyed.select(rid, tid, F.posexplode_outer(keys).alias(pos, key)).filter(F.col(key).isNotNull())
    if seen["rows"] * KEY_BYTES <= BROADCAST_BYTES:
        found = places.join(F.broadcast(frequent), key, "left_semi")
    else:
        salt, = fresh(rows, "line_salt")
        salted = frequent.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = places.withColumn(salt, F.pmod(F.hash(rid, tid), F.lit(SALTS))).join(salted, [key, salt], "left_semi")
    hits = found.groupBy(rid, tid).agg(F.collect_set(pos).alias(drop))
    same = F.col(id_column).eqNullSafe(F.col(rid)) & (F.xxhash64(text) == F.col(tid))
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    joined = rows.join(hits, same, "left")
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    kept = F.array_join(F.transform(kept_at, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        *rows.columns,
        F.when(F.col(drop).isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop)).cast("long").alias("n_dropped"),
    )


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key AS often FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(often)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = often GROUP BY doc_id
"""


@query("op7_line_dedup", SQL)
def op7_line_dedup(spark, sf):
    kept = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
