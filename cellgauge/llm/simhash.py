"""SimHash near-duplicates: fingerprints, a binary trie self-join, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import LOWER, UPPER, fresh, query, table
from cellgauge.llm.components import connected_components
from cellgauge.plans.scale import match, settle

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints of one block and rotation that one trie may hold; more are cut by further bits.
TRIE_ROWS = 8192
#: Node pairs or leaf pairs expanded at once.
STEP = 1 << 20

_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


# --------------------------------------------------------------------------
# Fingerprints
# --------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 values of a text's word shingles, repeats included."""
    import xxhash

    words = text.translate(_TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    values = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)]), np.uint8).reshape(-1, 8)
    bits = 0
    for k in range(8):  # byte k of the digest, the highest first
        ones = np.bincount(values[:, k], minlength=256) @ _BITS
        for j in np.flatnonzero(2 * ones > len(values)):
            bits |= 1 << (8 * (7 - k) + int(j))
    return bits


def fingerprints(documents: DataFrame, text_column: str = "text", out: str = "fp", *, shingle: int = SHINGLE) -> DataFrame:
    """Add the signed 64-bit fingerprint of every whole text; 0 for null texts and texts without words.

    Words are runs of other bytes than the space and 9 to 13, A-Z lower-cased. Long
    texts are taken one at a time, so memory is bounded by an Arrow batch and one text.
    """

    @F.arrow_udf("bigint")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = (fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.cast(pa.binary()))
            yield pa.array(np.fromiter(made, np.uint64, len(batch)).view(np.int64))

    return documents.withColumn(out, udf(F.col(text_column).cast("string")))


# --------------------------------------------------------------------------
# Trie self-join
# --------------------------------------------------------------------------


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_pairs(values: np.ndarray, groups: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one group whose distinct, per group ascending values differ in ``max_bits`` bits at most.

    A node of the binary trie is a range of the sorted values that share their leading
    bits. Node pairs go down together: a pair's differing bits add up, and it is dropped
    once they exceed the budget. A pair of few leaves is compared value by value. The
    pending pairs are a stack worked off in bounded steps.
    """
    cuts = np.flatnonzero(np.diff(groups)) + 1
    lo = np.concatenate(([0], cuts)).astype(np.int64)
    hi = np.concatenate((cuts, [len(values)])).astype(np.int64)
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int64), 63)]
    while stack:
        alo, ahi, blo, bhi, diff, bit = stack.pop()
        if len(alo) > STEP:
            half = len(alo) // 2
            stack.append((alo[half:], ahi[half:], blo[half:], bhi[half:], diff[half:], bit))
            stack.append((alo[:half], ahi[:half], blo[:half], bhi[:half], diff[:half], bit))
            continue
        small = ((ahi - alo) * (bhi - blo) <= 16) | (bit < 0)
        if small.any():
            yield from _leaf_pairs(values, alo[small], ahi[small], blo[small], bhi[small], max_bits)
            alo, ahi, blo, bhi, diff = alo[~small], ahi[~small], blo[~small], bhi[~small], diff[~small]
        if not len(alo):
            continue
        amid, bmid = _middles(values, alo, ahi, bit), _middles(values, blo, bhi, bit)
        same = alo == blo  # a node with itself: its two children cross once
        children = [
            (alo, amid, blo, bmid, diff, np.ones(len(alo), bool)), (amid, ahi, bmid, bhi, diff, np.ones(len(alo), bool)),
            (alo, amid, bmid, bhi, diff + 1, np.ones(len(alo), bool)), (amid, ahi, blo, bmid, diff + 1, ~same),
        ]
        parts = []
        for a, b, c, d, e, wanted in children:
            ok = wanted & (b > a) & (d > c) & (e <= max_bits) & ~((a == c) & (b - a == 1))
            parts.append((a[ok], b[ok], c[ok], d[ok], e[ok]))
        joined = [np.concatenate(x) for x in zip(*parts)]
        if len(joined[0]):
            stack.append((*joined, bit - 1))


def _middles(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First index of each range whose value has the bit, by a binary search of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    mask = np.uint64(1 << bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        up = open_ & ((values[np.minimum(mid, len(values) - 1)] & mask) == 0)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def _leaf_pairs(values, alo, ahi, blo, bhi, max_bits):
    sizes = (ahi - alo) * (bhi - blo)
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):  # a bounded number of value pairs at a time
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 4 * STEP, "right")))
        n = sizes[at:end]
        which = np.repeat(np.arange(at, end), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (bhi - blo)[which]
        a, b = alo[which] + k // width, blo[which] + k % width
        ok = (a < b) | (alo[which] != blo[which])
        ok[ok] = _popcount(values[a[ok]] ^ values[b[ok]]) <= max_bits
        yield a[ok], b[ok]
        at = end


class _Forest:
    """Union-find over the indexes of one task; lower roots win."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.root[x]
        while ((up := self.root[root]) != root).any():
            root = up
        return root


def _linked(frames: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    """Per key (rows come sorted by key and value): the links of its trie, as a spanning forest."""
    held = None

    def solve(frame):
        values = frame["turned"].to_numpy().view(np.uint64)
        keys = frame["key"].to_numpy()
        order = np.lexsort((values, keys))
        values, keys, real = values[order], keys[order], frame["fp"].to_numpy()[order]
        once = np.concatenate(([True], (values[1:] != values[:-1]) | (keys[1:] != keys[:-1])))
        values, keys, real = values[once], keys[once], real[once]
        forest = _Forest(len(values))
        for a, b in trie_pairs(values, keys, max_bits):
            forest.add(a, b)
        top = forest.find(np.arange(len(values)))
        moved = top != np.arange(len(values))
        return pd.DataFrame({"a": real[moved], "b": real[top[moved]]})

    for frame in frames:
        if not len(frame):
            continue
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = held["key"].iloc[-1]
        if held["key"].iloc[0] != last and len(held) >= TRIE_ROWS:
            done = (held["key"] != last).to_numpy()
            yield solve(held[done])
            held = held[~done].reset_index(drop=True)
    if held is not None:
        yield solve(held)


def hamming_links(values: DataFrame, column: str = "fp", *, max_bits: int = MAX_BITS, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Links (a, b) between distinct 64-bit values; their components are those of all pairs within ``max_bits``.

    Of ``max_bits + 1`` blocks of bits at least one is equal in such a pair. So the trie
    is built once for each block, rotated to lead, and its upper levels, where no bit may
    differ, are Spark's shuffle by that block. Below, tasks traverse node pairs. A block
    value with more than ``trie_rows`` values is cut by its next bits into nodes, and
    each node meets those within the budget. Tasks return a spanning forest of the links
    they find, so a dense group gives no more rows than it has members. Nulls are left
    out; an empty table gives no links.
    """
    blocks = max_bits + 1
    width = 64 // blocks
    one = values.select(F.col(column).alias("fp")).filter(F.col(column).isNotNull()).distinct()

    def turn(r):
        k = r * width
        return F.col("fp") if k == 0 else F.shiftleft("fp", k).bitwiseOR(F.shiftrightunsigned("fp", 64 - k))

    turned = one.select("fp", F.posexplode(F.array(*[turn(r) for r in range(blocks)])).alias("r", "turned"))
    turned = turned.withColumn("block", F.shiftrightunsigned("turned", 64 - width))
    # at most blocks * 2^width sizes, only those above the bound are kept; both are known before the broadcast
    large = turned.groupBy("r", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > trie_rows)
    large = settle(large.select("r", "block", F.least(F.ceil(F.log2(F.col("n") / trie_rows)) + 2, F.lit(12)).cast("int").alias("cut")))
    few = large.count() <= 1 << 18
    sized = match(turned, large, ["r", "block"], "left", broadcast=few)
    cut = F.coalesce(F.col("cut"), F.lit(0))
    node = F.expr(f"shiftrightunsigned(shiftleft(turned, {width}), 64 - coalesce(cut, 1))")
    masks = F.expr("filter(sequence(0, (1 << cut) - 1), m -> bit_count(m) <= %d)" % max_bits)
    # a node and its partner by mask m share one key: the smaller of both, and m
    partner = F.explode(F.when(cut == 0, F.array(F.lit(0))).otherwise(masks)).alias("mask")
    keyed = sized.select("fp", "turned", "r", "block", F.when(cut == 0, F.lit(0).cast("long")).otherwise(node).alias("node"), partner)
    key = F.xxhash64("r", "block", F.least("node", F.col("node").bitwiseXOR(F.col("mask").cast("long"))), "mask")
    spread = keyed.select(key.alias("key"), "turned", "fp").repartition("key").sortWithinPartitions("key")
    return spread.mapInPandas(lambda it: _linked(it, max_bits), "a bigint, b bigint")


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """Every input row with ``fp`` and ``component_id``, the smallest id that links of ``max_bits`` or fewer reach.

    Equal texts share a fingerprint and are one value of the join. Rows without words have
    fingerprint 0, linked like any other. Repeated ids are separate rows; a null id is
    never the smallest, and a component of null ids only has a null component. Other
    columns stay; clashing ones are replaced. Fingerprints, forests and components are
    tables of the shared folder; none passes through the driver.
    """
    rows = documents.drop("fp", "component_id")
    marked = settle(fingerprints(rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), shingle=shingle).select("id", "fp"))
    return _with_components(marked, max_bits)


def _with_components(marked: DataFrame, max_bits: int) -> DataFrame:
    least = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(hamming_links(marked, max_bits=max_bits), "a", "b")
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = settle(named)
    top = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(top, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(*marked.columns, "component_id")


def keep_first(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows whose id is their component's smallest; rows with a null id stay.

    Of repeated rows with that id all stay, as they are one document. Rows of one id and
    different texts are told apart by a hash of the text.
    """
    text = F.col(text_column).cast("string")
    rows = documents.select(F.col(id_column).alias("id"), text.alias("text"), F.xxhash64(text).alias("row_hash"))
    marked = settle(fingerprints(rows, shingle=shingle).select("id", "row_hash", "fp"))
    later, hashed = fresh(documents, "later_id", "later_hash")
    groups = _with_components(marked, max_bits).filter(F.col("id") != F.col("component_id"))
    gone = groups.select(F.col("id").alias(later), F.col("row_hash").alias(hashed)).distinct()
    return documents.join(gone, (F.col(id_column) == F.col(later)) & (F.xxhash64(text) == F.col(hashed)), "left_anti")


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark, sf):
    groups = near_duplicates(table(spark, sf, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
