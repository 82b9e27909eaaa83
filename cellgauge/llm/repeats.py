"""Exact repeated byte strings: anchored contexts, shard Burrows-Wheeler transforms, interleave refinement."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import fresh, query, table

LENGTH = 200
#: Bytes of an anchor; every string of LENGTH bytes holds at least one.
ANCHOR = 140
#: Bits of the two filters that thin anchors inside the scan: 16 MB each, whatever the input.
FILTER_BITS = 27
#: Bytes of text for each bucket of anchors; their number follows the input.
BUCKET_BYTES = 8 << 20
#: Contexts of one anchor that one merge takes; those of a more frequent anchor are compared window by window.
HOT_CONTEXTS = 200_000
#: Contexts of one anchor that one batch reports when anchors are counted; more are reported as a number.
REPORTED = 16
#: Symbols merged at once, and the shards they are cut into.
MERGE_SYMBOLS = 1 << 17
SHARDS = 2
PIECE = 1 << 22
#: Anchors a task holds before it sends them on.
SENT_ANCHORS = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Shape:
    """Lengths of a repeat and of an anchor; a context reaches ``margin`` bytes beyond the anchor on both sides."""

    length: int = LENGTH
    anchor: int = ANCHOR

    @property
    def margin(self) -> int:
        return self.length - self.anchor


class Rolling:
    """Polynomial hashes modulo 2^64 of any part of a text, independent of where it stands."""

    up = _powers(_BASE, 1 << 16)
    down = _powers(pow(_BASE, -1, 1 << 64), 1 << 16)

    @classmethod
    def reach(cls, n: int) -> None:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)

    def __init__(self, raw: np.ndarray):
        self.reach(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.up[: len(raw)], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        return _mix((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])

    def parts(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Places, anchor hashes, context hashes and the contexts' bytes on the left and right, place by place.

    Every string of ``length`` bytes picks, of the anchors in it, the one with the least
    hash (40 bits; the leftmost among equals). Equal strings pick the same place, so
    repeats can be sought among places with equal anchors only, without loss.
    """
    n, m = len(raw), shape.margin
    found = []
    for begin in range(0, max(0, n - shape.length + 1), PIECE):
        lo, hi = max(0, begin - m), min(n, begin + PIECE + shape.length - 1 + m)
        roll = Rolling(raw[lo:hi])
        hashes = roll.every(shape.anchor)
        first = begin - lo
        keys = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        last = min(begin + PIECE, n - shape.length + 1) - lo + m  # of the anchors of this piece's strings
        least = _sliding_least(keys[first : last], m + 1)
        at = np.unique(least[np.concatenate(([True], least[1:] != least[:-1]))] & np.uint64((1 << 24) - 1)).astype(np.int64)
        left, right = np.minimum(m, at + lo), np.minimum(m, n - (at + lo) - shape.anchor)
        context = roll.parts(at - left, at + shape.anchor + right) ^ (left * 1000 + right).astype(np.uint64)
        # least hashes are small ones: mixed again, their leading bits are even
        found.append((at + lo, _mix(hashes[at] * np.uint64(_BASE)), context, left, right))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    out = [np.concatenate(x) for x in zip(*found)]
    if len(found) > 1:
        _, once = np.unique(out[0], return_index=True)
        out = [x[once] for x in out]
    return tuple(out)


# --------------------------------------------------------------------------
# Shard transforms and their merge
# --------------------------------------------------------------------------


def shard_order(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sorted rotations of a shard's strings, by prefix doubling; equal rotations in the strings' order."""
    n = len(symbols)
    which = np.repeat(np.arange(len(starts)), lengths)
    start, size = starts[which], lengths[which]
    inside = np.arange(n) - start
    rank, step, longest = symbols.astype(np.int64), 1, int(lengths.max(initial=1))
    while True:
        other = rank[start + (inside + step) % size]
        key = rank * (int(rank.max()) + 2) + other
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([False], key[order[1:]] != key[order[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
        if step >= longest or rank[order[-1]] == n - 1:
            return order  # the sort is stable and rotations come string by string


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' sorted rotations by their first ``depth`` symbols, and common prefixes.

    The interleave starts as the shards one after the other. A round reads the transforms
    in the present interleave and deals its entries out by their symbol, in order: what
    was right for h symbols is right for h + 1, and no suffix is compared or sorted. Where
    neighbours first fall apart in round h they share h - 1 symbols; ``depth`` where they
    never do. Returns the shard of each merged rank, and the common prefix with the rank before.
    """
    narrow = np.uint8 if all(t.dtype == np.uint8 for t in transforms) else np.uint16
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    common = np.full(len(shard), depth, np.int32)
    block = np.zeros(len(shard), np.int32)
    symbol = np.empty(len(shard), narrow)
    for h in range(1, depth + 1):
        for s, transform in enumerate(transforms):
            symbol[shard == s] = transform
        order = np.argsort(symbol, kind="stable")
        shard, moved, symbols = shard[order], block[order], symbol[order]
        apart = np.empty(len(shard), bool)
        apart[:1] = True
        apart[1:] = (moved[1:] != moved[:-1]) | (symbols[1:] != symbols[:-1])
        common[apart & (common == depth)] = h - 1
        np.cumsum(apart, out=block)
    common[np.flatnonzero(np.diff(block) == 0) + 1] = depth
    return shard, common


def repeated_starts(contexts: list[bytes], left: np.ndarray, groups: np.ndarray, shape: Shape, shards: int = SHARDS) -> list[np.ndarray]:
    """For each context, how far left of its anchor the strings start that another context of its group has too.

    A context is what stands left and right of an anchor, ``left`` bytes of it on the left.
    The anchor, equal within a group, is a single symbol. The strings are dealt to shards,
    each shard's transform is built by itself, and the transforms are merged.
    """
    n, depth = len(contexts), shape.margin + 1
    lengths = np.fromiter(map(len, contexts), np.int64, n) + 2
    starts = np.cumsum(lengths) - lengths
    body = np.frombuffer(b"".join(contexts), np.uint8)
    kind = np.uint8 if not len(body) or body.max() < 0xFE else np.uint16
    anchor, end = (0xFF, 0xFE) if kind == np.uint8 else (0x101, 0x100)
    flat = np.empty(int(lengths.sum()), kind)
    plain = np.ones(len(flat), bool)
    plain[starts + left] = plain[starts + lengths - 1] = False
    flat[plain] = body
    flat[starts + left], flat[starts + lengths - 1] = anchor, end
    which = np.repeat(np.arange(n), lengths)
    inside = np.arange(len(flat)) - starts[which]

    cuts = np.linspace(0, n, min(shards, max(n, 1)) + 1).astype(int)
    sorted_, transforms = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo, hi = int(starts[a]), int(starts[b - 1] + lengths[b - 1])
        order = lo + shard_order(flat[lo:hi], starts[a:b] - lo, lengths[a:b])
        sorted_.append(order)
        before = starts[which[order]] + (inside[order] - 1) % lengths[which[order]]
        transforms.append(flat[before])
    shard, common = merge_transforms(transforms, depth)
    suffix = np.empty(len(flat), np.int64)
    suffix[np.argsort(shard, kind="stable")] = np.concatenate(sorted_)

    # repeated intervals: runs of ranks that share ``depth`` symbols with the rank before
    interval = np.cumsum(common < depth)
    owner, reach = which[suffix], left[which[suffix]] - inside[suffix]
    right = lengths[owner] - 2 - left[owner]
    whole = (reach >= 0) & (shape.margin - reach <= right)
    interval, owner, reach = interval[whole], owner[whole], reach[whole]
    key = interval * (int(groups.max(initial=0)) + 1) + groups[owner]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    owner, reach = owner[twice], reach[twice]
    order = np.lexsort((reach, owner))
    return np.split(reach[order], np.searchsorted(owner[order], np.arange(1, n)))


# --------------------------------------------------------------------------
# Spark plan
# --------------------------------------------------------------------------


def _bytes(array: pa.Array) -> Iterator[np.ndarray]:
    for t in array.cast(pa.binary()):
        yield np.frombuffer(t.as_buffer() if t.is_valid else b"", np.uint8)


def _count_batch(hashes: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, context) pairs and their counts, capped at REPORTED for a hash; the rest is one entry with context 0."""
    order = np.lexsort((contexts, hashes))
    h, c = hashes[order], contexts[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    h, c = h[at], c[at]
    first = np.searchsorted(h, h, "left")
    nth = np.arange(len(h)) - first
    over = nth >= REPORTED
    if over.any():
        rest_h, rest_at = np.unique(h[over], return_inverse=True)
        rest_n = np.bincount(rest_at)
        h, c, count = np.concatenate((h[~over], rest_h)), np.concatenate((c[~over], np.zeros(len(rest_h), np.uint64))), np.concatenate((count[~over], rest_n))
    return h, c, np.minimum(count, 2**31 - 1)


@dataclass(frozen=True)
class _Buckets:
    order: np.ndarray
    ranges: list[tuple[int, int, int]]


def _by_bucket(bucket: np.ndarray) -> _Buckets:
    """An order by bucket, and (bucket, first, last + 1) in it."""
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    cuts = np.append(at, len(bucket)).tolist()
    return _Buckets(order, list(zip(found.tolist(), cuts[:-1], cuts[1:])))


def _by_anchors(made: Iterator[tuple], most: int = SENT_ANCHORS) -> Iterator[list[tuple]]:
    """Texts' arrays in lists of about ``most`` anchors, which bounds what a task holds."""
    held, size = [], 0
    for one in made:
        if len(one[0]):
            held.append(one)
            size += len(one[0])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _record(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    """Rows of a bucket number and byte strings."""
    kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], list(names))


def _low_bytes(values: np.ndarray, keep: int) -> bytes:
    """The ``keep`` high bytes of 64-bit numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - keep :]).tobytes()


def _from_bytes(raw: bytes, keep: int) -> np.ndarray:
    out = np.zeros((len(raw) // keep, 8), np.uint8)
    out[:, 8 - keep :] = np.frombuffer(raw, np.uint8).reshape(-1, keep)
    return out.view("<u8").ravel()


class Filters:
    """Bits of the anchors found twice, of those with more than one context, and the very frequent ones."""

    def __init__(self, twice: np.ndarray, mixed: np.ndarray, hot: np.ndarray):
        self.twice, self.mixed, self.hot = twice, mixed, hot

    @staticmethod
    def _bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - FILTER_BITS)
        return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0

    def is_twice(self, hashes):
        return self._bit(self.twice, hashes)

    def is_mixed(self, hashes):
        return self._bit(self.mixed, hashes)

    def is_hot(self, hashes):
        return np.isin(hashes >> np.uint64(24), self.hot) if len(self.hot) else np.zeros(len(hashes), bool)


def count_anchors(texts: DataFrame, column: str, shape: Shape, bucket_bits: int, hot_contexts: int) -> Filters:
    """One pass over the texts: which anchors occur twice, which in several contexts, which very often.

    Batches send their distinct anchors (40 bits) with contexts (48 bits) to buckets by
    the hash's leading bits, a bounded number for each anchor. Buckets return their part
    of two bit maps of fixed size, and the anchors with more than ``hot_contexts``
    contexts, of which there are at most that many times fewer than contexts.
    """
    shift = np.uint64(64 - bucket_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _by_anchors((anchors(raw, shape)[1:3] for batch in batches for raw in _bytes(batch.column(0)))):
            h, c, n = _count_batch(*(np.concatenate(x) for x in zip(*made)))
            # the lowest bit of a context tells whether it came twice; 0 stands for "more of them"
            c = np.where(c == 0, np.uint64(0), (c >> np.uint64(16) | np.uint64(2)) & ~np.uint64(1) | (n > 1).astype(np.uint64)) << np.uint64(16)
            parts = _by_bucket(h >> shift)
            h, c, n = h[parts.order], c[parts.order], n[parts.order]
            rows = [(b, _low_bytes(h[x:y], 5), _low_bytes(c[x:y], 6), n[x:y][c[x:y] == 0].astype("<i4").tobytes()) for b, x, y in parts.ranges]
            yield _record(rows, ("bucket", "h", "c", "n"))

    def settle_bucket(found: pa.Table) -> pa.Table:
        bucket = found["bucket"][0].as_py()
        parts = found.to_pylist()
        h = np.concatenate([_from_bytes(p["h"], 5) for p in parts])
        c = np.concatenate([_from_bytes(p["c"], 6) for p in parts]) >> np.uint64(16)
        more = np.zeros(len(h), np.int64)
        more[c == 0] = np.concatenate([np.frombuffer(p["n"], "<i4") for p in parts])
        order = np.lexsort((c, h))
        h, c, more = h[order], c[order], more[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        entries = np.diff(np.append(at, len(h)))
        plain = c >> np.uint64(1)
        least, most = np.minimum.reduceat(plain, at), np.maximum.reduceat(plain, at)
        twice = (entries > 1) | np.bitwise_or.reduceat((c & np.uint64(1)).astype(bool) | (more > 0), at)
        several = (least != most) | (np.add.reduceat(more, at) > 0)
        fresh_context = np.concatenate(([True], (h[1:] != h[:-1]) | (plain[1:] != plain[:-1])))
        hot = np.add.reduceat(fresh_context.astype(np.int64) + more, at) > hot_contexts
        keys = h[at]
        size = 1 << (FILTER_BITS - bucket_bits)
        place = ((keys >> np.uint64(64 - FILTER_BITS)) & np.uint64(size - 1)).astype(np.int64)
        maps = []
        for chosen in (twice, several):
            bits = np.zeros(size, bool)
            bits[place[chosen]] = True
            maps.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "twice": [maps[0]], "mixed": [maps[1]], "hot": [(keys[hot] >> np.uint64(24)).astype("<u8").tobytes()]})

    sent = texts.select(F.col(column).cast("string")).mapInArrow(send, "bucket int, h binary, c binary, n binary")
    found = sent.groupBy("bucket").applyInArrow(settle_bucket, "bucket int, twice binary, mixed binary, hot binary").collect()
    size = (1 << (FILTER_BITS - bucket_bits)) // 8
    twice, mixed, hot = np.zeros(1 << (FILTER_BITS - 3), np.uint8), np.zeros(1 << (FILTER_BITS - 3), np.uint8), []
    for r in found:
        part = slice(r["bucket"] * size, (r["bucket"] + 1) * size)
        twice[part], mixed[part] = np.frombuffer(r["twice"], np.uint8), np.frombuffer(r["mixed"], np.uint8)
        hot.append(np.frombuffer(r["hot"], "<u8"))
    return Filters(twice, mixed, np.sort(np.concatenate(hot)) if hot else np.zeros(0, np.uint64))


_SENT = ("bucket", "h", "c", "many", "left", "right", "body")


def _ranges(reach: np.ndarray) -> list[tuple[int, int]]:
    """Ascending numbers as [first, last] runs."""
    cuts = np.flatnonzero(np.diff(reach) > 1)
    return list(zip(reach[np.append(0, cuts + 1)].tolist(), reach[np.append(cuts, len(reach) - 1)].tolist()))


def context_repeats(texts: DataFrame, column: str, shape: Shape, filters, bucket_bits: int) -> DataFrame:
    """(h, c, first, last): strings that start ``first`` to ``last`` bytes left of anchor h in context c occur elsewhere.

    Batches send each distinct context once, its bytes only where its anchor may have
    several. A bucket knows all contexts of its anchors: a context found twice is repeated
    as a whole; the rest are settled by merging shard transforms of whole groups.
    """
    shift = np.uint64(64 - bucket_bits)

    def chosen(raw: np.ndarray) -> tuple:
        at, h, c, left, right = anchors(raw, shape)
        ok = filters.value.is_twice(h)
        ok &= ~filters.value.is_hot(h)
        at, h, c, left, right = at[ok], h[ok], c[ok], left[ok], right[ok]
        mixed, data = filters.value.is_mixed(h).tolist(), raw.tobytes()
        ends = [(p - x, p, p + shape.anchor, p + shape.anchor + y) for p, x, y in zip(at.tolist(), left.tolist(), right.tolist())]
        body = [data[a:b] + data[c:d] if m else b"" for (a, b, c, d), m in zip(ends, mixed)]
        return h, c, left.astype("<u2"), right.astype("<u2"), np.array(body, object)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in _by_anchors((chosen(raw) for batch in batches for raw in _bytes(batch.column(0)))):
            h, c, left, right, body = (np.concatenate(x) for x in zip(*made))
            order = np.lexsort((c, h))
            new = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))))
            many = np.diff(np.append(new, len(h))) > 1
            pick = order[new]
            parts = _by_bucket(h[pick] >> shift)
            many, pick = many[parts.order], pick[parts.order]
            h, c, left, right, body = h[pick], c[pick], left[pick], right[pick], body[pick]
            rows = [
                (b, h[x:y].tobytes(), c[x:y].tobytes(), many[x:y].tobytes(), left[x:y].tobytes(), right[x:y].tobytes(),
                 np.fromiter(map(len, body[x:y]), "<u2", y - x).tobytes() + b"".join(body[x:y]))
                for b, x, y in parts.ranges
            ]
            yield _record(rows, _SENT)

    def settle_bucket(found: pa.Table) -> pa.Table:
        parts = found.to_pylist()
        read = lambda name, kind: np.concatenate([np.frombuffer(p[name], kind) for p in parts])
        h, c, many, left, right = read("h", "<u8"), read("c", "<u8"), read("many", bool), read("left", "<u2"), read("right", "<u2")
        pool, begin, size = [], [], []
        offset = 0
        for p in parts:
            k = len(p["h"]) // 8
            sizes = np.frombuffer(p["body"], "<u2", k).astype(np.int64)
            pool.append(p["body"][2 * k :])
            begin.append(offset + np.cumsum(sizes) - sizes)
            size.append(sizes)
            offset += int(sizes.sum())
        pool, begin, size = b"".join(pool), np.concatenate(begin), np.concatenate(size)
        order = np.lexsort((c, h))
        new = np.flatnonzero(np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))))
        times = np.add.reduceat(many[order].astype(np.int64) + 1, new)
        pick = order[new]
        h, c, left, right, begin, size = h[pick], c[pick], left[pick].astype(np.int64), right[pick].astype(np.int64), begin[pick], size[pick]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        distinct = np.diff(np.append(at, len(h)))
        group = np.repeat(np.arange(len(at)), distinct)
        whole = times > 1
        out = [(h[whole], c[whole], (shape.margin - right)[whole], left[whole])]
        open_ = (distinct > 1) & (np.add.reduceat(~whole, at) > 0)  # groups with a context that came once beside others
        todo = np.flatnonzero(open_[group])
        if len(todo):
            if (size[todo] != left[todo] + right[todo]).any():
                raise RuntimeError("two contexts of an anchor share 48 bits of their hash")
            edges = np.flatnonzero(np.concatenate(([True], group[todo][1:] != group[todo][:-1])))
            ends = np.append(edges[1:], len(todo))
            total = np.concatenate(([0], np.cumsum(size[todo] + 2)))
            a = 0
            while a < len(edges):  # whole groups, up to a bounded number of symbols
                b = a + 1
                while b < len(edges) and total[ends[b]] - total[edges[a]] <= MERGE_SYMBOLS:
                    b += 1
                part = todo[edges[a] : ends[b - 1]]
                bodies = [pool[x : x + y] for x, y in zip(begin[part].tolist(), size[part].tolist())]
                reaches = repeated_starts(bodies, left[part], group[part] - group[part[0]], shape)
                for i, reach in zip(part.tolist(), reaches):
                    if len(reach) and not whole[i]:
                        runs = np.array(_ranges(reach), np.int64)
                        out.append((np.full(len(runs), h[i]), np.full(len(runs), c[i]), runs[:, 0], runs[:, 1]))
                a = b
        h, c, first, last = (np.concatenate([x[i] for x in out]) for i in range(4))
        return pa.table({"h": h.view(np.int64), "c": c.view(np.int64), "first": first.astype(np.int32), "last": last.astype(np.int32)})

    sent = texts.select(F.col(column).cast("string")).mapInArrow(send, "bucket int, h binary, c binary, many binary, left binary, right binary, body binary")
    return sent.groupBy("bucket").applyInArrow(settle_bucket, "h bigint, c bigint, first int, last int")


def _places(texts: DataFrame, column: str, key: str, shape: Shape, filters) -> DataFrame:
    """(key, h, c, pos) of the anchors that may occur twice, very frequent ones apart."""

    @F.arrow_udf("array<struct<h:bigint,c:bigint,pos:bigint>>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made, ends = [], [0]
            for raw in _bytes(batch):
                at, h, c, _, _ = anchors(raw, shape)
                ok = filters.value.is_twice(h) & ~filters.value.is_hot(h)
                made.append((h[ok].view(np.int64), c[ok].view(np.int64), at[ok]))
                ends.append(ends[-1] + int(ok.sum()))
            flat = [np.concatenate([m[i] for m in made]) for i in range(3)] if made else [np.zeros(0, np.int64)] * 3
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], ["h", "c", "pos"]))

    return texts.select(key, F.explode_outer(udf(F.col(column).cast("string"))).alias("p")).filter("p is not null").select(key, "p.h", "p.c", "p.pos")


def _hot_windows(texts: DataFrame, column: str, key: str, shape: Shape, filters) -> DataFrame:
    """(key, low, high): repeated strings at very frequent anchors, found by the hashes of single strings."""

    @F.arrow_udf("array<struct<a:bigint,b:bigint,pos:bigint>>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for raw in _bytes(batch):
                at, h, _, left, right = anchors(raw, shape)
                hot = filters.value.is_hot(h)
                starts = [np.arange(p - x, p + y - shape.margin + 1) for p, x, y in zip(at[hot], left[hot], right[hot])]
                starts = np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
                roll, twin = Rolling(raw), Rolling(255 - raw)
                a, b = (x.parts(starts, starts + shape.length).view(np.int64).tolist() for x in (roll, twin))
                rows.append([{"a": x, "b": y, "pos": z} for x, y, z in zip(a, b, starts.tolist())])
            yield pa.array(rows, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("pos", pa.int64())])))

    each = texts.select(key, F.explode_outer(udf(F.col(column).cast("string"))).alias("w")).filter("w is not null").select(key, "w.a", "w.b", "w.pos")
    often = each.groupBy("a", "b").count().filter("count > 1").select("a", "b")
    return each.join(often, ["a", "b"], "left_semi").select(key, F.col("pos").alias("low"), (F.col("pos") + shape.length).alias("high"))


def _cut(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int, list[tuple[int, int]]]:
    """What is left of the bytes, how many go, and the removed runs."""
    if not spans:
        return raw, 0, []
    runs: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high)
        else:
            runs.append([low, high])
    kept, at = [], 0
    for low, high in runs:
        kept.append(raw[at:low])
        at = high
    return b"".join([*kept, raw[at:]]), sum(b - a for a, b in runs), [tuple(r) for r in runs]


def row_key(id_column: str, text_column: str) -> Column:
    """64 bits for a row's id and text; equal rows share them and all they stand for."""
    return F.xxhash64(F.col(id_column), F.xxhash64(F.col(text_column).cast("string")), F.length(F.col(text_column).cast("string")))


def remove_repeats(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, shape: Shape = Shape(),
    hot_contexts: int = HOT_CONTEXTS, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Add ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``spans`` of every row's text as UTF-8 bytes.

    Each byte covered by a string of ``shape.length`` bytes that also starts anywhere else
    goes: in another row or the same, overlaps included, judged on the input. ``spans`` are
    the maximal removed runs [low, high). Strings never cross rows. Null texts count as
    empty; texts shorter than a string keep everything; a repeated row is another place,
    so all of it goes if it is long enough. An empty table gives an empty table; clashing
    columns are replaced.

    Exact, up to 64-bit hashes of whole anchors and of whole contexts agreeing by chance.
    Three scans: anchors are counted, contexts are compared by merging shard transforms,
    and places meet the repeated contexts in a join that can be split. Only filters of fixed
    size are broadcast. An anchor with more than ``hot_contexts`` contexts, which
    would be one large merge, has its strings compared by hash, counted before the shuffle.
    """
    spark = documents.sparkSession
    rows = documents.drop("kept", "n_bytes", "n_removed", "spans")
    key, text, found = fresh(rows, "row_key", "row_text", "row_marks")
    keyed = rows.select(row_key(id_column, text_column).alias(key), F.col(text_column).cast("string").alias(text))
    total = keyed.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = min(22, max(1, (total // bucket_bytes).bit_length()))
    filters = spark.sparkContext.broadcast(count_anchors(keyed, text, shape, bits, hot_contexts))
    repeats = context_repeats(keyed, text, shape, filters, bits)
    places = _places(keyed, text, key, shape, filters).join(repeats, ["h", "c"])
    marks = places.select(key, (F.col("pos") - F.col("last")).alias("low"), (F.col("pos") - F.col("first") + shape.length).alias("high"))
    if len(filters.value.hot):
        marks = marks.unionByName(_hot_windows(keyed, text, key, shape, filters))
    by_row = marks.groupBy(key).agg(F.collect_list(F.struct("low", "high")).alias(found))

    @F.arrow_udf("struct<kept:binary,n_bytes:bigint,n_removed:bigint,spans:array<struct<low:bigint,high:bigint>>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for texts, lists in batches:
            made = []
            for t, marks in zip(texts.cast(pa.binary()), lists):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                made.append((len(raw), *_cut(raw, marks.as_py())))
            yield pa.StructArray.from_arrays(
                [pa.array([m[1] for m in made], pa.binary()), pa.array([m[0] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()),
                 pa.array([[{"low": a, "high": b} for a, b in m[3]] for m in made], span)],
                ["kept", "n_bytes", "n_removed", "spans"],
            )

    result, = fresh(rows, "cut_result")
    other, = fresh(rows, "marked_key")
    by_row = by_row.withColumnRenamed(key, other)
    joined = rows.join(by_row, row_key(id_column, text_column) == F.col(other), "left")
    done = joined.withColumn(result, cut(F.col(text_column).cast("string"), F.col(found)))
    return done.select(*rows.columns, *[F.col(f"{result}.{n}").alias(n) for n in ("kept", "n_bytes", "n_removed", "spans")])


@query("op4_suffix_array_dedup")
def op4_suffix_array_dedup(spark, sf):
    done = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
