"""Benchmark decontamination by template canonicalisation and slot consistency."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from cellgauge.llm.common import fresh, query, table
from cellgauge.plans.scale import settle

#: Canonical words in a window.
WINDOW = 5
#: Share of an item's windows that a document must hold, in the item's order.
MIN_SHARE = 0.8
#: Least width of a band of offsets that count together; a quarter of the item's windows if that is more.
MIN_BAND = 4
#: Bits of the filter that thins windows inside the scan; fixed, so its 8 MB are known before it is sent.
FILTER_BITS = 26
#: Raw words a task remembers.
REMEMBER = 300_000
#: Characters of one text taken at a time; pieces overlap by a window.
PIECE = 4_000_000

#: Units recognised after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years metre metres meter meters kilometre kilometres kilometer kilometers mile miles "
    "inch inches foot feet gram grams kilogram kilograms pound pounds ounce ounces litre litres liter liters gallon gallons "
    "percent % dollar dollars euro euros cent cents € $ usd eur mph kmh w kw v a k c f °c °f hz khz mhz gb mb kb".split()
)

_NUMERIC = frozenset("0123456789+-$€£")
_QUOTES = "\"')]»”’"
_NUMERAL = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_EDGES = "!\"#&'()*,./:;=?@[\\]^_`{|}~“”„‘’‚«»‹›…–—·•¡¿"
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, on arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Hash of each slot type.
_TYPES = _mix(np.arange(4, dtype=np.uint64) * _SEED)


class Canon:
    """Typed canonical words. A raw word is looked at once and then remembered by number.

    Numbers become ``<number>``; a unit word after one becomes ``<unit>``; a word that
    starts with a capital where no sentence starts becomes ``<name>``. Other words are
    lower-cased and lose punctuation at their ends; words of punctuation alone go.
    """

    def __init__(self, remember: int = REMEMBER):
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.word: list[str] = []
        self.new: list[tuple[int, int]] = []  # hashes and flags not in the arrays yet
        self.hash, self.flags = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def _enter(self, raw: str) -> int:
        plain = raw.strip(_EDGES).rstrip("-+")
        low = plain.lower()
        number = plain[:1] in _NUMERIC and bool(_NUMERAL.fullmatch(plain))
        closes = raw[-1] in ".!?:" or (raw[-1] in _QUOTES and raw.rstrip(_QUOTES)[-1:] in ".!?:")
        flags = number | (low in UNITS) << 1 | (not number and plain[:1].isupper()) << 2 | closes << 3 | bool(plain) << 4
        self.new.append((xxh64_intdigest(low.encode("utf-8", "replace"), 7), flags))
        self.word.append(low)
        i = self.at[raw] = len(self.word) - 1
        return i

    def _arrays(self) -> None:
        if self.new:
            have, need = len(self.word) - len(self.new), len(self.word)
            if need > len(self.hash):
                self.hash = np.concatenate((self.hash, np.zeros(need + 1024, np.uint64)))
                self.flags = np.concatenate((self.flags, np.zeros(need + 1024, np.uint8)))
            self.hash[have:need] = np.array([n[0] for n in self.new], np.uint64)
            self.flags[have:need] = [n[1] for n in self.new]
            self.new = []

    def read(self, text: str, after: tuple[bool, bool] = (True, False)) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[bool, bool]]:
        """Of every canonical word its hash, slot type (0: none, 1 number, 2 name, 3 unit) and code.

        ``after`` says whether a sentence ended and whether a number stood right before;
        the same of the text's last word comes last.
        """
        at, enter = self.at, self._enter
        codes = np.array([at[w] if w in at else enter(w) for w in text.split()], np.int64)
        if not len(codes):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), codes, after
        self._arrays()
        flags = self.flags[codes]
        number, unit, capital, closes, solid = ((flags >> k & 1).astype(bool) for k in range(5))
        starts, follows = np.append(after[0], closes[:-1]), np.append(after[1], number[:-1])
        kind = np.where(number, 1, np.where(unit & follows, 3, np.where(capital & ~starts, 2, 0))).astype(np.int8)
        last = (bool(closes[-1]), bool(number[-1]))
        if not solid.all():
            kind, codes = kind[solid], codes[solid]
        return self.hash[codes], kind, codes, last


def window_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every window; of the whole sequence where it is shorter."""
    width = min(width, len(hashed))
    if not width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashed) - width + 1, np.uint64)
    for k in range(width):
        out = out * _SEED + hashed[k : k + len(out)]
    return _mix(out)


def _typed(hashed: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return np.where(kind > 0, _TYPES[kind], hashed) if kind.any() else hashed


def _pieces(text: str) -> Iterator[str]:
    """The text cut at spaces about every PIECE characters."""
    begin = 0
    while len(text) - begin > PIECE and (end := text.find(" ", begin + PIECE)) >= 0:
        yield text[begin:end]
        begin = end
    yield text[begin:]


def _windows(text: str | None, canon: Canon, width: int, wanted: np.ndarray | None) -> Iterator[tuple[int, int, int, list[str], bool]]:
    """(position, level, hash, slots, bare) of a text's windows that pass the filter.

    Level 0 has no name in it; other windows come typed (1) and with their names as plain
    words (2), as capitals alone may also be a matter of style. A slot is its place in the
    window, type and spelling. A bare window is slots alone.
    """
    if len(canon.at) > canon.remember:
        canon.forget()
    after, base, pieces = (True, False), 0, list(_pieces(text or ""))
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.int64))
    for i, piece in enumerate(pieces):
        *read, after = canon.read(piece, after)
        hashed, kind, codes = (np.concatenate(x) for x in zip(held, read))
        if len(hashed) < width and (base or i + 1 < len(pieces)):
            held = (hashed, kind, codes)
            continue
        typed = window_hashes(_typed(hashed, kind), width)
        names = (kind == 2).any()
        plain = window_hashes(_typed(hashed, np.where(kind == 2, 0, kind)), width) if names else typed
        for level, hashes in ((1, typed), (2, plain)) if names else ((1, typed),):
            picked = np.arange(len(hashes)) if level == 1 else np.flatnonzero(plain != typed)
            if wanted is not None:
                bit = hashes[picked] >> np.uint64(64 - FILTER_BITS)
                picked = picked[wanted[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0]
            for at in picked.tolist():
                span = range(at, min(at + width, len(codes)))
                slots = [f"{k - at} {kind[k]} {canon.word[codes[k]]}" for k in span if kind[k] and (level == 1 or kind[k] != 2)]
                yield base + at, level if typed[at] != plain[at] else 0, int(hashes[at].view(np.int64)), slots, len(slots) == len(span)
        keep = max(0, len(hashed) - width + 1)
        base += keep
        held = (hashed[keep:], kind[keep:], codes[keep:])


HITS = "array<struct<pos:bigint,level:int,hash:bigint,slots:array<string>,bare:boolean>>"
_HIT = pa.list_(pa.struct([("pos", pa.int64()), ("level", pa.int32()), ("hash", pa.int64()), ("slots", pa.list_(pa.string())), ("bare", pa.bool_())]))


def template_windows(rows: DataFrame, text_column: str, out: str, *, width: int = WINDOW, wanted: np.ndarray | None = None) -> DataFrame:
    """Add the canonical windows of each whole text as an array of (pos, level, hash, slots, bare).

    With ``wanted``, a bit map over the leading bits of the hashes, only windows whose bit is set.
    """
    shared = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)

    @F.arrow_udf(HITS)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        canon, bits = Canon(), None if shared is None else shared.value
        for batch in batches:
            yield pa.array([[dict(zip(("pos", "level", "hash", "slots", "bare"), w)) for w in _windows(t.as_py(), canon, width, bits)] for t in batch], _HIT)

    return rows.withColumn(out, udf(F.col(text_column).cast("string")))


def window_filter(windows: DataFrame) -> np.ndarray:
    """Bit map of the hashes' leading bits, 2^FILTER_BITS bits whatever the table's size."""
    at = f"shiftrightunsigned(hash, {64 - FILTER_BITS})"
    words = windows.groupBy(F.expr(f"shiftright({at}, 5)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} & 31 AS int)))").alias("bits"))
    found = words.toArrow()  # at most 2^21 pairs of numbers
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def benchmark_windows(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", *, width: int = WINDOW) -> DataFrame:
    """item, place, hash, slots and the item's number of windows, also by reading without bare ones; items without a word have none."""
    texts = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).alias("text")).filter(F.col("item").isNotNull())
    texts = texts.withColumn("item_hash", F.xxhash64("text"))
    made = template_windows(texts, "text", "windows", width=width).filter(F.size("windows") > 0)
    n = F.size(F.filter("windows", lambda w: w["level"] < 2))
    worded = [F.size(F.filter("windows", lambda w: ~w["bare"] & (w["level"] != other))) for other in (2, 1)]
    made = made.select("item", "item_hash", n.alias("n_windows"), F.array(*worded).alias("n_worded"), F.explode("windows").alias("w"))
    return made.select(
        "item", "item_hash", "n_windows", "n_worded", F.col("w.pos").alias("place"), F.col("w.level").alias("item_level"),
        F.col("w.hash").alias("hash"), F.col("w.slots").alias("item_slots"), "w.bare",
    )


def _aligned(windows: list[dict]) -> list[dict]:
    """Of every place one window: that at the offset with most windows, as a place may meet the like of it nearby too."""
    support = Counter(w["pos"] - w["place"] for w in windows)
    best: dict[int, tuple] = {}
    for w in windows:
        rank = (support[w["pos"] - w["place"]], w["item_slots"] == w["slots"], -w["pos"])
        if w["place"] not in best or rank > best[w["place"]][0]:
            best[w["place"]] = (rank, w)
    return [w for _, w in best.values()]


def _slot(slot: str) -> tuple[int, str, str]:
    at, kind, word = slot.split(" ", 2)
    return int(at), kind, word


def _agreeing(windows: list[dict]) -> list[dict]:
    """The windows whose names read as most words of that name do; a name without a majority has no reading.

    Numbers and units may take any values: equal ones in an item can be different quantities.
    """
    words = defaultdict(set)  # of a name: which word of the item reads how
    for w in _aligned(windows):
        for (at, kind, a), (_, _, b) in zip(map(_slot, w["item_slots"]), map(_slot, w["slots"])):
            if kind == "2":
                words[a].add((w["place"] + at, b))
    if not words:
        return windows
    reading = {}
    for name, read in words.items():
        (most, n), = Counter(b for _, b in read).most_common(1)
        reading[name] = most if 2 * n > len(read) else None

    def agrees(w: dict) -> bool:
        pairs = zip(map(_slot, w["item_slots"]), map(_slot, w["slots"]))
        return all(reading.get(a) == b for (_, kind, a), (_, _, b) in pairs if kind == "2")

    return [w for w in windows if agrees(w)]


def _share(n_windows: int, n_worded: int, windows: list[dict]) -> float:
    """Of an item's windows, or 0 where less than half of those with wording agree: numbers alone are no item."""
    held = _agreeing(windows)
    worded = len({w["place"] for w in held if not w["bare"]})
    return len({w["place"] for w in held}) / n_windows if worded and 2 * worded >= n_worded else 0.0


@F.arrow_udf(T.DoubleType())
def _coverage(n_windows: pa.Array, n_worded: pa.Array, windows: pa.Array) -> pa.Array:
    """The best share of the typed windows, of those with names as plain words, and of literally equal ones."""
    out = []
    for n, worded, met in zip(n_windows.to_pylist(), n_worded.to_pylist(), windows.to_pylist()):
        typed = [w for w in met if w["level"] < 2 and w["item_level"] < 2]
        plain = [w for w in met if w["level"] != 1 and w["item_level"] != 1]
        equal = {w["place"] for w in typed + plain if w["item_slots"] == w["slots"]}
        out.append(max(_share(n, worded[0], typed), _share(n, worded[1], plain), len(equal) / n))
    return pa.array(out, pa.float64())


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
    width: int = WINDOW, min_share: float = MIN_SHARE,
) -> DataFrame:
    """doc_id, row_hash, item_id and coverage of every benchmark item that a document holds.

    Texts become typed templates (see :class:`Canon`), so an item whose numbers, names or
    units were changed still has its windows. Windows meet by a hash join; a filter of
    fixed size drops most of the documents' windows before anything moves. Per document
    and item, among windows in about the item's order (offsets, document place minus item
    place, that differ by less than an eighth of the item), the share of the item's
    windows must reach ``min_share``. Windows count that are literally equal, or whose slots
    agree: numbers and units may take any values, as equal ones can be different
    quantities; a name of the item stands for the name that most of its words meet, and
    windows with another there do not count. Where a place of the item meets several
    windows, the offset with most windows decides the names. Numbers alone are no item:
    unless literally equal, half of the windows with a plain word must be among those held.

    An item shorter than a window is one window, found where a document is that text.
    ``row_hash`` (of the text) tells repeated ids apart; equal rows give one result. Null
    and empty texts hold nothing; null item ids are left out; an empty table on either
    side gives no rows. Only rows with hits are shuffled, spread by (document, item).
    """
    items = settle(benchmark_windows(benchmark, width=width))
    wanted = window_filter(items)
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    found = template_windows(rows.withColumn("row_hash", F.xxhash64("text")), "text", "hits", width=width, wanted=wanted)
    found = found.filter(F.size("hits") > 0).select("doc_id", "row_hash", F.explode("hits").alias("h"))
    found = found.select("doc_id", "row_hash", "h.pos", "h.level", "h.hash", "h.slots")
    met = found.join(items, "hash").withColumn("offset", F.col("pos") - F.col("place"))
    # bands of offsets, in two layers half a band apart: inserted or missing words shift the rest
    band = F.greatest(F.lit(MIN_BAND), F.floor(F.col("n_windows") / 4)).cast("long")
    half = F.floor(band / 2)
    layers = [F.struct(F.lit(i).alias("layer"), F.floor((F.col("offset") + shift) / band).alias("band")) for i, shift in enumerate((F.lit(0), half))]
    met = met.withColumn("at", F.explode(F.array(*layers)))
    window = F.struct("place", "pos", "item_level", "level", "item_slots", "slots", "bare")
    groups = met.groupBy("doc_id", "row_hash", "item", "item_hash", "at", "n_windows", "n_worded").agg(F.collect_set(window).alias("windows"))
    # no reading holds more than all places met
    groups = groups.filter(F.size(F.array_distinct("windows.place")) >= min_share * F.col("n_windows"))
    held = groups.withColumn("coverage", _coverage("n_windows", "n_worded", "windows")).filter(F.col("coverage") >= min_share)
    return held.groupBy("doc_id", "row_hash", F.col("item").alias("item_id")).agg(F.max("coverage").alias("coverage"))


def mark(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Every input row with ``items`` (sorted ids of the items it holds, empty for none), ``coverage`` and ``contaminated``.

    Clashing columns are replaced.
    """
    rows = documents.drop("items", "coverage", "contaminated")
    rid, tid = fresh(rows, "row_id", "row_hash")
    found = contamination(documents, benchmark, id_column, text_column, **options)
    by_row = found.groupBy(F.col("doc_id").alias(rid), F.col("row_hash").alias(tid)).agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage")
    )
    same = F.col(id_column).eqNullSafe(F.col(rid)) & (F.xxhash64(F.col(text_column).cast("string")) == F.col(tid))
    joined = rows.join(by_row, same, "left")
    empty = F.array().cast(by_row.schema["items"].dataType)
    return joined.select(
        *rows.columns, F.coalesce("items", empty).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.col("items").isNotNull().alias("contaminated"),
    )


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    marked = mark(documents, table(spark, sf, "benchmark"))
    return marked.select("doc_id", "contaminated", "items", "coverage")
