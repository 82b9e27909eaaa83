"""Plan building blocks that keep lopsided groups spread over many tasks.

A well, a particle or a user may hold a third of all rows. Everything here works
from per-group counts, which combine on the map side, and treats *hot* groups (more
than ``HOT_ROWS`` rows, however many groups there are) apart from the rest. No
function gathers a group in one task unless that group is below the hot bound.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType

BROADCAST_BYTES = 64 << 20  # largest table sent to every executor
HOT_SHARE = 1000  # statistics of groups with more than 1/HOT_SHARE of the rows go by broadcast
HOT_ROWS = 1_000_000  # a hot group holds more rows than this; a slice of it holds about half
SLICES = 4096  # ordered pieces a hot group is cut into at most
CUT_SAMPLES = 64  # rows drawn for each slice to place the cuts
SALTS = 64  # unordered pieces used by two-stage top-n
SKETCH = 10_000  # rank resolution of the quantile sketch
MERGE_WAYS = 256  # tasks that share the merging of one group's sketches
WAVES = 4  # tasks for every core where small rows mean much work
POOL_BITS = 12  # a pool is sent in arrays of 2**POOL_BITS values


# --------------------------------------------------------------------------
# Lineage and scratch space
# --------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="cellgauge-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from there.

    Used for per-group statistics: their size is then known, they are computed
    once, and a lost executor cannot make two branches see different sketches.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_observed(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """Settle, and gather aggregates over the rows in the same job.

    The aggregates are taken as the rows are written, each task counting once, so
    scalars of a step cost no job of their own.
    """
    seen = Observation()
    done = settle(df.observe(seen, *[column.alias(name) for name, column in aggregates.items()]))
    return done, seen.get


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores: the keys of a large job may be one small file, which is one task."""
    return df.repartition(WAVES * df.sparkSession.sparkContext.defaultParallelism)


# --------------------------------------------------------------------------
# Joining small statistics onto large tables
# --------------------------------------------------------------------------


def match(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str, *, broadcast: bool, shuffle: bool = False
) -> DataFrame:
    """Equi join that also pairs null keys, keeping the left side's key columns.

    With ``shuffle`` no side is sent whole, whatever the planner expects: it takes the size of
    a table from its file, and cells made from a few rows for as small as those. With
    neither the planner decides.
    """
    names = {key: f"__key_{i}" for i, key in enumerate(keys)}
    right = small.select(
        *[F.col(key).alias(names[key]) for key in keys],
        *[F.col(c) for c in small.columns if c not in names],
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(names[key]))
    joined = big.join(F.broadcast(right) if broadcast else right.hint("merge") if shuffle else right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def attach(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    *,
    how: str = "inner",
    weight: str = "n",
    row_bytes: int = 64,
    rows: int | None = None,
) -> DataFrame:
    """Add per-group columns of a settled table to every row of ``big``.

    Up to ``BROADCAST_BYTES`` the table is broadcast and ``big`` is not shuffled.
    Beyond that the hot groups, fewer than ``HOT_SHARE`` by definition, still go by
    broadcast and only the remaining, evenly small groups are shuffled. ``weight``
    names the column with a group's row count; ``rows`` is the table's, where known.
    """
    if not keys:
        row = small.first()
        return big.select(
            "*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in small.schema]
        )
    if (small.count() if rows is None else rows) <= BROADCAST_BYTES // row_bytes:
        return match(big, small, keys, how, broadcast=True)
    if weight not in small.columns:
        return match(big, small, keys, how, broadcast=False, shuffle=True)
    total = small.agg(F.sum(weight)).first()[0]
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot, cold = small.filter(is_hot), small.filter(~is_hot)
    by_broadcast = match(big, hot, keys, "inner", broadcast=True)
    others = match(big, hot.select(*keys), keys, "left_anti", broadcast=True)
    return by_broadcast.unionByName(match(others, cold, keys, how, broadcast=False, shuffle=True))


@dataclass(frozen=True)
class Pool:
    """A settled table of ``size`` rows that drawn indices look up in their column ``idx``.

    ``packed`` has the same values as one row for every 2**POOL_BITS indices, or is None where
    these would be too large to send, are no numbers, or ``idx`` is not 1, 2, 3 ....
    """

    rows: DataFrame
    size: int
    packed: DataFrame | None

    @property
    def sent(self) -> bool:
        """Whether the pool goes to its draws, which then stay where they are."""
        return self.packed is not None or self.size <= BROADCAST_BYTES // 64

    def look_up(self, big: DataFrame, index: str, how: str = "inner", **names: str) -> DataFrame:
        """``big`` with the values at its column ``index``, under their own or the given names."""
        values = [c for c in self.rows.columns if c != "idx"]
        if self.packed is None:
            named = self.rows.select(F.col("idx").alias(index), *[F.col(c).alias(names.get(c, c)) for c in values])
            return attach(big, named, [index], how=how, weight="", rows=self.size)
        place = F.col(index) - 1
        block, at = F.shiftright(place, POOL_BITS), place.bitwiseAND(F.lit((1 << POOL_BITS) - 1)).cast("int")
        joined = big.join(F.broadcast(self.packed), block == F.col("__block"), how)
        inside = at < F.col("__n")  # read on both ways, so that both meet one broadcast
        if how == "inner":
            joined = joined.filter(inside)
        found = [F.when(inside, F.get(f"__pool_{c}", at)).alias(names.get(c, c)) for c in values]
        return joined.select(*big.columns, *found)


def settle_pool(df: DataFrame) -> Pool:
    """Settle a table with an index ``idx`` for its draws, packed where that is small.

    A row sent by itself takes some hundred bytes in the driver, beside its value in an array
    it takes eight, so a pool of some million values is sent and draws need no shuffle. Blocks
    are made by as many tasks as any grouping; an index with gaps, repeats or nulls is
    noticed as they are written, and such a pool is met row by row.
    """
    rows, seen = settle_observed(df, n=F.count(F.lit(1)))
    values = [f for f in rows.schema if f.name != "idx"]
    width = sum(8 if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, DecimalType) else BROADCAST_BYTES for f in values)
    if not seen["n"] or seen["n"] * width > BROADCAST_BYTES // 2:
        return Pool(rows, seen["n"], None)
    place = F.col("idx").cast("long") - 1
    entry = F.struct(place.bitwiseAND(F.lit((1 << POOL_BITS) - 1)).alias("at"), *[f.name for f in values])
    listed = rows.groupBy(F.shiftright(place, POOL_BITS).alias("__block")).agg(F.array_sort(F.collect_list(entry)).alias("__e"))
    n = F.size("__e")
    even = F.col("__e")["at"] == F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    arrays = [F.col("__e")[f.name].alias(f"__pool_{f.name}") for f in values]
    packed, found = settle_observed(
        listed.select("__block", n.alias("__n"), *arrays, even.alias("__even")),
        even=F.min("__even"), first=F.min("__block"), last=F.max(F.shiftleft("__block", POOL_BITS) + F.col("__n")),
    )
    dense = found["even"] and found["first"] == 0 and found["last"] == seen["n"]
    return Pool(rows, seen["n"], packed.drop("__even") if dense else None)


def measured_groups(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Settled row count ``n`` of every group, and the largest."""
    sizes, seen = settle_observed(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), largest=F.max("n"))
    return sizes, seen["largest"] or 0


def hot_groups(sizes: DataFrame, hot_rows: int = HOT_ROWS, *, largest: int | None = None) -> DataFrame | None:
    """The groups too large for one task, or None; at most one for every ``hot_rows`` rows."""
    if largest is None:
        largest = sizes.agg(F.max("n")).first()[0] or 0
    return sizes.filter(F.col("n") > hot_rows) if largest > hot_rows else None


# --------------------------------------------------------------------------
# Ordered work inside groups
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Sliced:
    """Rows ready for ordered work inside groups.

    With ``cut`` there is a column ``slice``: from 0 in hot groups, rising with the
    order, and -1 elsewhere. Without it every group fits one task.
    """

    rows: DataFrame
    cut: bool

    def units(self, keys: Sequence[str]) -> list[str]:
        """The columns whose values one task may take on its own."""
        return [*keys, "slice"] if self.cut else list(keys)

    def done(self) -> DataFrame:
        return self.rows.drop("slice", "__hot") if self.cut else self.rows


def slice_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    *,
    sizes: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    slices: int = SLICES,
) -> Sliced:
    """Cut hot groups into ordered slices of about ``hot_rows / 2`` rows, ``slices`` at most.

    ``order`` is the whole order of the work to come, of any sortable types; nulls come
    first, infinities and NaN in their places. Cuts are taken from drawn rows on the
    whole order and, among equal rows, a hash of all columns, so that neither ties nor
    missing values fill a slice; only rows equal in every column stay together.
    """
    sizes, largest = measured_groups(df, keys) if sizes is None else (sizes, None)
    hot = hot_groups(sizes, hot_rows, largest=largest)
    if hot is None:
        return Sliced(df, False)
    order = [order] if isinstance(order, str) else list(order)
    hashable = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    place = F.struct(*order, F.xxhash64(*hashable).alias("__tie"))
    pieces = F.least(F.lit(slices), F.ceil(2 * F.col("n") / hot_rows)).cast("int")
    hot = settle(hot.select(*keys, pieces.alias("__pieces"), (CUT_SAMPLES * pieces / F.col("n")).alias("__draw")))
    total = hot.agg(F.count(F.lit(1)), F.sum("__pieces"), F.max("__pieces")).first()
    few = total[1] * 64 <= BROADCAST_BYTES  # at most two cuts for every hot_rows rows
    if not keys:  # one group, whose cuts are one small row
        few, df, hot = True, df.withColumn("__all", F.lit(0)), hot.withColumn("__all", F.lit(0))
    by = list(keys) or ["__all"]
    rows = match(df, hot, by, "inner", broadcast=few)
    drawn = rows.filter(F.rand(7) < F.col("__draw")).select(*by, "__pieces", place.alias("__place"))
    listed = drawn.groupBy(*by, "__pieces").agg(F.array_sort(F.collect_list("__place")).alias("__places"))
    # any rising cuts are right; drawn rows at even steps make the slices alike
    step = F.size("__places") / F.col("__pieces")
    at = F.transform(F.sequence(F.lit(1), F.col("__pieces") - 1), lambda i: F.floor(i * step).cast("int"))
    cuts = settle(listed.select(*by, F.transform(at, lambda i: F.get("__places", i)).alias("__cuts")))
    tagged = match(df, cuts, by, "left", broadcast=few).drop("__all")
    # Binary search, one projection per step: generated code, where a lambda over the
    # cuts would be interpreted and copy them into every row.
    numbered = tagged.withColumn("__place", place).withColumn("slice", F.lit(0))
    for step in [2**k for k in reversed(range(max(1, total[2]).bit_length()))]:
        further = F.get("__cuts", F.col("slice") + (step - 1)) < F.col("__place")
        numbered = numbered.withColumn("slice", F.col("slice") + F.when(further, step).otherwise(0))
    numbered = numbered.withColumn("__hot", F.col("__cuts").isNotNull())
    numbered = numbered.withColumn("slice", F.when(F.col("__hot"), F.col("slice")).otherwise(-1))
    return Sliced(numbered.drop("__cuts", "__place"), True)


def _slice_table(rows: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """One row per slice of a hot group: about two for every ``HOT_ROWS`` rows.

    Filters on the flag: a filter on ``slice`` would be pushed down through the search
    and double in size with every step of it.
    """
    return rows.filter("__hot").groupBy(*keys, "slice").agg(*aggregates)


def running_total(
    sliced: Sliced, keys: Sequence[str], order: Sequence[str], amounts: dict[str, str]
) -> Sliced:
    """Running sums inside groups.

    Each slice sums on its own and is shifted by the totals of the slices before it.
    """
    rows = sliced.rows
    inside = (
        Window.partitionBy(*sliced.units(keys))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if not sliced.cut:
        sums = [F.sum(column).over(inside).alias(out) for out, column in amounts.items()]
        return Sliced(rows.select("*", *sums), False)
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = _slice_table(
        rows, keys, [F.sum(column).alias(f"__{out}") for out, column in amounts.items()]
    )
    shifts = settle(
        totals.select(
            *keys, "slice", *[F.sum(f"__{out}").over(before).alias(f"__shift_{out}") for out in amounts]
        )
    )
    shifted = attach(rows, shifts, [*keys, "slice"], how="left")
    sums = [
        (F.sum(column).over(inside) + F.coalesce(F.col(f"__shift_{out}"), F.lit(0))).alias(out)
        for out, column in amounts.items()
    ]
    return Sliced(shifted.select(*rows.columns, *sums), True)


def previous_row(
    sliced: Sliced, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]
) -> Sliced:
    """Values of the preceding row inside groups, also across slice borders."""
    rows = sliced.rows
    inside = Window.partitionBy(*sliced.units(keys)).orderBy(*order)
    if not sliced.cut:
        lags = [F.lag(column).over(inside).alias(out) for out, column in columns.items()]
        return Sliced(rows.select("*", *lags), False)
    along = Window.partitionBy(*keys).orderBy("slice")
    last = _slice_table(
        rows, keys, [F.max_by(F.struct(*columns.values()), F.struct(*order)).alias("__last")]
    )
    borders = settle(
        last.select(
            *keys,
            "slice",
            *[
                F.lag(F.col("__last")[column]).over(along).alias(f"__border_{out}")
                for out, column in columns.items()
            ],
        )
    )
    bordered = attach(rows, borders, [*keys, "slice"], how="left")
    lags = [
        F.when(F.row_number().over(inside) == 1, F.col(f"__border_{out}"))
        .otherwise(F.lag(column).over(inside))
        .alias(out)
        for out, column in columns.items()
    ]
    return Sliced(bordered.select(*rows.columns, *lags), True)


def number_rows(df: DataFrame, order: Sequence[Column | str], out: str, *, partitions: int | None = None) -> DataFrame:
    """Add ``out``: 1, 2, 3 ... over all rows by ``order``, without a window over the whole table.

    Rows are range partitioned and sorted where they land; a row's number is its place in
    its partition plus the rows of the partitions before, counts of which there are as many
    as partitions. Among rows equal by ``order`` a hash of the row decides, then where the
    row was read, so that not even equal rows all meet in one task. The ordered rows are
    settled first: bounds are drawn anew by every run of a range shuffle. Hashes leave maps out.
    """
    hashable = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    tied = df.withColumn("__tie", F.xxhash64(*hashable)).withColumn("__read", F.monotonically_increasing_id())
    by = [*order, "__tie", "__read"]
    ranged = tied.repartitionByRange(partitions, *by) if partitions else tied.repartitionByRange(*by)
    # an id holds the partition above bit 33 and the place inside it below
    placed = ranged.sortWithinPartitions(*by).drop("__tie", "__read").withColumn("__place", F.monotonically_increasing_id())
    placed = settle(placed)
    part = F.shiftright("__place", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for number, n in counts:
        offsets.append((number, before))
        before += n
    spark = df.sparkSession
    starts = spark.createDataFrame(offsets, "`__part` bigint, `__before` bigint")
    numbered = placed.join(F.broadcast(starts), part == F.col("__part"), "inner")  # one row a partition
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(*[c for c in df.columns if c != out], (F.col("__before") + inside + 1).alias(out))


def first_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, *, salts: int = SALTS, sketch: int = SKETCH
) -> DataFrame:
    """The first ``n`` rows of every group by ``order``, whose first column is numeric.

    A sketch gives each group a bound that at least ``n`` rows lie below, mostly not
    many more; the rest never leaves its task. What is left is ranked in two stages,
    salted pieces first, so that many rows at the bound do not meet in one task.
    """
    value = F.col(order[0]).cast("double")
    shares = [2.0**-k for k in range(1, 25)]  # tried from the smallest
    parts = [
        F.count(value).alias("__n"),
        F.max(value).alias("__max"),
        F.percentile_approx(value, shares, sketch).alias("__at"),
    ]
    tops = [F.max(F.col("__at")[k]).alias(f"__at_{k}") for k in range(len(shares))]
    stats = _sketched(df.select(*keys, order[0]), keys, parts).groupBy(*keys).agg(
        F.sum("__n").alias("__n"), F.max("__max").alias("__max"), F.count(F.lit(1)).alias("__ways"), *tops
    )
    bound = F.col("__max")
    for k, share in enumerate(shares):
        enough = F.col("__n") * share >= n + 4 + F.col("__ways") + 4.0 * F.col("__n") / sketch
        bound = F.when(enough, F.col(f"__at_{k}")).otherwise(bound)
    bounds = settle(stats.select(*keys, "__n", bound.alias("__bound")))
    near = attach(df, bounds, keys, weight="__n")
    near = near.filter(value.isNull() | (value <= F.col("__bound"))).select(*df.columns)  # nulls sort first
    salted = near.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    pieces = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("__rank", F.row_number().over(pieces))
        .filter(F.col("__rank") <= n)
        .withColumn("__rank", F.row_number().over(whole))
        .filter(F.col("__rank") <= n)
        .drop("__salt", "__rank")
    )


# --------------------------------------------------------------------------
# Exact order statistics
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Position:
    """A wanted order statistic: where it lies, roughly and exactly.

    ``share`` is its approximate position in (0, 1); ``place`` turns the group's
    row count into the zero-based, possibly fractional position.
    """

    name: str
    column: str
    share: float
    place: Callable[[Column], Column]


def quantile(name: str, column: str, p: float) -> Position:
    """Linear interpolation between order statistics (type 7)."""
    return Position(name, column, p, lambda n: (n - 1) * F.lit(float(p)))


def _sketched(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates per group and input share, so that no task merges all sketches of a hot group.

    Rows are told apart by input partition modulo ``MERGE_WAYS``. Quantiles of the
    shares bound those of the group: the smallest of the shares' quantiles has at
    most that part of the group below it, the largest at least that part.
    """
    shared = df.withColumn("__share", F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)))
    return shared.groupBy(*keys, "__share").agg(*aggregates)


def _brackets(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], wanted: Sequence[Position], sketch: int
) -> DataFrame:
    """Per group: row count ``n``, counts per column, and a range around every wanted position."""
    levels = [10**k for k in range(4)]  # the fewer the rows, the wider the bracket
    shares: dict[str, list[float]] = {c: [] for c in columns}  # one sketch serves a column
    offsets = []
    for w in wanted:
        offsets.append(len(shares[w.column]))
        for level in levels:
            margin = 4.0 * level / sketch
            shares[w.column] += [max(0.0, w.share - margin), min(1.0, w.share + margin)]
    parts = [F.count(F.lit(1)).alias("__rows")]
    merged = [F.sum("__rows").alias("n"), F.count(F.lit(1)).alias("__ways")]
    for c in columns:
        parts += [
            F.count(c).alias(f"__n_{c}"),
            F.min(c).alias(f"__min_{c}"),
            F.max(c).alias(f"__max_{c}"),
            F.percentile_approx(c, shares[c], sketch).alias(f"__at_{c}"),
        ]
        merged += [F.sum(f"__n_{c}").alias(f"__n_{c}")]
        merged += [F.min(f"__min_{c}").alias(f"__min_{c}"), F.max(f"__max_{c}").alias(f"__max_{c}")]
    for i, w in enumerate(wanted):
        at = F.col(f"__at_{w.column}")
        for k in range(len(levels)):
            merged.append(F.min(at[offsets[i] + 2 * k]).alias(f"__low_{i}_{k}"))
            merged.append(F.max(at[offsets[i] + 2 * k + 1]).alias(f"__high_{i}_{k}"))
    stats = _sketched(df.select(*keys, *columns), keys, parts).groupBy(*keys).agg(*merged)
    ranges = []
    for i, w in enumerate(wanted):
        low, high = F.col(f"__min_{w.column}"), F.col(f"__max_{w.column}")
        for k, level in reversed(list(enumerate(levels))):
            # The margin must cover the sketch error and one rounded rank per share.
            margin_rows = F.col(f"__n_{w.column}") * (4.0 * level / sketch)
            enough = margin_rows >= 2 * (F.col("__ways") + 2)
            low = F.when(enough, F.col(f"__low_{i}_{k}")).otherwise(low)
            high = F.when(enough, F.col(f"__high_{i}_{k}")).otherwise(high)
        ranges += [low.alias(f"__lo_{i}"), high.alias(f"__hi_{i}")]
    return stats.select(*keys, "n", *[f"__n_{c}" for c in columns], *ranges)


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Sequence[Position],
    *,
    sketch: int = SKETCH,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact order statistics per group without sorting or gathering the groups.

    A sketch brackets each wanted position; one more pass counts what lies outside
    the bracket (on its nearer side) and keeps the few values inside, already
    combined by value. Only those are ranked, in slices where a group is hot. Nulls
    are left out, as in SQL aggregates. A position its bracket missed would raise
    an error rather than give a wrong value.
    """
    columns = sorted({w.column for w in wanted})
    stats, seen = settle_observed(_brackets(df, keys, columns, wanted, sketch), groups=F.count(F.lit(1)), largest=F.max("n"))
    groups, largest = seen["groups"], seen["largest"]

    entries, anywhere = [], F.lit(False)
    for i, w in enumerate(wanted):
        x, low, high = F.col(w.column), F.col(f"__lo_{i}"), F.col(f"__hi_{i}")
        if w.share <= 0.5:  # count from below
            outside, near = x < low, x <= high
            y = x.cast("double")
        else:  # count from above, with the sign turned
            outside, near = x > high, x >= low
            y = -x.cast("double")
        anywhere = anywhere | near
        entries.append(
            F.when(near, F.struct(F.lit(i).alias("i"), F.when(~outside, y).alias("y")))
        )
    bounds = [f"__{side}_{i}" for side in ("lo", "hi") for i in range(len(wanted))]
    bounded = attach(df.select(*keys, *columns), stats.select(*keys, "n", *bounds), keys, rows=groups)
    counted = (
        bounded.filter(anywhere)  # far most rows end here
        .select(*keys, F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
        .groupBy(*keys, "e.i", "e.y")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # Positions wanted from each group, as one-based ranks on the counting side.
    places = []
    for i, w in enumerate(wanted):
        n = F.col(f"__n_{w.column}")
        at = w.place(n)
        under = F.floor(at)
        first = under + 1 if w.share <= 0.5 else n - under
        second = under + 2 if w.share <= 0.5 else n - under - 1
        places.append(F.struct(F.lit(i).alias("i"), first.alias("r1"), second.alias("r2"), (at - under).alias("f")))
    targets = stats.select(*keys, F.explode(F.array(*places)).alias("t")).select(
        *keys, F.col("t.i").alias("i"), "t.r1", "t.r2", "t.f"
    )
    cell = [*keys, "i"]
    if (largest or 0) <= hot_rows:
        # the wanted ranks travel as rows of their group, first in its order and counting nothing
        rows = counted.select(*cell, "y", "c", *[F.lit(None).cast(t).alias(r) for r, t in (("r1", "long"), ("r2", "long"), ("f", "double"))])
        asked = targets.select(*cell, F.lit(None).cast("double").alias("y"), F.lit(0).cast("long").alias("c"), F.col("r1").cast("long").alias("r1"), F.col("r2").cast("long").alias("r2"), "f")
        whole = Window.partitionBy(*cell)
        upto = F.sum("c").over(whole.orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = rows.unionByName(asked).select(*cell, "y", "c", upto.alias("upto"), *[F.max(r).over(whole).alias(r) for r in ("r1", "r2", "f")])
    else:
        counted = settle(counted)
        cut = slice_groups(counted, cell, "y", hot_rows=hot_rows)
        ranked = running_total(cut, cell, ["y"], {"upto": "c"}).done()  # what is outside has a null y: first
        placed = attach(ranked, targets, cell, rows=groups * len(wanted))

    def held(rank: str) -> Column:
        return (F.col("upto") - F.col("c") < F.col(rank)) & (F.col(rank) <= F.col("upto"))

    found = placed.groupBy(*cell).agg(
        F.max(F.when(held("r1"), F.col("y"))).alias("a"),
        F.max(F.when(held("r2"), F.col("y"))).alias("b"),
        F.max("f").alias("f"),
        F.sum("c").alias("__counted"),
    ).filter("__counted > 0")
    sign = F.element_at(
        F.array(*[F.lit(1.0 if w.share <= 0.5 else -1.0) for w in wanted]), F.col("i") + 1
    )
    low = F.coalesce("a", F.raise_error(F.lit("order statistic outside its bracket")).cast("double"))
    value = sign * (low + F.col("f") * (F.coalesce("b", "a") - F.col("a")))
    # every group has a row of its statistics, so that one without a value keeps its count
    none = F.lit(None)
    values = found.select(*keys, "i", value.alias("__value"), none.cast("long").alias("n"))
    counts = stats.select(*keys, F.lit(-1).alias("i"), none.cast("double").alias("__value"), "n")
    return values.unionByName(counts).groupBy(*keys).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("__value"))).alias(w.name) for i, w in enumerate(wanted)]
    )
