"""Metrics that see both samples: the predicted cells of a candidate and the observed cells of the same key.

A metric is given as its part over a range of values, and parts of a sample add up. So
a sample too large for one task is cut by value, and a key with many candidates is
dealt to several tasks, each with the observed cells of its range. A metric may give the
parts of many candidates at once, which spares a call for each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.plans.scale import HOT_ROWS, match, settle, settle_observed

BATCH_ROWS = 1 << 16  # predicted values that a metric sees at once, but for a larger candidate
BLOCKS = 16  # lists that the observed values of a range are sent in
#: Types whose equal values are the same bits; of floats, zeros and NaN are made so.
PLAIN = (T.IntegralType, T.DecimalType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Side:
    """A sample within a range of values: rising distinct values, their counts, how many lie below the range, and in all."""

    values: np.ndarray
    counts: np.ndarray
    before: int
    total: int

    @cached_property
    def area(self) -> _Area:
        """Made once for all candidates that meet this side; it has a value."""
        return _area(self)


@dataclass(frozen=True)
class Sides:
    """Samples of many candidates within one range, one after the other; ``ends`` has where the values of each end."""

    values: np.ndarray
    counts: np.ndarray
    ends: np.ndarray
    before: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, side: Side) -> Sides:
        return cls(side.values, side.counts, np.array([len(side.values)]), np.array([side.before]), np.array([side.total]))

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def side(self, k: int) -> Side:
        inside = slice(self.starts[k], self.ends[k])
        return Side(self.values[inside], self.counts[inside], int(self.before[k]), int(self.total[k]))

    def some(self, first: int, last: int) -> Sides:
        """The candidates from one to before another."""
        inside = slice(self.starts[first], self.ends[last - 1])
        of = slice(first, last)
        return Sides(self.values[inside], self.counts[inside], self.ends[of] - self.starts[first], self.before[of], self.total[of])

    def batches(self, rows: int = BATCH_ROWS) -> list[Sides]:
        """Candidates in their order, as many together as have about so many values and marks."""
        upto = (self.ends + np.arange(1, len(self.ends) + 1)) // rows
        cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(self.ends)]
        return [self.some(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


@dataclass(frozen=True)
class PairMetric:
    """``part(predicted, observed, low, high)`` for a range of values, open ends as infinities; ``finish`` turns the sum into the distance.

    ``parts`` gives the same for all of some :class:`Sides`; without it they go one by one.
    """

    part: Callable[[Side, Side, float, float], float]
    finish: Callable = lambda total: total
    parts: Callable[[Sides, Side, float, float], np.ndarray] | None = None

    def of_all(self, predicted: Sides, observed: Side, low: float, high: float) -> np.ndarray:
        if self.parts is None:
            return np.array([self.part(predicted.side(k), observed, low, high) for k in range(len(predicted.ends))], float)
        return np.concatenate([np.zeros(0), *[self.parts(b, observed, low, high) for b in predicted.batches()]])


@dataclass(frozen=True)
class _Area:
    """Integrals of a side's distribution function over values, asked for at any of them by one search.

    Up to a value are meant the values from the first edge; sums are kept long, as parts are
    differences of them.
    """

    edges: np.ndarray
    share: np.ndarray  # of the side, from each edge to the next; first, below all edges
    first: np.ndarray  # integral of the share, up to each edge
    second: np.ndarray  # of its square

    def at(self, x: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Both integrals up to ``x``, whose place among the edges may be known."""
        place = np.searchsorted(self.edges, x, "right") if place is None else place
        known = np.maximum(place - 1, 0)
        share, beyond = self.share[place], x - self.edges[known].astype(np.longdouble)
        return self.first[known] + share * beyond, self.second[known] + share * share * beyond

    def reaches(self, share: np.ndarray) -> np.ndarray:
        """The value from which on the side's share is at least the given one; infinite where it never is."""
        place = np.searchsorted(self.share, share, "left")
        return np.concatenate([[-np.inf], self.edges, [np.inf]])[place]


def _area(side: Side) -> _Area:
    share = (side.before + np.concatenate([[0], np.cumsum(side.counts)])) / np.longdouble(side.total)
    widths, start = np.diff(side.values.astype(np.longdouble)), np.zeros(1, np.longdouble)
    first = np.concatenate([start, np.cumsum(share[1:-1] * widths)])
    second = np.concatenate([start, np.cumsum(share[1:-1] * share[1:-1] * widths)])
    return _Area(side.values, share, first, second)


def _gaps(predicted: Side, observed: Side, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Between all values of a range: the difference of both distribution functions, and the widths."""
    x = np.union1d(predicted.values, observed.values)
    edges = np.concatenate([[low] if np.isfinite(low) else [], x, [high] if np.isfinite(high) else []])

    def share(side: Side) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(side.counts)])
        return (side.before + upto[np.searchsorted(side.values, edges[:-1], "right")]) / side.total

    return share(predicted) - share(observed), np.diff(edges)


def _endless(side: Side) -> bool:
    """Whether a side holds an infinite value, to which no area reaches."""
    return len(side.values) > 0 and not np.isfinite(side.values[[0, -1]]).all()


@dataclass(frozen=True)
class _Steps:
    """The stretches of a range on which a predicted share stays the same, of one candidate after the other.

    A candidate has one more than values. Edges are theirs and where each candidate's first
    and last stretch begin and end; ``place`` has those of the edges among the observed ones.
    """

    share: np.ndarray
    edges: np.ndarray
    place: np.ndarray
    start: np.ndarray  # the edge at which a stretch begins; the next ends it
    first: np.ndarray  # the first stretch of every candidate

    def summed(self, amounts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(amounts, self.first).astype(float)


def _steps(predicted: Sides, observed: Side, low: float, high: float) -> _Steps:
    n, candidates = len(predicted.values), np.arange(len(predicted.ends))
    sizes = predicted.ends - predicted.starts
    known = np.concatenate([observed.values[[0, -1]], [v for v in (low, high) if np.isfinite(v)]])
    least, most = (np.full(len(candidates), v) for v in (known.min(), known.max()))
    filled = sizes > 0
    least[filled] = np.minimum(least[filled], predicted.values[predicted.starts[filled]])
    most[filled] = np.maximum(most[filled], predicted.values[predicted.ends[filled] - 1])
    owner, row = np.repeat(candidates, sizes), np.arange(n)
    first = predicted.starts + candidates
    edges = np.empty(n + 2 * len(candidates))
    edges[row + 2 * owner + 1] = predicted.values
    edges[first + candidates], edges[predicted.ends + 2 * candidates + 1] = least, most
    upto = np.concatenate([[0], np.cumsum(predicted.counts)])
    below = np.empty(n + len(candidates), np.int64)
    below[first] = predicted.before
    below[row + owner + 1] = (predicted.before - upto[predicted.starts])[owner] + upto[1:]
    whose = np.repeat(candidates, sizes + 1)
    share = below / predicted.total.astype(np.longdouble)[whose]
    return _Steps(share, edges, np.searchsorted(observed.area.edges, edges, "right"), np.arange(n + len(candidates)) + whose, first)


def _by_steps(parts: Callable, power: int) -> Callable:
    """Parts of all candidates by their steps; where a side has an infinite value, or no observed one lies in the range, by its gaps."""

    def all_parts(predicted: Sides, observed: Side, low: float, high: float) -> np.ndarray:
        def apart(side: Side) -> float:
            gap, width = _gaps(side, observed, low, high)
            return float(np.sum(np.abs(gap) * width if power == 1 else 2 * gap * gap * width))

        if not len(observed.values) or _endless(observed):
            return np.array([apart(predicted.side(k)) for k in range(len(predicted.ends))], float)
        if not np.isfinite(predicted.values).all():
            sides = [predicted.side(k) for k in range(len(predicted.ends))]
            return np.array([apart(s) if _endless(s) else all_parts(Sides.of(s), observed, low, high)[0] for s in sides])
        return parts(_steps(predicted, observed, low, high), observed.area)

    return all_parts


def _earth_parts(steps: _Steps, area: _Area) -> np.ndarray:
    share, start, end = steps.share, steps.edges[steps.start], steps.edges[steps.start + 1]
    upto, _ = area.at(steps.edges, steps.place)
    a, b = upto[steps.start], upto[steps.start + 1]
    # the observed share rises: it is below the predicted one up to the turn, and above beyond it
    place = steps.place[steps.start + 1]
    inside = place - ((place > 0) & (area.edges[np.maximum(place - 1, 0)] == end))  # just below the end
    above = area.share[steps.place[steps.start]] >= share
    turn, t = np.where(above, start, end).astype(np.longdouble), np.where(above, a, b)
    search = np.flatnonzero(~above & (area.share[inside] >= share))
    turn[search] = np.clip(area.reaches(share[search]), start[search], end[search])
    t[search], _ = area.at(turn[search])
    return steps.summed(share * ((turn - start) - (end - turn)) - (t - a) + (b - t))


def _energy_parts(steps: _Steps, area: _Area) -> np.ndarray:
    share = steps.share
    width = np.diff(steps.edges.astype(np.longdouble))[steps.start]
    first, second = (np.diff(v)[steps.start] for v in area.at(steps.edges, steps.place))
    return np.maximum(0.0, 2 * steps.summed(share * share * width - 2 * share * first + second))


def _whole(parts: Callable, finish: Callable = lambda total: total) -> PairMetric:
    """A metric that is given for many candidates at once."""
    return PairMetric(lambda predicted, observed, low, high: float(parts(Sides.of(predicted), observed, low, high)[0]), finish, parts)


#: The least work that turns one sample into the other: the first Wasserstein distance.
EARTH_MOVERS = _whole(_by_steps(_earth_parts, 1))
#: The energy distance.
ENERGY = _whole(_by_steps(_energy_parts, 2), F.sqrt)


def _cells(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The values of a sample, where they are."""
    valid = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return valid.select(*[_same(df, c).alias(c) for c in groups], F.col(value).cast("double").alias("__x"))


def _same(df: DataFrame, name: str) -> Column:
    """A column of a key, whose equal floats are made the same bits, as a grouping does."""
    column, kind = F.col(name), df.schema[name].dataType
    if not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType):
        return column
    zero, nan = F.lit(0.0).cast(kind), F.lit(float("nan")).cast(kind)
    return F.when(column == zero, zero).when(F.isnan(column), nan).otherwise(column)


def _plain(df: DataFrame, groups: Sequence[str]) -> bool:
    """Whether rows of a group can be told by their bits, without a grouping."""
    kinds = [df.schema[c].dataType for c in groups]
    return all(isinstance(k, (*PLAIN, T.FractionalType)) or k == T.StringType() for k in kinds)


def _counted(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Equal values of a sample as one row, before anything is dealt out."""
    return _cells(df, groups, value).groupBy(*groups, "__x").agg(F.count(F.lit(1)).alias("__c"))


def _cuts(rows: DataFrame, sizes: DataFrame, groups: Sequence[str], keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Values that cut the hot samples among ``rows`` into pieces of about half the bound: (keys, cut)."""
    most = sizes.agg(F.max("__rows")).first()[0] or 0
    if most <= hot_rows:
        return None
    pieces = -(-2 * most // hot_rows)
    hot = sizes.filter(F.col("__rows") > hot_rows).select(*groups)
    shares = [i / pieces for i in range(1, pieces)]
    drawn = match(rows, hot, groups, "left_semi", broadcast=True)  # one row for every hot_rows rows at most
    at = drawn.groupBy(*groups).agg(F.percentile_approx("__x", shares, 100 * pieces).alias("__at"))
    return at.select(*keys, F.explode("__at").alias("__cut"))


def pair_distances(
    predicted: DataFrame, observed: DataFrame, keys: Sequence[str], sample: Sequence[str], value: str, metric: PairMetric, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``ad`` and ``n`` of every predicted sample (``sample`` and ``keys``) against the observed one of its keys.

    Null and NaN values are left out; a key without an observed value has no row. Predicted
    cells move once, to the tasks of their key and range, and are read anew by each pass;
    only where a sample has more than ``hot_rows`` of them are they counted by value first
    and settled, as observed ones always are. The ranges are those that hot samples need,
    the tasks of a range as many as its predicted rows fill. Observed values of a range
    are copied to each of those, in lists. Results do not depend on ``hot_rows``.
    """
    keys, sample = list(keys), list(sample)
    groups = [*sample, *keys]
    o = settle(_counted(observed, keys, value))
    counts = [F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__rows")]
    o_sizes = settle(o.groupBy(*keys).agg(*counts))
    p = _cells(predicted, groups, value)
    found, largest = [_cuts(o, o_sizes, keys, keys, hot_rows)], None
    if _plain(predicted, groups):
        p = p.withColumn("__c", F.lit(1).cast("bigint"))
        p_sizes, seen = settle_observed(p.groupBy(*groups).agg(*counts), largest=F.max("__rows"))
        largest = seen["largest"] or 0
    if largest is None or largest > hot_rows:
        p = settle(_counted(predicted, groups, value))
        p_sizes = settle(p.groupBy(*groups).agg(*counts))
        found.append(_cuts(p, p_sizes, groups, keys, hot_rows))
    found = [c for c in found if c is not None]

    def tasks(rows: Column, candidates: Column) -> Column:
        return F.ceil((rows + candidates) / F.lit(hot_rows)).cast("int")

    own = p_sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__candidates"), F.sum("__rows").alias("__held"))
    plan = match(o_sizes.select(*keys, F.col("__n").alias("__m")), own, keys, "inner", broadcast=False)
    if found:
        merged = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        listed = merged.groupBy(*keys).agg(F.array_sort(F.collect_set("__cut")).alias("__cuts"))
        plan = match(plan, listed, keys, "left", broadcast=False)
        plan = plan.withColumn("__cuts", F.coalesce("__cuts", F.array().cast("array<double>")))
    else:
        plan = plan.withColumn("__cuts", F.array().cast("array<double>"))
    plan = settle(plan.withColumn("__deals", F.array(tasks(F.col("__held"), F.col("__candidates")))).drop("__held"))
    few, deepest = plan.agg(F.sum(64 + 16 * F.size("__cuts")), F.max(F.size("__cuts"))).first()
    small, deepest = (few or 0) <= 64 << 20, deepest or 0

    def ranged(df: DataFrame) -> DataFrame:
        """With the key's plan and the range that a value lies in: the number of cuts up to it, by halving."""
        rows = match(df, plan, keys, "inner", broadcast=small).withColumn("__range", F.lit(0))
        for step in [2**k for k in reversed(range(int(deepest).bit_length()))]:
            further = F.get("__cuts", F.col("__range") + (step - 1)) <= F.col("__x")
            rows = rows.withColumn("__range", F.col("__range") + F.when(further, step).otherwise(0))
        return rows

    def below(held: DataFrame, owners: DataFrame, by: Sequence[str]) -> DataFrame:
        """For every owner and range of its key: the count of its values below the range, also where it has none inside."""
        slots = match(owners, plan, keys, "inner", broadcast=small).withColumn("__range", F.explode(F.sequence(F.lit(0), F.size("__cuts"))))
        filled = match(slots, held, [*by, "__range"], "left", broadcast=False)
        earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        return filled.withColumn("__before", F.coalesce(F.sum("__held").over(earlier), F.lit(0)))

    if deepest:
        # a range is dealt to as many tasks as its own predicted rows and marks fill, so copies of observed cells grow as the cells do
        inside = ranged(p).groupBy(*groups, "__range").agg(F.sum("__c").alias("__held"), F.count(F.lit(1)).alias("__rows"))
        p_held = settle(inside)
        ranges = plan.withColumn("__range", F.explode(F.sequence(F.lit(0), F.size("__cuts"))))
        filled = match(ranges, p_held.groupBy(*keys, "__range").agg(F.sum("__rows").alias("__rows")), [*keys, "__range"], "left", broadcast=False)
        deals = filled.select(*keys, F.struct("__range", tasks(F.coalesce("__rows", F.lit(0)), F.col("__candidates")).alias("__deals")).alias("__deal"))
        listed = deals.groupBy(*keys).agg(F.array_sort(F.collect_list("__deal"))["__deals"].alias("__deals"))
        plan = settle(match(plan.drop("__deals"), listed, keys, "inner", broadcast=False))

    deals = F.get("__deals", F.col("__range"))
    deal = F.pmod(F.xxhash64(*sample), deals).cast("int") if sample else F.lit(0)
    each = F.explode(F.sequence(F.lit(0), deals - 1)).alias("__deal")
    low = F.coalesce(F.get("__cuts", F.col("__range") - 1), F.lit(float("-inf")))
    high = F.coalesce(F.get("__cuts", F.col("__range")), F.lit(float("inf")))
    none, tile = F.lit(None), [*keys, "__deal", "__range"]
    left = ranged(p).select(*groups, deal.alias("__deal"), "__range", "__x", "__c")
    placed = ranged(o)
    block = F.pmod(F.xxhash64("__x"), F.lit(BLOCKS)).alias("__block")
    lists = placed.groupBy(*keys, "__range", block).agg(F.collect_list(F.struct("__x", "__c")).alias("__list"))
    right = match(lists, plan, keys, "inner", broadcast=small).select(*keys, each, "__range", "__list")
    if deepest:  # marks say what lies below a range, and so how large a sample is
        unknown = [none.cast("bigint").alias(c) for c in ("__before", "__n")]
        edges = [none.cast("double").alias(c) for c in ("__low", "__high")]
        nothing = [none.cast(t).alias(c) for c, t in (("__x", "double"), ("__c", "bigint"))]
        p_marks = below(p_held.select(*groups, "__range", "__held"), p_sizes.select(*groups, "__n"), groups)
        left = left.select("*", *unknown).unionByName(p_marks.select(*groups, deal.alias("__deal"), "__range", *nothing, "__before", "__n"))
        o_held = placed.groupBy(*keys, "__range").agg(F.sum("__c").alias("__held"))
        o_marks = below(o_held, o_sizes.select(*keys, "__n"), keys)
        right = right.select("*", *unknown, *edges).unionByName(
            o_marks.select(*keys, each, "__range", none.cast(right.schema["__list"].dataType).alias("__list"), "__before", "__n", low.alias("__low"), high.alias("__high"))
        )
    fields = [predicted.schema[c] for c in groups]
    schema = T.StructType([*fields, T.StructField("__part", T.DoubleType()), T.StructField("n", T.LongType())])

    def parts(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows, found, totals = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if theirs.num_rows and mine.num_rows:
            sides, rows = _sides(mine, sample)
            other, bounds = _other(theirs)
            found, totals = metric.of_all(sides, other, *bounds), sides.total
        arrays = [mine.column(c).take(pa.array(rows, pa.int64())) for c in groups]
        return pa.Table.from_arrays([*arrays, pa.array(found, pa.float64()), pa.array(totals, pa.int64())], [*groups, "__part", "n"])

    right = right.toDF(*right.columns)  # both samples may come from one table
    summed = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(parts, schema)
    totals = summed.groupBy(*groups).agg(F.sum("__part").alias("__total"), F.max("n").alias("n"))
    return totals.select(*groups, "n", metric.finish(F.col("__total")).alias("ad"))


def _numbered(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """A number for every row, the same for those equal in all columns."""
    numbers = np.zeros(table.num_rows, np.int64)
    for c in columns:
        coded = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        wide = numbers * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        numbers = wide if len(columns) == 1 else np.unique(wide, return_inverse=True)[1]
    return numbers


def _sides(mine: pa.Table, sample: Sequence[str]) -> tuple[Sides, np.ndarray]:
    """All candidates of a task's range, and a row of each. Equal values are counted here where they were not before."""
    numbers = _numbered(mine, sample)
    if len(numbers) and numbers.max() < 1 << 16:
        numbers = numbers.astype(np.uint16)  # sorted by digits
    x, c = mine.column("__x"), mine.column("__c")
    marked = x.is_null().to_numpy() if "__n" in mine.column_names else None
    x = x.to_numpy()
    order = np.argsort(x)  # marks, which have no value, come last
    order = order[np.argsort(numbers[order], kind="stable")]
    numbers, x = numbers[order], x[order]
    firsts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))  # of every candidate
    lasts = np.concatenate([firsts[1:], [len(order)]]) - 1
    fresh = np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (x[1:] != x[:-1])])  # of every value
    c = c.fill_null(0).to_numpy()[order]
    if marked is not None:
        marks = order[lasts]  # the last row of every candidate
        before, total = (mine.column(name).take(pa.array(marks)).to_numpy() for name in ("__before", "__n"))
        values = np.flatnonzero(fresh & ~marked[order])
        counts = np.add.reduceat(c, np.flatnonzero(fresh))[np.searchsorted(np.flatnonzero(fresh), values)]
    else:
        values = np.flatnonzero(fresh)
        counts = np.add.reduceat(c, values)
        before, total = np.zeros(len(firsts), np.int64), np.add.reduceat(c, firsts)
    ends = np.searchsorted(values, lasts, "right")
    return Sides(x[values], counts, ends, before, total), order[lasts]


def _other(theirs: pa.Table) -> tuple[Side, tuple[float, float]]:
    """The observed side of a task's range, and its bounds."""
    entries = theirs.column("__list").combine_chunks().flatten()
    x, c = (entries.field(name).to_numpy() for name in ("__x", "__c"))
    order = np.argsort(x)
    if "__n" not in theirs.column_names:
        return Side(x[order], c[order], 0, int(c.sum())), (-np.inf, np.inf)
    mark = int(np.flatnonzero(theirs.column("__n").is_valid().to_numpy())[0])
    before, total, low, high = (theirs.column(name)[mark].as_py() for name in ("__before", "__n", "__low", "__high"))
    return Side(x[order], c[order], before, total), (low, high)
