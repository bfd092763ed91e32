"""Joins by order: points in intervals and intervals that overlap, as equi-joins on bins.

Where only counts and sums of an interval's points are asked for, no pairs are made: they are
differences of running totals at its two ends, so that the work goes by rows, not by pairs.

The line is cut into bins at quantiles of one side, so that bins hold about as many rows each
wherever the data lie. A point is in one bin; an interval goes along with every bin that it
touches; so a pair meets once, and nothing is compared outside its bins. A value that holds
more than a bin's share of the rows is several equal quantiles: its bin is dealt out by a
hash over as many parts, each of which gets the intervals.
"""

from __future__ import annotations

import re
import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins that the line is cut into, and the quantiles' relative rank error.
BINS, ACCURACY = 512, 10_000


def _number(value: Column, kind: str) -> Column:
    """A value as a double that orders as it does, ties allowed; times by their microseconds."""
    if kind == "timestamp_ntz":  # whatever the session's zone leaves out or has twice
        since = value.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return since.cast("interval second").cast("decimal(18,6)").cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return F.unix_date(value).cast("double") if kind == "date" else value.cast("double")


class Bins:
    """Bins over the values of a column, with how many parts each is dealt out to."""

    def __init__(self, df: DataFrame, column: str, bins: int = BINS):
        value = _number(F.col(f"`{column}`"), dict(df.dtypes)[column])
        shares = [k / bins for k in range(1, bins)]
        found = df.select(value.alias("v")).where("v IS NOT NULL AND NOT isnan(v)").agg(F.percentile_approx("v", shares, ACCURACY)).first()[0] or [0.0]
        self.edges = sorted(set(found))  # at most `bins`
        self.parts = [max(1, found.count(e)) for e in self.edges]
        self.kind = dict(df.dtypes)[column]

    def of(self, df: DataFrame, value: Column, out: str) -> DataFrame:
        """df with the number of the bin that the value lies in; null for null and NaN."""
        splits = [float("-inf"), *self.edges, float("inf")]
        name = f"{out}_{uuid.uuid4().hex[:8]}"
        numbered = df.withColumn(name, F.when(F.isnan(_number(value, self.kind)), None).otherwise(_number(value, self.kind)))
        binned = Bucketizer(splits=splits, inputCol=name, outputCol=out, handleInvalid="keep").transform(numbered)
        return binned.withColumn(out, F.when(F.col(name).isNotNull(), F.col(out).cast("int"))).drop(name)

    def part(self, bin_: Column, spread: Column) -> Column:
        """Which part of its bin a row goes to, by a hash."""
        return F.pmod(spread, self.counts(bin_)).cast("int")

    def counts(self, bin_: Column) -> Column:
        """How many parts a bin has. The bin above an edge begins with the edge's own value."""
        return F.element_at(F.array(*[F.lit(n) for n in [1, *self.parts]]), bin_ + 1)


def points_in_intervals(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, by: list[str] = (), closed: bool = False, bins: int = BINS) -> DataFrame:
    """Every pair of a point and an interval, start <= point < end (<= end if closed), with equal `by` columns.

    The two tables have no other column name in common. Null and NaN bounds and points, null
    `by` and empty intervals pair with nothing. Repeated rows are rows of their own.
    """
    cut = Bins(points, point, bins)
    at, low, high, part = ("__bin", "__low", "__high", "__part")
    binned = cut.of(points, F.col(f"`{point}`"), at).where(F.col(at).isNotNull())
    binned = binned.withColumn(part, cut.part(F.col(at), F.xxhash64(*[F.col(f"`{c}`") for c in points.columns if c != point] or [F.lit(0)])))
    spans = intervals.where(F.col(f"`{start}`") <= F.col(f"`{end}`"))
    spans = cut.of(cut.of(spans, F.col(f"`{start}`"), low), F.col(f"`{end}`"), high).where(F.col(low).isNotNull() & F.col(high).isNotNull())
    spans = spans.withColumn(at, F.explode(F.sequence(low, high))).drop(low, high)
    spans = spans.withColumn(part, F.explode(F.sequence(F.lit(0), cut.counts(F.col(at)) - 1)))
    inside = (F.col(f"`{point}`") >= F.col(f"`{start}`")) & ((F.col(f"`{point}`") <= F.col(f"`{end}`")) if closed else (F.col(f"`{point}`") < F.col(f"`{end}`")))
    return binned.join(spans, [*by, at, part]).where(inside).drop(at, part)


def sums_in_intervals(
    points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, sums: dict[str, str] | None = None, by: list[str] = (), closed: bool = False, bins: int = BINS, count: str = "n"
) -> DataFrame:
    """Every interval with the number of its points, as `points_in_intervals` pairs them, and sums over them.

    sums: names of the sums, with the columns of `points` that they are of: whole numbers or
    decimals, since differences of running totals are exact for these only; null counts as 0,
    and so does having no points. Sums of bigint are decimals, as running totals may be longer.
    Repeated rows are rows of their own. A value is one row of the running totals, however many
    points or ends it has; totals run within bins, and those of the bins before are added.
    """
    sums, kinds = dict(sums or {}), dict(points.dtypes)
    if wrong := [c for c in sums.values() if not re.match(r"(tinyint|smallint|int|bigint|decimal.*)$", kinds[c])]:
        raise TypeError(f"{wrong} are neither whole numbers nor decimals")
    wide = {n: re.sub(r"^\w+\(\d+", "decimal(38", kinds[c]) if kinds[c].startswith("decimal") else "decimal(38,0)" if kinds[c] == "bigint" else "bigint" for n, c in sums.items()}
    at, bin_, is_end, own, upto, before = "__at", "__bin", "__is_end", "__own_", "__upto_", "__before_"
    totals = [count, *sums]
    full = (F.col(f"`{start}`") <= F.col(f"`{end}`")) if closed else (F.col(f"`{start}`") < F.col(f"`{end}`"))
    zero = {n: F.lit(0).cast(wide.get(n, "bigint")) for n in totals}
    rows = points.select(*by, F.col(f"`{point}`").alias(at), F.lit(1).cast("bigint").alias(own + count), *[F.col(f"`{c}`").cast(wide[n]).alias(own + n) for n, c in sums.items()], F.lit(False).alias(is_end))
    for side in (start, end):
        rows = rows.union(intervals.where(full).select(*by, F.col(f"`{side}`").alias(at), *[zero[n].alias(own + n) for n in totals], F.lit(True).alias(is_end)))
    cut = Bins(rows, at, bins)
    values = rows.groupBy(*by, at).agg(*[F.coalesce(F.sum(own + n).cast(wide.get(n, "bigint")), zero[n]).alias(own + n) for n in totals], F.max(is_end).alias(is_end))
    values = cut.of(values, F.col(at), bin_).where(F.col(bin_).isNotNull())
    within, across = Window.partitionBy(*by, bin_).orderBy(at), Window.partitionBy(*by).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    running = values.withColumns({upto + n: F.sum(own + n).over(within) for n in totals}).where(is_end)
    whole = values.groupBy(*by, bin_).agg(*[F.sum(own + n).alias(own + n) for n in totals])  # at most `bins` rows for each `by`
    earlier = whole.select(*by, bin_, *[F.coalesce(F.sum(own + n).over(across), zero[n]).alias(before + n) for n in totals])
    ends = running.join(earlier, [*by, bin_])
    below = {n: F.col(before + n) + F.col(upto + n) - F.col(own + n) for n in totals}
    low = ends.select(*by, F.col(at).alias(start), *[below[n].alias(f"__low_{n}") for n in totals])
    high = ends.select(*by, F.col(at).alias(end), *[(below[n] + F.col(own + n) if closed else below[n]).alias(f"__high_{n}") for n in totals])
    found = intervals.join(low, [*by, start], "left").join(high, [*by, end], "left")
    between = {n: F.when(full, F.col(f"__high_{n}") - F.col(f"__low_{n}")).cast(wide.get(n, "bigint")) for n in totals}
    return found.select(*[F.col(f"`{c}`") for c in intervals.columns], *[F.coalesce(between[n], zero[n]).alias(n) for n in totals])


def overlaps(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], by: list[str] = (), bins: int = BINS) -> DataFrame:
    """Every pair of half-open intervals that share a point, with equal `by` columns.

    Either the right one starts in the left one, or the left one starts in the right one and
    later than it, so a pair is found once. Column names differ but for `by`. Empty intervals,
    nulls and NaN overlap with nothing.
    """
    (a, b), (c, d) = left_ends, right_ends
    lefts, rights = left.where(F.col(f"`{a}`") < F.col(f"`{b}`")), right.where(F.col(f"`{c}`") < F.col(f"`{d}`"))
    one = points_in_intervals(rights, lefts, c, a, b, by, bins=bins)
    other = points_in_intervals(lefts, rights, a, c, d, by, bins=bins).where(F.col(f"`{a}`") > F.col(f"`{c}`"))
    return one.unionByName(other)
