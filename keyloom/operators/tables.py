"""Combining and reshaping the tables of a combination: merge, fixed inputs, distribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_positional(parts: list[DataFrame], by: list[str], position: list[list[str | Column]], place: str | None = None) -> DataFrame:
    """Columns side by side, row by row in the order of `position` within each combination of `by`.

    A part with one row in a combination is repeated. Differing counts above one, and data
    columns in more than one part, are errors: the first when the plan runs, the second at
    once. Combinations that a part lacks are dropped. place: a column for the rows' places, from 1;
    a column of this name in a part only gives its order.
    """
    names = [c for p in parts for c in p.columns if c not in (*by, place)]
    if len(names) != len(set(names)):
        raise KeyError(f"columns in more than one part: {sorted({n for n in names if names.count(n) > 1})}")
    numbered = []
    for i, (part, order) in enumerate(zip(parts, position)):
        rows = part.withColumn("__pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        numbered.append(rows.withColumn(f"__n{i}", F.count(F.lit(1)).over(Window.partitionBy(*by))))
    sizes = [p.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) for p in parts]
    counted = reduce(DataFrame.unionAll, sizes).groupBy(*by).agg(F.max("n").alias("__n"), F.count(F.lit(1)).alias("__parts"))
    wanted = counted.where(F.col("__parts") == len(parts)).select(*by, "__n", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__pos"))
    out = wanted
    for part, rows, n in zip(parts, numbered, (f"__n{i}" for i in range(len(parts)))):
        data = [c for c in part.columns if c not in (*by, place)]
        many = rows.where(F.col(n) > 1).select(*by, "__pos", F.col(n).alias("__many"), *[F.col(c).alias(f"__m_{c}") for c in data])
        one = rows.where(F.col(n) == 1).select(*by, F.lit(True).alias("__one"), *[F.col(c).alias(f"__s_{c}") for c in data])
        out = out.join(many, [*by, "__pos"], "left").join(one, by, "left")
        fits = F.assert_true(F.col("__one").isNotNull() | F.col("__many").eqNullSafe(F.col("__n")), F.lit("parts of a merge differ in their number of rows"))
        picked = [F.when(F.col("__one").isNotNull(), F.col(f"__s_{c}")).otherwise(F.col(f"__m_{c}")).alias(c) for c in data]
        out = out.where(fits.isNull()).select(*wanted.columns, *[c for c in out.columns if c in names], *picked)
    return out.drop("__n").withColumnRenamed("__pos", place) if place else out.drop("__pos", "__n")


def merge_shared(parts: list[DataFrame]) -> DataFrame:
    """Natural inner join on all shared columns."""

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, [c for c in a.columns if c in b.columns])

    return reduce(join, parts)


def fixed(df: DataFrame, pinned: dict) -> DataFrame:
    """The slice at the pinned keys, without them, so that it joins on the others."""
    for key, value in pinned.items():
        df = df.where(F.col(key) == value)
    return df.drop(*pinned)


def distribute(df: DataFrame, column: str, key: str, start: int = 1) -> DataFrame:
    """One row per element of an array column; `key` counts the elements from `start`."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(column).alias("__at", column)).withColumn(key, F.col("__at") + start).select(*rest, key, column)


def concat_variants(variants: dict[str, DataFrame], name: str = "variant") -> DataFrame:
    """The rows of all variants under each other, labelled."""
    labelled = [df.withColumn(name, F.lit(label)) for label, df in variants.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def rolling_mean(df: DataFrame, by: list[str], order: list[str], column: str, rows: int, out: str) -> DataFrame:
    """Mean over this row and the rows - 1 before it, of fewer at the start."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(out, F.avg(column).over(frame))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, out: str) -> DataFrame:
    """Each left row with the right's last value at or before its time, by a union and a window."""
    one = left.withColumn("__side", F.lit(1)).withColumn("__value", F.lit(None).cast(dict(right.dtypes)[value]))
    two = right.select(*by, time, F.col(value).alias("__value"), F.lit(0).alias("__side"))
    frame = Window.partitionBy(*by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two, allowMissingColumns=True)
    return both.withColumn(out, F.last("__value", ignorenulls=True).over(frame)).where("__side = 1").drop("__side", "__value")
