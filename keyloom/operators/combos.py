"""Key combinations to iterate over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import norm_key_value, typed_key


def distinct_values(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)


def distinct_combos(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).dropna(how="any").distinct().orderBy(*keys)


def distinct_from(inputs: list[DataFrame], key: str) -> DataFrame:
    """Values of a key over all inputs that have it; an error if none has."""
    found = [df.select(F.col(key).cast("string").alias(key)) for df in inputs if key in df.columns]
    if not found:
        raise ValueError(f"no input has the key {key!r}")
    return distinct_values(reduce(DataFrame.unionByName, found), key)


def product(spark: SparkSession, keys: dict[str, list | DataFrame]) -> DataFrame:
    """All combinations of the keys' values; a key's values are a list or a one-column table."""
    sides = [v if isinstance(v, DataFrame) else spark.createDataFrame([(norm_key_value(x),) for x in v], f"`{k}` string") for k, v in keys.items()]
    return reduce(DataFrame.crossJoin, sides)


def existing(combos: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """The combinations that occur in `present`."""
    return combos.join(present.select(*keys).distinct(), keys, "left_semi")


def existing_null_safe(combos: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """The combinations that occur in `present`; null keys are equal."""
    return combos.join(present, [combos[k].eqNullSafe(present[k]) for k in keys], "left_semi")


def left_null_safe(combos: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """combos with the other columns of `marks` where it has the combination; null keys are equal."""
    named = marks.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    return combos.join(named, [combos[k].eqNullSafe(named[f"__k_{k}"]) for k in keys], "left").drop(*[f"__k_{k}" for k in keys])


def first_seen(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """The first row of each `by`, in the order of `position`."""
    order = Window.partitionBy(*by).orderBy(position)
    return df.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth").orderBy(position)


def in_schema_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by the keys from the coarsest to the finest, numbers as numbers."""
    return df.orderBy(*[c for k in keys for c in (typed_key(F.col(f"`{k}`").cast("string")).asc_nulls_last(), F.col(f"`{k}`").asc_nulls_last())])


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    on = [expected[k].eqNullSafe(actual[k]) for k in keys]
    return expected.join(actual.select(*keys).distinct(), on, "left_anti")
