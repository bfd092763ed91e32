"""The newest row per key: the one window of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, by: list[str], newest: str | Column, tie: str | Column, n: int = 1) -> DataFrame:
    """The `n` newest rows per `by`; equal times go to the greater `tie`. Null keys are a key of their own.

    Spark limits each group before the shuffle (WindowGroupLimit), so that hot groups stay small.
    """
    newest, tie = (F.col(c) if isinstance(c, str) else c for c in (newest, tie))
    order = Window.partitionBy(*by).orderBy(newest.desc_nulls_last(), tie.desc_nulls_last())
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).drop("__rank")


def excluded(df: DataFrame, exclusions: DataFrame, key: str = "record_id") -> DataFrame:
    """df without the records whose latest exclusion event says so.

    exclusions: (key, timestamp, excluded). Applied before ranking, so that excluding the
    newest version exposes the one before it.
    """
    now = latest(exclusions, [key], "timestamp", F.col("excluded").cast("int")).where("excluded").select(key)
    return df.join(now, key, "left_anti")


def head(df: DataFrame, n: int, newest: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(newest).desc_nulls_last(), F.col(tie).desc_nulls_last()).limit(n)
