"""Key values are strings; whole numbers are written without a fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm_key_value(value) -> str | None:
    """A Python key value as the store writes it: 1.0 and 1 are both '1'."""
    if value is None:
        return None
    if hasattr(value, "item") and not isinstance(value, str):
        value = value.item()
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return str(value)


def typed_key_value(text: str | None):
    """Back to a number, only where writing that number gives the same text again."""
    if text is None:
        return None
    for kind in (int, float):
        try:
            value = kind(text)
        except ValueError:
            continue
        if str(value) == text:
            return value
    return text


def norm_key(column: Column, kind: T.DataType) -> Column:
    """`norm_key_value` as a column expression."""
    text = column.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 2.0**63)
        return F.when(whole, column.cast("long").cast("string")).otherwise(text)
    return text


def norm_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with its key columns normalized."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({k: norm_key(F.col(f"`{k}`"), kinds[k]) for k in keys if k in kinds})


def typed_key(column: Column) -> Column:
    """The key as a double where it is a number written plainly, else null."""
    whole = F.try_to_number(column, F.lit("S999999999999999999"))
    number = column.try_cast("double")
    return F.when(whole.isNotNull() & (whole.cast("string") == column), whole.cast("double")).when(number.cast("string") == column, number)
