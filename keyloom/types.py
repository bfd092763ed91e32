"""Python values as rows of columns, and back."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import types as T

#: numpy kinds and sizes; unsigned ones are widened.
_NUMPY = {
    "f4": T.FloatType(), "f8": T.DoubleType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(),
    "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0), "b1": T.BooleanType(),
}


def spark_type(value) -> tuple[T.DataType, dict]:
    """The Spark type of a value and the recipe to read it back."""
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, np.ndarray):
        base = _NUMPY.get(value.dtype.str[1:], T.StringType())
        if value.ndim >= 3:
            return T.StringType(), {"kind": "json_array", "dtype": str(value.dtype)}
        kind = base
        for _ in range(value.ndim):
            kind = T.ArrayType(kind)
        return kind, {"kind": "ndarray", "dtype": str(value.dtype), "ndim": value.ndim}
    for python, kind in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (datetime, T.TimestampNTZType()), (date, T.DateType()), (timedelta, T.DayTimeIntervalType())):
        if isinstance(value, python):
            return kind, {"kind": "scalar"}
    if isinstance(value, list):
        if not value or all(isinstance(v, str) for v in value):
            return T.ArrayType(T.StringType()), {"kind": "list"}
        if all(isinstance(v, (list, np.ndarray)) for v in value):
            return T.ArrayType(T.ArrayType(T.DoubleType())), {"kind": "list"}
        if all(isinstance(v, (bool, int, float, np.number)) for v in value):
            return T.ArrayType(T.DoubleType()), {"kind": "list"}
        raise TypeError("a list must hold only numbers, only texts or only lists")
    if isinstance(value, dict):
        return T.StringType(), {"kind": "json"}
    return T.StringType(), {"kind": "json" if value is not None else "scalar"}


def to_cell(value, kind: T.DataType):
    """A value as Spark takes it."""
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(kind, T.StringType) and not isinstance(value, (str, type(None))):
        return json.dumps(value.tolist() if isinstance(value, np.ndarray) else value, sort_keys=True, default=_plain)
    if isinstance(value, np.ndarray):
        value = value.tolist()
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType):
        return [None if v is None else float(v) for v in value]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        return [to_cell(np.asarray(v).tolist(), kind.elementType) for v in value]
    return value


def _plain(value):
    return value.tolist() if isinstance(value, (np.ndarray, np.generic)) else str(value)


def from_cell(cell, recipe: dict):
    if cell is None:
        return None
    if recipe["kind"] == "ndarray":
        return np.array(cell, dtype=recipe["dtype"])
    if recipe["kind"] == "json_array":
        return np.array(json.loads(cell), dtype=recipe["dtype"])
    return json.loads(cell) if recipe["kind"] == "json" else cell


def flatten(value: dict, prefix: str = "") -> dict:
    """Nested dicts as one with dotted names; arrays of one element as that element."""
    out = {}
    for k, v in value.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}.")
        else:
            out[f"{prefix}{k}"] = v.item() if isinstance(v, np.ndarray) and v.size == 1 else v
    return out


def unflatten(value: dict) -> dict:
    out: dict = {}
    for name, v in value.items():
        *path, last = name.split(".")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return out


def is_tabular(value) -> bool:
    """Whether a dict is a table by columns: flat arrays or lists of plain values, all of one length above 1."""
    if not isinstance(value, dict) or not value:
        return False
    for v in value.values():
        if isinstance(v, np.ndarray) and v.ndim == 1 and v.dtype != object:
            continue
        if not isinstance(v, list) or any(isinstance(x, (list, dict, np.ndarray)) for x in v):
            return False
    sizes = {len(v) for v in value.values()}
    return len(sizes) == 1 and sizes.pop() > 1


def encode(value) -> tuple[list[tuple], T.StructType, dict]:
    """(rows, columns, recipe) of a value: a table has a row for each of its own, all else one row."""
    if isinstance(value, pd.DataFrame):
        kinds, recipes = {}, {}
        for c in value.columns:
            cell = next((v for v in value[c] if v is not None and v == v), None) if len(value) else None
            kinds[str(c)], recipes[str(c)] = spark_type(cell) if cell is not None else (T.StringType(), {"kind": "scalar"})
        rows = [tuple(None if v is None or v is pd.NaT else to_cell(v, k) for v, k in zip(r, kinds.values())) for r in value.itertuples(index=False)]
        return rows, T.StructType([T.StructField(n, k) for n, k in kinds.items()]), {"mode": "table", "columns": recipes}
    if is_tabular(value):
        rows, columns, recipe = encode(pd.DataFrame({k: list(v) for k, v in value.items()}))
        kinds = {k: ["ndarray", str(v.dtype)] if isinstance(v, np.ndarray) else ["list", None] for k, v in value.items()}
        return rows, columns, recipe | {"mode": "tabular", "kinds": kinds}
    if isinstance(value, dict) and value:
        flat = flatten(value)
        found = {n: spark_type(v) for n, v in flat.items()}
        row = tuple(to_cell(v, found[n][0]) for n, v in flat.items())
        return [row], T.StructType([T.StructField(n, k) for n, (k, _) in found.items()]), {"mode": "dict", "columns": {n: r for n, (_, r) in found.items()}}
    kind, recipe = spark_type(value)
    return [(to_cell(value, kind),)], T.StructType([T.StructField("value", kind)]), {"mode": "value", "columns": {"value": recipe}}


def decode(rows: list[dict], recipe: dict):
    """The value that `encode` made these rows of."""
    columns = recipe["columns"]
    if recipe["mode"] == "table":
        return pd.DataFrame([{n: from_cell(r[n], c) for n, c in columns.items()} for r in rows], columns=list(columns))
    if recipe["mode"] == "tabular":
        columns_of = {n: [from_cell(r[n], c) for r in rows] for n, c in columns.items()}
        return {n: np.array(v, dtype=recipe["kinds"][n][1]) if recipe["kinds"][n][0] == "ndarray" else v for n, v in columns_of.items()}
    if recipe["mode"] == "dict":
        return unflatten({n: from_cell(rows[0][n], c) for n, c in columns.items()})
    return from_cell(rows[0]["value"], columns["value"])
