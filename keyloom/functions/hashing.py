"""Content identity: the first 16 hex digits of a SHA-256 over a tagged serialization."""

from __future__ import annotations

import hashlib
import inspect
import json
from datetime import date, datetime, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 16


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:DIGITS]


def serialize(value) -> bytes:
    """The same bytes for the same content. Plain values are their JSON text; all else is a tag, a count and
    its parts, each after its length, so that no two contents run into the same bytes."""
    if isinstance(value, np.generic) or (isinstance(value, np.ndarray) and value.ndim == 0):
        value = value.item()
    if value is None or isinstance(value, (bool, int, float, str)):
        return json.dumps(value).encode()
    if isinstance(value, dict):
        return _framed("map", sorted(_framed("entry", [serialize(k), serialize(v)]) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return _framed("list" if isinstance(value, list) else "row", map(serialize, value))
    if isinstance(value, np.ndarray):
        cells = [np.ascontiguousarray(value).tobytes()] if value.dtype != object else map(serialize, value.ravel())
        return _framed("array", [str(value.dtype).encode(), str(value.shape).encode(), *cells])
    if isinstance(value, pd.DataFrame):
        return _framed("table", [p for c in value.columns for p in (serialize(str(c)), serialize(value[c].to_numpy()))])
    if isinstance(value, pd.Series):
        return _framed("column", [serialize(str(value.name)), serialize(value.to_numpy())])
    if isinstance(value, (bytes, bytearray)):
        return _framed("bytes", [bytes(value)])
    if isinstance(value, (datetime, date, timedelta, Decimal)):
        return _framed(type(value).__name__, [str(value).encode()])
    raise TypeError(f"no stable content of a {type(value).__name__}; save it by a codec")


def _framed(tag: str, parts) -> bytes:
    parts = list(parts)
    return b"".join([f"<{tag} {len(parts)}>".encode(), *(f"{len(p)}:".encode() + p for p in parts)])


def canonical_hash(value) -> str:
    return _digest(serialize(value))


def record_id(name: str, version: int, content_hash: str, metadata: dict) -> str:
    """Identity of a saved value: what it is, of which variable, at which normalized address."""
    return _digest(f"{name}|{version}|{content_hash}|{canonical_hash({str(k): str(v) for k, v in metadata.items()})}".encode())


def function_hash(function) -> str:
    """Hash of a function's source, or of its code and constants where there is no source."""
    try:
        return _digest(inspect.getsource(function).encode())
    except (OSError, TypeError):
        code = function.__code__
        return _digest(code.co_code + repr(code.co_consts).encode())


def digest(*parts: Column) -> Column:
    """The same digest over columns, JVM-side; parts are joined by '|'."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256), 1, DIGITS)


def content_digest(column: Column, kind: str) -> Column:
    """Canonical hash of a column's values: that of `canonical_hash` for whole numbers and booleans, and for
    other kinds one over their JSON text, so that equal values have equal hashes without leaving the JVM."""
    plain = kind in ("tinyint", "smallint", "int", "bigint", "boolean")
    text = F.coalesce(column.cast("string"), F.lit("null")) if plain else F.to_json(F.array(column))
    return F.substring(F.sha2(text, 256), 1, DIGITS)
