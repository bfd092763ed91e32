"""Filters on a variable by its own columns or by another variable's values.

A filter is a tree; it is compiled into one lazy plan that reads the target once. Leaves that
name another variable restrict the target's locations: values of a coarser level hold for all
finer locations under them. What must hold is a semi join; under "or" and "not" every leaf
becomes a mark, by a left join, and the tree is evaluated over the marks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DatasetSchema

COMPARE = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
}


class Filter:
    def __and__(self, other: Filter) -> Filter:
        return Both(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Either(self, other)

    def __invert__(self) -> Filter:
        return self.inner if isinstance(self, Not) else Not(self)

    def __bool__(self):
        raise TypeError("combine filters with &, | and ~")


@dataclass(frozen=True, eq=False)
class Both(Filter):
    left: Filter
    right: Filter


@dataclass(frozen=True, eq=False)
class Either(Filter):
    left: Filter
    right: Filter


@dataclass(frozen=True, eq=False)
class Not(Filter):
    inner: Filter


@dataclass(frozen=True, eq=False)
class Compare(Filter):
    """column op value on the latest rows of `variable`; None means the target itself."""

    variable: str | None
    column: str
    op: str
    value: object

    def condition(self) -> Column:
        if self.op == "in":
            return F.col(f"`{self.column}`").isin(list(self.value)) if self.value else F.lit(False)
        return COMPARE[self.op](F.col(f"`{self.column}`"), F.lit(self.value))


@dataclass(frozen=True, eq=False)
class RawSql(Filter):
    """An SQL condition on the target's latest rows; what double quotes enclose, outside texts, is a name."""

    fragment: str

    def condition(self) -> Column:
        # quotes within a text in single quotes are its own
        parts = re.split(r"('(?:[^']|'')*')", self.fragment)
        named = [p if i % 2 else re.sub(r'"((?:[^"]|"")*)"', lambda m: "`" + m[1].replace('""', '"').replace("`", "``") + "`", p) for i, p in enumerate(parts)]
        return F.expr("".join(named))


def raw_sql(fragment: str) -> RawSql:
    return RawSql(fragment)


class Col:
    """A column of a table: Col('speed') > 1.2. Nulls compare like NaN: only != holds."""

    __hash__ = None

    def __init__(self, name: str):
        self.name = name

    def _compare(self, op: str, value) -> Compare:
        return Compare(None, self.name, op, value)

    def isin(self, values) -> Compare:
        return Compare(None, self.name, "in", tuple(values))


for _op, _method in {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}.items():
    setattr(Col, f"__{_method}__", lambda self, value, op=_op: self._compare(op, value))


def table_condition(tree: Filter) -> Column:
    """A tree over one table's columns as a plain boolean, null-free so that ~ flips it."""
    if isinstance(tree, Both):
        return table_condition(tree.left) & table_condition(tree.right)
    if isinstance(tree, Either):
        return table_condition(tree.left) | table_condition(tree.right)
    if isinstance(tree, Not):
        return ~table_condition(tree.inner)
    return F.coalesce(tree.condition(), F.lit(isinstance(tree, Compare) and tree.op == "!="))


def expand(target: DataFrame, coarse: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Target rows whose location lies under one of the coarse key tuples."""
    on = [target[k].eqNullSafe(coarse[k]) for k in keys]
    return target.join(coarse, on, how)


def resolve(tree: Filter, target: DataFrame, schema: DatasetSchema, values: Callable[[str], tuple[DataFrame, list[str]]], validate: bool = True, level: list[str] | None = None) -> DataFrame:
    """Target rows that the tree lets pass.

    target: latest rows with the schema's key columns; level: those keys that the target is
    saved at, if not all it has. values(name) gives a variable's latest
    rows and its level's keys. A filter variable finer than the target, or one that lacks a
    location of the target, is an error; validate=False skips the second check, which costs
    a job.
    """
    keys = level or [k for k in schema.keys if k in target.columns]
    if isinstance(tree, Both):
        return resolve(tree.right, resolve(tree.left, target, schema, values, validate, keys), schema, values, validate, keys)
    if isinstance(tree, (Either, Not)):
        marked, passed, _ = _marked(tree, target, schema, values, validate, keys)
        return marked.where(passed).select(*[F.col(f"`{c}`") for c in target.columns])
    if isinstance(tree, RawSql) or tree.variable is None:
        return target.where(tree.condition())
    passing, own = _passing(tree, target, schema, values, validate, keys)
    return expand(target, passing, own)


def _passing(tree: Compare, target: DataFrame, schema: DatasetSchema, values, validate: bool, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """The locations at which another variable passes, and its keys."""
    other, own = values(tree.variable)
    if schema.depth(own) > schema.depth(keys):
        raise ValueError(f"{tree.variable} is saved at a finer level than the target: {own} below {keys}")
    if tree.column not in other.columns:
        raise ValueError(f"{tree.variable} has no column {tree.column!r}")
    if validate and (lost := uncovered(target, other, own).first()) is not None:
        raise ValueError(f"{tree.variable} has no value at {lost.asDict()}")
    return other.where(tree.condition()).select(*own).distinct(), own


def _marked(tree: Filter, target: DataFrame, schema: DatasetSchema, values, validate: bool, keys: list[str]) -> tuple[DataFrame, Column, bool]:
    """The target with marks, whether the tree holds in a row, and whether that is the same for all rows of a location."""
    if isinstance(tree, RawSql) or (isinstance(tree, Compare) and tree.variable is None):
        return target, F.coalesce(tree.condition(), F.lit(False)), False
    if isinstance(tree, Compare):
        passing, own = _passing(tree, target, schema, values, validate, keys)
        mark = f"__mark{len(target.columns)}"
        side = passing.select(*[F.col(f"`{k}`").alias(f"{mark}_{k}") for k in own], F.lit(True).alias(mark))
        joined = target.join(side, [target[k].eqNullSafe(side[f"{mark}_{k}"]) for k in own], "left").drop(*[f"{mark}_{k}" for k in own])
        return joined, F.coalesce(F.col(mark), F.lit(False)), True

    def anywhere(rows: DataFrame, condition: Column, same: bool) -> tuple[DataFrame, Column]:
        """Whether it holds in some row of the location."""
        if same:
            return rows, condition
        mark = f"__mark{len(rows.columns)}"
        return rows.withColumn(mark, F.max(condition).over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]))), F.col(mark)

    if isinstance(tree, Not):
        marked, inner, same = _marked(tree.inner, target, schema, values, validate, keys)
        marked, inner = anywhere(marked, inner, same)
        return marked, ~inner, True
    marked, left, left_same = _marked(tree.left, target, schema, values, validate, keys)
    marked, right, right_same = _marked(tree.right, marked, schema, values, validate, keys)
    if isinstance(tree, Both):
        return marked, left & right, left_same and right_same
    marked, left = anywhere(marked, left, left_same)
    marked, right = anywhere(marked, right, right_same)
    return marked, left | right, True


def uncovered(target: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Key tuples of the target at which the other has no value."""
    return expand(target.select(*keys).distinct(), other.select(*keys).distinct(), keys, "left_anti")
