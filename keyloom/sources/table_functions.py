"""Python functions as table functions in SQL: FROM name(TABLE(t) PARTITION BY k ORDER BY o).

A function of a combination's rows (a table in, a table out) is registered by the name that
SQL uses. Its output has the keys that SQL partitions by and the columns that it declares;
which these are is found when the query is analysed, from the table given.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def register(spark: SparkSession, name: str, function: Callable[..., pd.DataFrame], schema: str | Callable[[T.StructType], T.StructType], keys: list[str]) -> None:
    """Make `function(rows, **arguments)` a table function of this session.

    rows: the rows of one partition as a table, in the order that SQL gives, with all columns
    of the input. Named arguments in SQL besides the table are passed on; they must be
    constants. keys: columns of the input that come first in the output; partition by them.
    schema: the columns that the function returns, as DDL or as a function of the input's
    type. What the function raises fails the query. Rows of a partition are held in one task,
    as the function needs them; use `operators.mergeable` where it doesn't.
    """
    fixed = T.StructType.fromDDL(schema) if isinstance(schema, str) else None

    class Called:
        @staticmethod
        def analyze(rows: AnalyzeArgument, **arguments: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} needs a table: {name}(TABLE(...) PARTITION BY ...)")
            if lost := [k for k in keys if k not in rows.dataType.names]:
                raise ValueError(f"{name} needs the columns {lost}")
            if bad := [n for n, a in arguments.items() if a.isTable or not a.isConstantExpression]:
                raise ValueError(f"{name} takes constants for {bad}")
            made = fixed if fixed is not None else schema(rows.dataType)
            return AnalyzeResult(T.StructType([*[rows.dataType[k] for k in keys], *made.fields]))

        def __init__(self):
            self.rows, self.arguments = [], {}

        def eval(self, rows, **arguments):
            self.rows.append(rows.asDict())
            self.arguments = arguments

        def terminate(self):
            if self.rows:
                table = pd.DataFrame(self.rows)
                at = tuple(self.rows[0][k] for k in keys)
                out = function(table, **self.arguments)
                for row in out.itertuples(index=False, name=None):
                    yield (*at, *[v.item() if hasattr(v, "item") else v for v in row])

    spark.udtf.register(name, udtf(Called))
