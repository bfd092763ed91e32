"""Aggregates of the user's own that combine before the shuffle.

A function of a whole group needs all its rows in one task. An aggregate that is given as
start, update, merge and finish doesn't: every task folds its rows into one state a key, and
only states are shuffled. They are merged in rounds of a bounded number each, so that a
combination that holds most rows costs no task more than another does.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: States merged by one call at most, and states that a task holds before it hands them on.
FAN, HELD = 64, 10_000


class Mergeable:
    """An aggregate; override all four. States are any values that pickle and stay small.

    merge must not care for order, nor for how rows are split into updates.
    """

    def start(self):
        raise NotImplementedError

    def update(self, state, rows: pd.DataFrame):
        """The state after some rows of one key, without the key columns."""
        raise NotImplementedError

    def merge(self, one, other):
        raise NotImplementedError

    def finish(self, state) -> object:
        """The result: a value, a tuple of the result's columns, or None for nulls."""
        raise NotImplementedError


def aggregate(df: DataFrame, keys: list[str], function: Mergeable, schema: str | T.StructType, fan: int = FAN, held: int = HELD) -> DataFrame:
    """(keys, the columns of `schema`): the aggregate of each combination of keys; null keys are a combination too.

    Without keys there is one row, of start's state for an empty table. An empty table with
    keys gives an empty one. Repeated rows count as often as they come.
    """
    made = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = [f"k{i}" for i in range(len(keys))]
    kinds = [T.StructField(n, df.schema[k].dataType) for n, k in zip(names, keys)]
    part_type = T.StructType([*kinds, T.StructField("state", T.BinaryType()), T.StructField("part", T.LongType())])
    arrow = to_arrow_schema(part_type)
    data = [c for c in df.columns if c not in keys]
    source = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], *[F.col(f"`{c}`") for c in data])

    def out(states: dict, part: int) -> pa.RecordBatch:
        columns = [[k[i] for k in states] for i in range(len(names))]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(map(pickle.dumps, states.values()), pa.binary()), pa.array([part] * len(states), pa.int64())], schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, part = {}, TaskContext.get().partitionId()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes, seen = [], {}
            for key in zip(*[batch.column(i).to_pylist() for i in range(len(names))]) if names else ((),) * batch.num_rows:
                codes.append(seen.setdefault(key, len(seen)))
            rows = table.select(list(range(len(names), table.num_columns))).to_pandas(use_threads=False)
            rows.columns = data
            for key, own in zip(seen, (g for _, g in rows.groupby(pd.Series(codes, rows.index, dtype="int64"), sort=True))):
                states[key] = function.update(states[key] if key in states else function.start(), own)
            if len(states) > held:
                yield out(states, part)
                states = {}
        if states:
            yield out(states, part)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        state = None
        for n, packed in enumerate(table.column("state").to_pylist()):
            own = pickle.loads(packed)
            state = function.merge(state, own) if n else own
        at = {n: v.as_py() for n, v in zip([*names, "part"], key)}
        return pa.Table.from_pylist([at | {"state": pickle.dumps(state)}], schema=arrow)

    states = source.mapInArrow(fold, part_type)
    # a key has at most a state of each task, and one more each time that a task hands its states on
    rounds = max(1, math.ceil(math.log(max(2, df.rdd.getNumPartitions()), fan)))
    for left in reversed(range(rounds)):
        group = F.floor(F.col("part") / F.lit(fan)).cast("long") if left else F.lit(0).cast("long")
        states = states.withColumn("part", group).groupBy(*names, "part").applyInArrow(merged, part_type)
    results = to_arrow_schema(made)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for packed in batch.column(len(names)).to_pylist():
                value = function.finish(pickle.loads(packed))
                rows.append(dict(zip(results.names, value if isinstance(value, tuple) else (value,))) if value is not None else {})
            found = pa.Table.from_pylist(rows, schema=results)
            columns = [*batch.columns[: len(names)], *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in found.columns]]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    last = T.StructType([*[T.StructField(k, f.dataType) for k, f in zip(keys, kinds)], *made.fields])
    wanted = to_arrow_schema(last)
    done = states.mapInArrow(finished, last)
    if not keys:  # as SQL: one row, whatever there is
        empty = function.finish(function.start())
        row = tuple(empty) if isinstance(empty, tuple) else (empty,) if empty is not None else (None,) * len(made.fields)
        none = df.sparkSession.createDataFrame([row], made)
        counted = done.withColumn("__some", F.lit(1)).unionByName(none.withColumn("__some", F.lit(0)))
        done = counted.orderBy(F.col("__some").desc()).limit(1).drop("__some")
    return done
