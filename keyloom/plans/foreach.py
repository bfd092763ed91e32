"""Call a function for every combination of keys.

Inputs are tables with key columns, or without any (constants to all combinations), path
templates, or plain values. Combinations come from the first table input, or are given. The
rows of all keyed inputs are tagged and brought together by combination in one shuffle; each
group is split again by tag, so that the function gets one table of each input, in order. A
table without keys is read once and broadcast if its checked size allows, else it goes along
with the rows. With `native`, aggregates as column expressions replace the function and
nothing leaves the JVM.

An input whose rows of one combination may be more than a worker holds can be streamed: Spark
sorts it, on disk where it must, and the function gets an iterator of tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, groupby, product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..constant import plain_value
from ..functions.keys import norm_key_value
from ..operators.filters import Filter, table_condition
from ..operators.mergeable import Mergeable, aggregate
from ..operators.tables import merge_positional, merge_shared
from ..sources.paths import PathTemplate

#: Bytes, as JSON, up to which a table without keys is broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows of an input by which the types of an output are learnt where no schema is given.
TRIAL_ROWS = 10_000


@dataclass(frozen=True)
class Fixed:
    """An input pinned at some keys whatever the combination."""

    table: object
    keys: tuple

    def __init__(self, table, **keys):
        if isinstance(table, Merge):
            raise TypeError("Fixed can't hold a Merge; merge fixed inputs instead")
        object.__setattr__(self, "table", table)
        object.__setattr__(self, "keys", tuple(keys.items()))


@dataclass(frozen=True)
class Merge:
    """Inputs side by side: by row position, or by shared columns with how='join'."""

    parts: tuple
    order: tuple
    how: str
    place: str | None

    def __init__(self, *parts, order: list[str] | None = None, how: str = "position", place: str | None = None):
        if any(isinstance(p, Merge) for p in parts):
            raise TypeError("a Merge can't hold a Merge")
        if len(parts) < 2:
            raise ValueError("a Merge needs two parts at least")
        object.__setattr__(self, "parts", parts)
        object.__setattr__(self, "order", tuple(order or ()))
        object.__setattr__(self, "how", how)
        object.__setattr__(self, "place", place)  # a column for the rows' places, from 1


@dataclass(frozen=True)
class ColumnSelection:
    """Some columns of an input; a single one is passed as an array."""

    table: object
    columns: tuple

    def __init__(self, table, *columns: str):
        object.__setattr__(self, "table", table)
        object.__setattr__(self, "columns", columns)


@dataclass(frozen=True)
class ColName:
    """Stands for the name of an input's only data column."""

    table: object


class EachOf:
    """Alternatives for an input, a constant or the filter: every one is run."""

    def __init__(self, *options):
        if not options:
            raise ValueError("EachOf needs an option")
        self.options = options


def _plain(table, keys: list[str]) -> DataFrame:
    """The table of an input, without wrappers."""
    if isinstance(table, DataFrame):
        return table
    if isinstance(table, Fixed):
        df = _plain(table.table, keys)
        for k, v in table.keys:
            df = df.where(F.col(k).cast("string") == norm_key_value(v))
        return df.drop(*dict(table.keys))
    if isinstance(table, ColumnSelection):
        df = _plain(table.table, keys)
        if lost := [c for c in table.columns if c not in df.columns]:
            raise KeyError(f"no column {lost} in an input")
        return df.select(*[c for c in df.columns if c in keys], *table.columns)
    if isinstance(table, Merge):
        parts = [_plain(p, keys) for p in table.parts]
        if table.how == "join":
            return merge_shared(parts)
        by = [k for k in keys if all(k in p.columns for p in parts)]
        order = [[c for c in (*table.order, *keys) if c in p.columns and c not in by] or [c for c in p.columns if c not in by] for p in parts]
        return merge_positional([p.drop(*[k for k in keys if k in p.columns and k not in by]) for p in parts], by, order, table.place)
    raise TypeError(f"not a table: {table!r}")


def _is_table(value) -> bool:
    return isinstance(value, (DataFrame, Fixed, Merge, ColumnSelection))


def data_value(rows: pd.DataFrame, keys: list[str], as_table: bool, selected: bool):
    """What the function gets of a combination's rows: one value, a column, or a table."""
    if as_table:
        return rows
    data = rows.drop(columns=[k for k in keys if k in rows.columns])
    if selected and data.shape[1] == 1:
        return data.iloc[:, 0].to_numpy()
    if data.shape == (1, 1):
        return data.iloc[0, 0]
    if data.shape[1] == 1:
        return data.to_numpy()
    return data


def _variants(inputs: dict, where) -> list[tuple[dict, dict, object]]:
    """(labels, inputs, where) for each choice among the EachOf."""
    axes = [(n, v.options) for n, v in inputs.items() if isinstance(v, EachOf)]
    filters = where.options if isinstance(where, EachOf) else (where,)
    out = []
    for choice in product(*[range(len(o)) for _, o in axes], range(len(filters))):
        picked = {n: o[i] for (n, o), i in zip(axes, choice)}
        labels = {n: str(i if _is_table(picked[n]) else picked[n]) for (n, _), i in zip(axes, choice)}
        if len(filters) > 1:
            labels["where"] = str(choice[-1])
        out.append((labels, inputs | picked, filters[choice[-1]]))
    return out


def for_each(
    fn: Callable | Mergeable | dict[str, Column],
    inputs: dict[str, object],
    keys: list[str],
    combos: DataFrame | None = None,
    schema: str | T.StructType | None = None,
    where: Filter | EachOf | None = None,
    as_table: bool | list[str] = False,
    distribute: str | None = None,
    output_names: list[str] | None = None,
    errors: str = "skip",
    dry_run: bool = False,
    dataset: Iterable[str] = (),
    order: Iterable[str] = (),
    keys_as_arguments: bool = False,
    observation: Observation | None = None,
    progress: Accumulator | None = None,
    streamed: str | None = None,
) -> DataFrame | None:
    """One row, or the rows of a returned table, for every combination of `keys`.

    fn takes the inputs by name; or a dict of aggregates over the only table input, or a
    Mergeable over it, whose states combine before the shuffle. schema:
    the types of what it returns, without keys; by default found by calling it on one
    combination. A tuple is several columns, named by output_names. distribute: the key that
    numbers, from 1, the elements or rows that the output is split into. errors: 'skip' the
    combinations at which fn raises, keep their message in a column `error` with 'column', or
    'raise'. EachOf inputs give a column with the option's label. A combination that a keyed
    input lacks is dropped. dataset: all key names; those not iterated over are no data either,
    so that fn gets all lower rows of a combination. order: columns that put a combination's
    rows in order, after the lower keys; fn doesn't get them. A path template is an input by
    its path at the combination. keys_as_arguments: fn gets the keys too, by name.
    observation: gets `rows` and `failed` when the plan runs. progress: counts combinations as
    they are done; those of a task that is run again count again. Running calls are cancelled
    by job tags, see `run.tagged`. streamed: the table input that fn gets as an iterator of
    tables (of arrays, if it is one selected column), none empty, in the same order, so that
    memory is bounded whatever a combination's rows; fn needn't read it to the end.
    """
    variants = _variants(inputs, where)
    if len(variants) > 1:
        parts = []
        for labels, picked, condition in variants:
            df = for_each(fn, picked, keys, combos, schema, condition, as_table, distribute, output_names, errors, dry_run, dataset, order, keys_as_arguments, progress=progress, streamed=streamed)
            parts.append(None if df is None else df.withColumns({n: F.lit(v) for n, v in labels.items()}))
        return None if dry_run else reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    _, inputs, where = variants[0]
    every = list(dict.fromkeys([*keys, *dataset]))
    found = {n: _plain(v, every) for n, v in inputs.items() if _is_table(v)}
    if where is not None:
        columns = lambda t: [c.column for c in _leaves(t) if hasattr(c, "column")]
        found = {n: df.where(table_condition(where)) if set(columns(where)) <= set(df.columns) else df for n, df in found.items()}
    constants = {n: plain_value(v) for n, v in inputs.items() if not _is_table(v)}
    for n, v in constants.items():
        if isinstance(v, ColName):
            names = [c for c in _plain(v.table, every).columns if c not in every]
            if len(names) != 1:
                raise ValueError(f"ColName needs one data column, not {names}")
            constants[n] = names[0]
    if streamed is not None and (streamed not in found or isinstance(fn, (Mergeable, dict))):
        raise ValueError(f"{streamed!r} can't be streamed: it must be a table input of a function")
    given = combos is not None
    if combos is None:
        keyed = [df for df in found.values() if set(keys) <= set(df.columns)]
        if not keyed:
            raise ValueError(f"no input has all keys {keys}; give combos")
        combos = keyed[0].select(*keys).distinct()
    if dry_run:
        combos.orderBy(*keys).show(20, truncate=False)
        return None
    if isinstance(fn, Mergeable):
        (df,) = found.values()
        return aggregate(df.join(combos.select(*keys).distinct(), keys, "left_semi") if given else df, keys, fn, schema)
    if isinstance(fn, dict):
        (df,) = found.values()
        return df.join(combos, keys, "left_semi").groupBy(*keys).agg(*[c.alias(n) for n, c in fn.items()])
    tabled = set(found) if as_table is True else set(as_table or ())
    selected = {n for n, v in inputs.items() if isinstance(v, ColumnSelection)}
    call = _Call(fn, constants, keys, every, tabled, selected, output_names, distribute, errors, tuple(order), keys_as_arguments, progress, streamed)
    combos = combos.select(*keys).distinct()
    kinds = {f.name: f for f in combos.schema.fields}
    if schema is None:
        first = combos.limit(1)
        at = first.toPandas()
        tables = {n: _joined(first, df, keys).select(*df.columns).limit(TRIAL_ROWS).toPandas() for n, df in found.items()}  # some rows of one combination
        if at.empty or any(t.empty for n, t in tables.items() if set(keys) & set(found[n].columns)):
            raise ValueError("no combination to learn the output's types from; give a schema")
        if streamed is not None:
            tables[streamed] = iter([call.chunk(streamed, call.sorted(tables[streamed]))])
        got = call.called(at.iloc[0].to_dict(), tables, trial=True).drop(columns=keys, errors="ignore")
        made = combos.sparkSession.createDataFrame(got.drop(columns=[c for c in ("error",) if c in got])).schema
    else:
        made = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    fields = [kinds[k] for k in keys] + ([T.StructField(distribute, T.LongType())] if distribute else [])
    fields += [f for f in made.fields if f.name != distribute]
    if errors == "column":
        fields.append(T.StructField("error", T.StringType()))
    out = _grouped(found, combos, keys, call, T.StructType(fields))
    if observation is not None:
        failed = F.count(F.col("error")) if errors == "column" else F.lit(0).cast("long")
        out = out.observe(observation, F.count(F.lit(1)).alias("rows"), F.max(failed).alias("failed") if errors != "column" else failed.alias("failed"))
    return out


def _joined(combos: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each combination, by the keys that df has."""
    own = [k for k in keys if k in df.columns]
    return combos.join(df, own) if own else combos.crossJoin(df)


def _small(df: DataFrame) -> bool:
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def _grouped(found: dict[str, DataFrame], combos: DataFrame, keys: list[str], call: _Call, result: T.StructType) -> DataFrame:
    """One call a combination. Groups are spread over all shuffle partitions, whatever their bytes: the function's time is what counts."""
    spark = combos.sparkSession
    free = {n: df for n, df in found.items() if not set(keys) & set(df.columns) and _small(df)}
    shared = spark.sparkContext.broadcast({n: df.toPandas() for n, df in free.items()}) if free else None  # at most BROADCAST_BYTES each
    keyed = {n: df for n, df in found.items() if n not in free}
    keyed = dict(sorted(keyed.items(), key=lambda item: item[0] == call.streamed))  # the streamed one is the last
    rows, columns, places = None, {}, []
    for i, (name, df) in enumerate(keyed.items()):
        data = {c: f"__{i}_{c}" for c in df.columns if c not in keys}
        columns[name] = data
        own = _joined(combos, df.withColumnsRenamed(data), keys).select(*keys, *data.values(), F.lit(i).alias("__tag"))
        if name == call.streamed:
            own, places = _placed(own, keys, [data[c] for c in call.lower(df.columns)], [data[c] for c in call.order if c in data])
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    if rows is None:
        rows = combos.withColumn("__tag", F.lit(-1))
    names, arrow, alone = {n: df.columns for n, df in found.items()}, to_arrow_schema(result), list(free)

    def framed(name: str, table: pa.Table) -> pd.DataFrame:
        frame = table.select([columns[name].get(c, c) for c in names[name]]).to_pandas(use_threads=False)
        frame.columns = names[name]
        return frame

    def called(at: dict, tables: dict) -> pa.Table:
        for name in alone:
            tables[name] = shared.value[name].copy() if name != call.streamed else iter([call.chunk(name, call.sorted(shared.value[name].copy()))])
        out = call.called(at, tables)
        made = []
        for field in arrow:
            if field.name in at:
                made.append(pa.array([at[field.name]] * len(out), field.type))
            elif field.name in out:
                made.append(pa.Array.from_pandas(out[field.name], type=field.type))
            else:
                made.append(pa.nulls(len(out), field.type))
        return pa.Table.from_arrays(made, schema=arrow)

    def group(key: tuple, table: pa.Table) -> pa.Table:
        tables = {}
        for i, name in enumerate(columns):
            own = table.filter(pc.equal(table["__tag"], i)) if len(columns) > 1 else table
            if not own.num_rows:
                return arrow.empty_table()
            tables[name] = framed(name, own)
        return called({k: v.as_py() for k, v in zip(keys, key)}, tables)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in groupby(_runs(batches, keys), lambda run: run[0]):
            tables, last = {}, []
            for _, i, piece in pieces:
                if i == len(columns) - 1:
                    last = [piece]
                    break
                tables.setdefault(list(columns)[i], []).append(piece)
            if last and len(tables) == len(columns) - 1:  # else the combination lacks an input
                at = {k: last[0][k][0].as_py() for k in keys}
                tables = {name: framed(name, pa.concat_tables(parts)) for name, parts in tables.items()}
                rest = chain(last, (piece for _, _, piece in pieces))
                tables[call.streamed] = (call.chunk(call.streamed, framed(call.streamed, piece)) for piece in rest)
                yield from called(at, tables).to_batches()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = rows.repartition(parts, *keys)
    if call.streamed in columns:
        return together.sortWithinPartitions(*keys, "__tag", *[F.col(p).asc_nulls_last() for p in places]).drop(*places).mapInArrow(stream, result)
    return together.groupBy(*keys).applyInArrow(group, result)


def _placed(rows: DataFrame, keys: list[str], lower: list[str], order: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns by which Spark sorts a combination's rows as `_Call.sorted` does: texts as numbers where all of the combination are."""
    if not order:
        return rows, []
    texts, out = [c for c in lower if dict(rows.dtypes)[c] == "string"], []
    decimal = lambda c: F.when(F.trim(c).rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"), F.trim(c))
    all_numbers = lambda c: F.min(decimal(F.col(c)).isNotNull()).alias(f"__all{c}")
    if texts:
        own = {k: f"__key_{k}" for k in keys}
        numbers = rows.groupBy(*keys).agg(*map(all_numbers, texts)).withColumnsRenamed(own)
        rows = rows.join(numbers, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()]), "left").drop(*own.values())
    for c in lower:
        if c not in texts:
            rows = rows.withColumn(f"__place{c}", F.col(c))
            out.append(f"__place{c}")
            continue
        number = F.when(F.col(f"__all{c}"), decimal(F.col(c)))
        # whole numbers of more digits than a double's by all of theirs
        rows = rows.withColumns({f"__number{c}": number.cast("double"), f"__whole{c}": number.try_cast("decimal(38,0)"), f"__text{c}": F.when(~F.col(f"__all{c}"), F.coalesce(c, F.lit("None")))}).drop(f"__all{c}")
        out += [f"__number{c}", f"__whole{c}", f"__text{c}"]
    rows = rows.withColumns({f"__place{c}": F.col(c) for c in order})
    return rows, [*out, *[f"__place{c}" for c in order]]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[int, int, pa.Table]]:
    """(number of the combination, tag, rows) of rows that are sorted by both, no more of them at once than a batch has."""
    number, before = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table, changed = pa.Table.from_batches([batch]), np.zeros(batch.num_rows, bool)
        for k in keys:
            code = pc.fill_null(pc.dictionary_encode(batch[k]).indices, -1).to_numpy(zero_copy_only=False)
            changed[1:] |= code[1:] != code[:-1]
        ends = [[batch[k][i].as_py() for k in keys] for i in (0, batch.num_rows - 1)]
        changed[0] = before is not None and not all(a == b or a != a and b != b for a, b in zip(before, ends[0]))
        before = ends[1]
        numbers, tags = number + np.cumsum(changed), batch["__tag"].to_numpy()
        number = int(numbers[-1])
        new = np.flatnonzero(np.concatenate(([True], (numbers[1:] != numbers[:-1]) | (tags[1:] != tags[:-1]), [True])))
        for a, b in zip(new[:-1], new[1:]):
            yield int(numbers[a]), int(tags[a]), table.slice(a, b - a)


def _leaves(tree):
    if hasattr(tree, "left"):
        return _leaves(tree.left) + _leaves(tree.right)
    return _leaves(tree.inner) if hasattr(tree, "inner") else [tree]


class _Call:
    def __init__(self, fn, constants, keys, every, tabled, selected, output_names, distribute, errors, order=(), keys_as_arguments=False, progress=None, streamed=None):
        self.fn, self.constants, self.keys, self.every, self.tabled, self.selected = fn, constants, keys, every, tabled, selected
        self.output_names, self.distribute, self.errors, self.order, self.keys_as_arguments = output_names, distribute, errors, order, keys_as_arguments
        self.progress, self.streamed = progress, streamed

    def lower(self, columns: Iterable[str]) -> list[str]:
        return [k for k in self.every if k in columns and k not in self.keys]

    def chunk(self, name: str, rows: pd.DataFrame):
        """What the function gets of some rows of a streamed input."""
        rows = rows.drop(columns=[c for c in self.order if c in rows.columns])
        if name in self.tabled:
            return rows
        data = rows.drop(columns=[k for k in self.every if k in rows.columns])
        return data.iloc[:, 0].to_numpy() if name in self.selected and data.shape[1] == 1 else data

    def sorted(self, table: pd.DataFrame) -> pd.DataFrame:
        """The rows by the lower keys, numbers as numbers, and then by the order columns, which go."""
        by = [c for c in self.order if c in table.columns]
        if not by:
            return table
        lower = self.lower(table.columns)
        ranks = pd.DataFrame({c: table[c] if c in by else _sortable(table[c]) for c in (*lower, *by)})
        return table.iloc[ranks.sort_values([*lower, *by], kind="stable").index if len(ranks) > 1 else slice(None)].drop(columns=by).reset_index(drop=True)

    def called(self, at: dict, tables: dict[str, pd.DataFrame], trial: bool = False) -> pd.DataFrame:
        """The rows of one combination, without its keys."""
        try:
            arguments = {n: v.path(**at) if isinstance(v, PathTemplate) else v for n, v in self.constants.items()}
            for name, table in tables.items():
                arguments[name] = table if name == self.streamed else data_value(self.sorted(table), self.every, name in self.tabled, name in self.selected)
            if self.keys_as_arguments:
                arguments |= {k: v for k, v in at.items() if not k.startswith("__")}
            out = self._shape(self.fn(**arguments))
        except Exception as e:
            if self.errors == "raise" or trial:
                raise
            out = pd.DataFrame([{"error": f"{type(e).__name__}: {e}"}] if self.errors == "column" else [])
        if self.progress is not None and not trial:
            self.progress.add(1)
        return out

    def _shape(self, result) -> pd.DataFrame:
        if self.distribute:
            pieces = _pieces(result)
            out = pd.concat([self._one(p) for p in pieces], ignore_index=True) if pieces else pd.DataFrame()
            out.insert(0, self.distribute, range(1, len(out) + 1))
            return out
        return self._one(result)

    def _one(self, result) -> pd.DataFrame:
        if isinstance(result, pd.DataFrame):
            return result.reset_index(drop=True)
        values = result if isinstance(result, tuple) else (result,)
        names = self.output_names or (["value"] if len(values) == 1 else [f"value{i + 1}" for i in range(len(values))])
        return pd.DataFrame([[v.tolist() if isinstance(v, np.ndarray) else v.item() if isinstance(v, np.generic) else v for v in values]], columns=names)


def _sortable(column: pd.Series) -> pd.Series:
    numbers = pd.to_numeric(column, errors="coerce")
    return numbers if numbers.notna().all() else column.astype(str)


def _pieces(result) -> list:
    """Rows of a table, elements of a list, rows of an array; of several outputs, the positions together."""
    if isinstance(result, tuple):
        return list(zip(*map(_pieces, result)))
    if isinstance(result, pd.DataFrame):
        return [result.iloc[i : i + 1] for i in range(len(result))]
    return list(result)
