"""for_each over a store: load, expand variants, skip what is fresh, call, save with lineage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constant import plain_value
from ..functions import jsonmaps
from ..functions.hashing import function_hash
from ..functions.keys import norm_key_value
from ..operators import combos as combo_tables
from ..operators import filters
from ..sources.paths import PathTemplate
from ..sources.store import Store, checkpointed, now
from . import foreach
from .lineage import LineageFunction, outdated


class Variable:
    """A stored variable by name: an input, an output, or a side of a filter."""

    __hash__ = object.__hash__

    def __init__(self, name: str, column: str | None = None, columns: tuple[str, ...] = ()):
        self.name, self.column, self.columns = name, column, columns

    def __getitem__(self, columns) -> Variable:
        listed = (columns,) if isinstance(columns, str) else tuple(columns)
        return Variable(self.name, listed[0] if len(listed) == 1 else None, listed)

    def isin(self, values) -> filters.Compare:
        return filters.Compare(self.name, self.column or "value", "in", tuple(values))


for _op, _method in {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}.items():
    setattr(Variable, f"__{_method}__", lambda self, value, op=_op: filters.Compare(self.name, self.column or "value", op, value))

TRACKING = ("record_id", "timestamp", "version_keys", "branch_params", "recipe")
#: Version keys that say how an output was made.
CONFIGURATION = ("__fn", "__fn_hash", "__inputs", "__constants", "__where", "__distribute", "__as_table")


@dataclass
class Plan:
    """What a run is about: its inputs, the combinations with the record ids they use, and its version keys."""

    names: list[str]
    rids: list[str]
    params: list[str]
    tables: dict[str, object]
    constants: dict[str, object]
    texts: dict[str, str]
    extra: dict[str, str]
    combos: DataFrame
    sets: list[DataFrame]


def for_each(
    store: Store,
    fn: Callable,
    inputs: dict[str, object],
    outputs: list[str],
    keys: list[str] | dict[str, list],
    schema: str | None = None,
    where: filters.Filter | foreach.EachOf | None = None,
    skip_computed: bool = False,
    save: bool = True,
    run: str | None = None,
    **options,
) -> DataFrame:
    """Call fn at every combination of `keys` and save what it returns.

    keys: names, or names with the values to take; an empty list of values means all. Iterating
    over fewer keys than an input has gives fn all its lower rows, in order. Otherwise every
    latest variant of every input is called on its own. skip_computed: leave out combinations
    all of whose outputs were made by the same function from the same records (also those of
    fixed, merged and lower inputs), constants, filter and options. Outputs carry the function,
    its hash, the inputs' record ids and the constants as version keys, the constants of the
    whole way as branch parameters, and lineage rows. A lineage function that generates files
    gets the keys as arguments too; only a record and its lineage are kept of it. run: a stamp;
    the combinations of a function's newest run are those expected of it.
    """
    run = run or now()
    axes = foreach._variants(inputs, where)
    if len(axes) > 1:
        found = [for_each(store, fn, i, outputs, keys, schema, w, skip_computed, save, run, **options).withColumns({n: F.lit(v) for n, v in labels.items()}) for labels, i, w in axes]
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out
    _, inputs, where = axes[0]
    lineage_fn = fn if isinstance(fn, LineageFunction) else None
    if lineage_fn and len(outputs) > 1 and not lineage_fn.unpack:
        raise ValueError("several outputs need a lineage function with unpack=True")
    plan = _plan(store, fn, inputs, keys, where, options)
    names, rids, params = plan.names, plan.rids, plan.params
    if options.get("dry_run"):
        return foreach.for_each(fn, plan.tables | plan.constants, [*names, *rids, *params], plan.combos, schema, dataset=store.schema.keys, **options)
    every = combo_tables.missing(plan.combos, _made(store, outputs, plan), [*names, *rids]) if skip_computed else plan.combos
    every = checkpointed(every)
    function, generates = (lineage_fn.function if lineage_fn else fn), bool(lineage_fn and lineage_fn.generates_file)
    if generates:
        function, schema, options = _effect(lineage_fn.function), "value string", options | {"keys_as_arguments": True}
    called = foreach.for_each(function, plan.tables | plan.constants, [*names, *rids, *params], every, schema, dataset=store.schema.keys, order=["row_pos"], **options)
    if not save:
        return called.drop(*params)
    called = checkpointed(called)
    data = [c for c in called.columns if c not in (*names, *rids, *params, "error")]
    texts = [jsonmaps.json_value(json.loads(t)) for t in plan.texts.values()]
    own = F.map_from_arrays(F.array(*[F.lit(f"{fn.__name__}.{n}") for n in plan.texts]), F.array(*map(F.lit, texts))) if plan.texts else None
    branch = None
    for p in params:
        one = jsonmaps.typed(F.col(p))
        branch = one if branch is None else jsonmaps.merged(branch, one)
    branch = own if branch is None else branch if own is None else jsonmaps.merged(branch, own)
    branch = None if branch is None else jsonmaps.json_object(branch)
    level = [c for c in (*names, *([options["distribute"]] if options.get("distribute") else []))]
    rows = called.where("error IS NULL").drop("error") if "error" in called.columns else called
    used = F.to_json(F.array(*[F.struct(F.lit(r[6:]).alias("name"), F.col(r).alias("record_id")) for r in rids])) if rids else F.lit("[]")
    fn_hash, constants = plan.extra["__fn_hash"], plan.extra["__constants"]
    lineage_hash = F.sha2(F.concat_ws("|", F.lit(fn_hash), used, F.lit(constants)), 256)
    for number, (output, columns) in enumerate(zip(outputs, [data] if len(outputs) == 1 else [[c] for c in data])):
        columns = [c for c in columns if c not in level]
        kept = rows.select(*level, *rids, *params, *columns)
        if len(outputs) > 1 or columns == ["value1"]:
            kept, columns = kept.withColumnRenamed(columns[0], "value"), ["value"]
        extra = plan.extra | ({"__output_num": str(number)} if len(outputs) > 1 else {})
        if generates:
            log = store.save_generated(output, kept.drop(*columns), branch, extra, tuple(params), lineage_hash)
        else:
            log = store.save_table(output, kept, columns, branch, extra=extra, hidden=tuple(params), lineage=lineage_hash)
        store._add_lineage(
            log.select(
                F.col("record_id").alias("output_record_id"), "lineage_hash", F.lit(output).alias("variable_name"),
                F.lit(fn.__name__).alias("function_name"), F.lit(fn_hash).alias("function_hash"), used.alias("inputs"), F.lit(constants).alias("constants"), "timestamp",
            )
        )
    for members in plan.sets:
        store._append("record_sets", combo_tables.missing(members, store.table("record_sets"), ["set_id", "record_id"]))
    store._append("expected", plan.combos.select(F.lit(fn.__name__).alias("function_name"), F.to_json(F.struct(*names)).alias("combo"), F.lit(jsonmaps.canonical_json(plan.texts)).alias("branch_params"), F.lit(run).alias("run")))
    return called.drop(*params)


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts within bear the tag; `cancel` from another thread ends them.

    A run that is cancelled has saved nothing: its log rows, the commit, come last.
    """
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End the jobs that bear the tag; the call that waits for them fails."""
    spark.sparkContext.cancelJobsWithTag(tag)


def _effect(function: Callable) -> Callable:
    def call(**arguments):
        function(**arguments)

    return call


def _plan(store: Store, fn: Callable, inputs: dict, keys, where, options: dict) -> Plan:
    names = list(keys)
    inputs = {n: plain_value(v) for n, v in inputs.items()}
    constants = {n: v for n, v in inputs.items() if not _stored(v) and not foreach._is_table(v)}
    tables, params, ids, sets = {}, [], {}, []
    for name, value in inputs.items():
        if name not in constants:
            tables[name], tracked, members = _input(store, name, value, names, where)
            ids |= tracked
            sets += members
            params += [f"__bp_{name}"] if any(f"__bp_{name}" in df.columns for df in tracked.values()) else []
    combos = _combos(store, tables, ids, names, constants)
    for k, values in (keys.items() if isinstance(keys, dict) else ()):
        if len(values):
            combos = combos.join(combo_tables.product(store.spark, {k: list(values)}), k, "left_semi")
    paths = {n for n, v in constants.items() if isinstance(v, PathTemplate)}
    texts = {n: json.dumps(v, default=str) for n, v in constants.items() if n not in paths}
    used = {n: _name(v) for n, v in inputs.items() if n not in texts}
    extra = {"__fn": fn.__name__, "__fn_hash": fn.hash if isinstance(fn, LineageFunction) else function_hash(fn), "__inputs": json.dumps(used, sort_keys=True), "__constants": json.dumps(texts, sort_keys=True)}
    extra |= {"__where": repr(where)} if where is not None else {}
    extra |= {"__distribute": str(options["distribute"])} if options.get("distribute") else {}
    extra |= {"__as_table": json.dumps(options["as_table"] if options["as_table"] is True else sorted(options["as_table"]))} if options.get("as_table") else {}
    return Plan(names, list(ids), params, tables, constants, texts, extra, combos, sets)


def _made(store: Store, outputs: list[str], plan: Plan, without: DataFrame | None = None) -> DataFrame:
    """Combinations, with the record ids used, at which the newest of all outputs were made in this very way; none of them `without`'s nodes."""
    found = None
    for output in outputs:
        made = store.records(output)
        if without is not None:
            made = made.join(without.select(F.col("node").alias("record_id")), "record_id", "left_anti")
        made = made.withColumn("__v", jsonmaps.as_map(F.col("version_keys")))
        for k in CONFIGURATION:
            made = made.where(F.element_at("__v", F.lit(k)).eqNullSafe(F.lit(plan.extra.get(k))))
        own = made.select(*plan.names, *[F.element_at("__v", F.lit(r)).alias(r) for r in plan.rids]).distinct()
        found = own if found is None else combo_tables.existing_null_safe(found, own, [*plan.names, *plan.rids])
    return found


def states(store: Store, fn: Callable, inputs: dict[str, object], outputs: str | list[str], keys: list[str], where: filters.Filter | None = None, **options) -> DataFrame:
    """(keys, record ids used, function, state) of every combination there is or that the function's newest run expected.

    up_to_date: all outputs made by this very function from the newest records of all inputs,
    these constants, filter and options, and none of their ancestors superseded; stale: made
    otherwise; missing: one isn't made. An input that is itself stale makes its outputs stale,
    over 50 steps, but `skip_computed` waits until it is made anew: from the same records the
    function would give the same.
    `state.node_states` sums them up.
    """
    outputs = [outputs] if isinstance(outputs, str) else outputs
    plan = _plan(store, fn, inputs, keys, where, options)
    names, rids, name = plan.names, plan.rids, plan.extra["__fn"]
    edges = store.edges()
    fresh = _made(store, outputs, plan, outdated(edges, store.superseded(edges))).withColumn("__fresh", F.lit(True))
    any_ = None
    for output in outputs:
        version = F.element_at(jsonmaps.as_map(F.col("version_keys")), F.lit("__fn"))
        made = store.records(output).where(version == name).select(*names).distinct()
        any_ = made if any_ is None else combo_tables.existing_null_safe(any_, made, names)
    any_ = any_.withColumn("__any", F.lit(True))
    expected = store.expected(name).select(F.from_json("combo", ", ".join(f"`{k}` string" for k in names)).alias("c")).select("c.*").distinct()
    here = plan.combos.select(*names, *rids)
    gone = combo_tables.missing(expected, here, names).withColumns({r: F.lit(None).cast("string") for r in rids})
    joined = combo_tables.left_null_safe(here.unionByName(gone), fresh, [*names, *rids])
    joined = combo_tables.left_null_safe(joined, any_, names)
    verdict = F.when(F.col("__fresh"), "up_to_date").when(F.col("__any"), "stale").otherwise("missing")
    return joined.select(*names, *rids, F.lit(name).alias("function_name"), verdict.alias("state"))


def _stored(value) -> bool:
    if isinstance(value, Variable):
        return True
    if isinstance(value, (foreach.Fixed, foreach.ColumnSelection)):
        return _stored(value.table)
    return isinstance(value, foreach.Merge) and any(map(_stored, value.parts))


def _name(value) -> str:
    """An input in words: what is read, pinned, merged and selected."""
    if isinstance(value, Variable):
        return value.name + (f"[{', '.join(value.columns)}]" if value.columns else "")
    if isinstance(value, foreach.Fixed):
        return f"Fixed({_name(value.table)}, {', '.join(f'{k}={v}' for k, v in value.keys)})"
    if isinstance(value, foreach.ColumnSelection):
        return f"{_name(value.table)}[{', '.join(value.columns)}]"
    if isinstance(value, foreach.Merge):
        return f"Merge({', '.join(map(_name, value.parts))}; {value.how})"
    return f"PathTemplate({value.template!r}, {value.root!r})" if isinstance(value, PathTemplate) else "table"


def _scan(store: Store, variable: Variable, where) -> tuple[DataFrame, list[str]]:
    rows = store.scan(variable.name, where)
    level = store.level(store.records(variable.name))
    data = [c for c in rows.columns if c not in (*store.schema.keys, *TRACKING, "row_pos")]
    return rows.select(*level, "record_id", "branch_params", "row_pos", *(variable.columns or data)), level


def record_digest(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(keys, name): the record id at each combination of keys, or one digest of the ids if there are several,
    whatever their order; and the ids of each digest: (set_id, record_id)."""
    each = rows.select(*keys, "record_id").distinct()
    number = F.conv(F.substring(F.sha2("record_id", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    found = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("record_id").alias("__one"), F.sum(number).alias("__sum"))
    several = F.concat(F.lit("set:"), F.substring(F.sha2(F.concat_ws("|", F.col("__n").cast("string"), F.col("__sum").cast("string")), 256), 1, 16))
    ids = found.select(*keys, F.when(F.col("__n") == 1, F.col("__one")).when(F.col("__n") > 1, several).alias(name))
    sets = ids.where(F.col(name).startswith("set:"))
    members = (each.join(sets, keys) if keys else each.crossJoin(sets)).select(F.col(name).alias("set_id"), "record_id").distinct()
    return ids, members


def _input(store: Store, name: str, value, keys: list[str], where) -> tuple[object, dict[str, DataFrame], list[DataFrame]]:
    """(table for the call, {id column: the record ids by keys}, members of digests).

    Where every variant is called on its own, the ids come with the branch parameters.
    """
    ids, sets = {}, []

    def track(column: str, rows: DataFrame, level: list[str]) -> None:
        ids[column], members = record_digest(rows, [k for k in keys if k in level], column)
        sets.append(members)

    def plain(part, column: str):
        """The part's rows without tracking columns; its ids by the keys that it still has are noted."""
        pinned = {}
        if isinstance(part, foreach.Fixed):
            pinned, part = dict(part.keys), part.table
        columns = ()
        if isinstance(part, foreach.ColumnSelection) and _stored(part.table):
            columns, part = part.columns, part.table
        if not isinstance(part, Variable):
            return foreach.Fixed(part, **pinned) if pinned else part
        rows, level = _scan(store, part, where)
        for k, v in pinned.items():
            rows = rows.where(F.col(f"`{k}`") == norm_key_value(v))
        level = [k for k in level if k not in pinned]
        track(column, rows, level)
        rows = rows.drop("record_id", "branch_params", *pinned)
        return rows.select(*level, "row_pos", *columns) if columns else rows

    if isinstance(value, Variable):
        rows, level = _scan(store, value, where)
        if set(level) <= set(keys):
            table = rows.withColumnRenamed("record_id", f"__rid_{name}").withColumnRenamed("branch_params", f"__bp_{name}")
            ids[f"__rid_{name}"] = table.select(*level, f"__rid_{name}", f"__bp_{name}").distinct()
            return foreach.ColumnSelection(table, f"__rid_{name}", f"__bp_{name}", "row_pos", *value.columns) if value.columns else table, ids, sets
        track(f"__rid_{name}", rows, level)
        rows = rows.drop("record_id", "branch_params")
        return foreach.ColumnSelection(rows, *[k for k in level if k not in keys], "row_pos", *value.columns) if value.columns else rows, ids, sets
    if isinstance(value, (foreach.Fixed, foreach.ColumnSelection)) and _stored(value):
        return plain(value, f"__rid_{name}"), ids, sets
    if isinstance(value, foreach.Merge):
        parts = [plain(p, f"__rid_{name}_{i}") for i, p in enumerate(value.parts)]
        if value.how == "position":
            return foreach.Merge(*parts, order=["row_pos"], place="row_pos"), ids, sets
        return foreach.Merge(*[p.drop("row_pos") if isinstance(p, DataFrame) else p for p in parts], how=value.how), ids, sets
    return value, ids, sets


def _combos(store: Store, tables: dict, ids: dict[str, DataFrame], keys: list[str], constants: dict) -> DataFrame:
    """Combinations at which every stored input has a record, times the inputs' variants."""
    out = None
    for df in sorted(ids.values(), key=lambda df: -len(set(df.columns) & set(keys))):
        shared = [] if out is None else [k for k in keys if k in out.columns and k in df.columns]
        out = df if out is None else out.join(df, shared) if shared else out.crossJoin(df)  # combinations are the product, as asked for
    if lost := [k for k in keys if out is None or k not in out.columns]:
        levels = [df for df in (foreach._plain(t, keys) for t in tables.values()) if set(lost) <= set(df.columns)]
        levels += [v.discover(store.spark) for v in constants.values() if isinstance(v, PathTemplate) and set(lost) <= set(v.fields)]
        if not levels:
            raise ValueError(f"no input has the keys {lost}")
        shared = [] if out is None else [k for k in keys if k in out.columns and k in levels[0].columns]
        more = levels[0].select(*dict.fromkeys([*shared, *lost])).distinct()
        out = more if out is None else out.join(more, shared) if shared else out.crossJoin(more)
    return out
