"""The store: one Parquet dataset per variable, and append-only logs about its records.

Data is written before the record log, so a log row is the commit: readers start from the
log. Nothing is updated in place; the newest row, by time and record, counts.

Data files are dealt by the first digit of the record id, sorted by it, and have bloom
filters of it. A log row names the batch that holds its data, so that what a failed or a
concurrent save left is never read, and a save looks into the log only.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .. import types
from ..functions import jsonmaps
from ..functions.hashing import DIGITS, canonical_hash, record_id
from ..functions.keys import norm_key_value, norm_keys, typed_key_value
from ..operators import filters
from ..operators.latest import excluded, latest
from ..schema import DatasetSchema


class NotFound(LookupError):
    pass


class AmbiguousVersion(LookupError):
    pass


class AmbiguousParameter(LookupError):
    pass


LOGS = {
    "groups": "group_name string, variable_name string, present boolean, timestamp string",
    "exclusions": "record_id string, excluded boolean, timestamp string",
    "lineage": "output_record_id string, lineage_hash string, variable_name string, function_name string, function_hash string, inputs string, constants string, timestamp string",
    "variables": "variable_name string, schema_level string, schema_version int, description string, dropped boolean, timestamp string, columns string",
    "expected": "function_name string, combo string, branch_params string, run string",
    "record_sets": "set_id string, record_id string",
    "sketches": "variable_name string, column_name string, batch string, n long, least double, most double, distinct_values binary, quantiles binary",
    "drawn": "kind string, id string, content string, present boolean, timestamp string",
}


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):  # all in one process
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="keyloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def variant(version_keys: Column) -> Column:
    """The version keys that make a variant: which records and which text of the function it came from don't."""
    kept = F.map_filter(jsonmaps.typed(version_keys), lambda k, _: ~k.startswith("__rid_") & (k != "__fn_hash"))
    return jsonmaps.json_object(kept)


#: The columns of data files beside the data itself.
PLACE = "record_id string, row_pos int, batch string"
#: Records up to which a read of single values names their ids to the file scan.
NAMED_IDS = 1_000
#: Registers of a distinct-count sketch, as a power of two.
SKETCH_BITS = 12


def shard(rid: Column) -> Column:
    """The folder of a record's data."""
    return F.substring(rid, 1, 1)


def _listed(version: str | list[str]) -> list[str]:
    return [version] if isinstance(version, str) else list(version)


_CURRENT: list[Store] = []


def open_store(spark: SparkSession, root: str, keys: Iterable[str], user: str = "") -> Store:
    """Open a store and make it the current one."""
    _CURRENT[:] = [Store(spark, root, keys, user)]
    return _CURRENT[0]


def current_store() -> Store:
    if not _CURRENT:
        raise LookupError("no store is open; call open_store first")
    return _CURRENT[0]


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")


class Store:
    """Variables addressed by an ordered list of keys, under a folder that Spark can write."""

    def __init__(self, spark: SparkSession, root: str, keys: Iterable[str], user: str = ""):
        self.spark, self.root, self.schema, self.user = spark, root.rstrip("/"), DatasetSchema(keys), user
        self.codecs: dict[str, tuple] = {}
        kept = self._read("schema", "position int, name string")
        names = [r["name"] for r in kept.orderBy("position").collect()]
        if names and tuple(names) != self.schema.keys:
            raise ValueError(f"the store has the keys {names}, not {list(self.schema.keys)}")
        if not names:
            rows = list(enumerate(self.schema.keys))
            self._append("schema", spark.createDataFrame(rows, "position int, name string"))

    # --- files ---

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, name: str, schema: str | T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, df: DataFrame, by: str | None = None, few: bool = False) -> None:
        """few: rows from the driver, which make one file."""
        writer = (df.coalesce(1) if few else df).write.mode("append")
        (writer.partitionBy(by) if by else writer).parquet(self._path(name))

    def log(self) -> DataFrame:
        """Every save: who, what, where, which version. Partitioned by variable."""
        keys = ", ".join(f"`{k}` string" for k in self.schema.keys)
        rest = "record_id string, timestamp string, schema_level string, version_keys string, content_hash string, lineage_hash string, schema_version int, user_id string, branch_params string, recipe string, batch string, variable_name string"
        return self._read("record_log", f"{keys}, {rest}")

    def data(self, name: str) -> DataFrame:
        """All rows ever saved of a variable, with their record ids, places, batches and shards."""
        given: dict[str, str] = {}
        for row in self.table("variables").where((F.col("variable_name") == name) & F.col("columns").isNotNull()).groupBy("columns").agg(F.min("timestamp").alias("t")).orderBy("t", "columns").collect():
            for c in T.StructType.fromJson(json.loads(row["columns"])):
                given.setdefault(c.name, c)
        return self._read(f"data/{name}", T.StructType([*T.StructType.fromDDL(PLACE), *given.values(), T.StructField("shard", T.StringType())]))

    def table(self, name: str) -> DataFrame:
        return self._read(name, LOGS[name])

    # --- saving ---

    def save(self, name: str, value, branch_params: dict | None = None, lineage: dict | None = None, version: int = 1, **metadata) -> str:
        """Save one value at the keys and version keys in `metadata`; returns its record id."""
        return self.save_batch(name, [(value, metadata)], [branch_params or {}], [lineage], version)[0]

    def save_batch(self, name: str, items: list[tuple[object, dict]], branch_params: list[dict] | None = None, lineage: list[dict | None] | None = None, version: int = 1) -> list[str]:
        """Save driver-side values of one shape in one append. For tables of values use `save_table`."""
        ids, logs, rows, columns, provenance = [], [], [], None, []
        stamp = now()
        for i, (value, metadata) in enumerate(items):
            own, rest = self.schema.split(metadata)
            own = {k: norm_key_value(v) for k, v in own.items()}
            codec = self.codecs.get(name)
            cells, columns, recipe = types.encode(codec[0](value) if codec else value)
            recipe |= {"codec": name} if codec else {}
            content = canonical_hash(codec[0](value) if codec else value)
            params = branch_params[i] if branch_params else {}
            rid = record_id(name, version, content, own | rest)
            ids.append(rid)
            rows += [(rid, p, *r) for p, r in enumerate(cells)]
            made = (lineage or [None] * len(items))[i]
            logs.append((*[own.get(k) for k in self.schema.keys], rid, stamp, self.schema.level(own), jsonmaps.canonical_json(rest), content, (made or {}).get("lineage_hash"), version, self.user, jsonmaps.canonical_json(params), json.dumps(recipe), name))
            if made:
                provenance.append((rid, made.get("lineage_hash"), name, made.get("function_name"), made.get("function_hash"), json.dumps(made.get("inputs", [])), json.dumps(made.get("constants", {}), default=str), stamp))
        held = {r["record_id"]: r["batch"] for r in self._batches(name).where(F.col("record_id").isin(ids)).collect()}
        batch, new, seen = uuid.uuid4().hex, [], set(held)
        for row in rows:
            if row[0] not in held and (row[0], row[1]) not in seen:  # equal values at equal keys are one record
                seen.add((row[0], row[1]))
                new.append((row[0], row[1], batch, *row[2:]))
        if new:
            kinds = T.StructType([*T.StructType.fromDDL(PLACE), *columns.fields])
            self._add_data(name, self.spark.createDataFrame(new, kinds), few=True)
        self._register(name, self.schema.level({k for _, m in items for k in m}), version, stamp, columns=columns)
        if provenance:
            self._add_lineage(self.spark.createDataFrame(provenance, LOGS["lineage"]))
        logs = [(*row[:-1], held.get(rid, batch), row[-1]) for rid, row in zip(ids, logs)]
        self._append("record_log", self.spark.createDataFrame(logs, self.log().schema), "variable_name", few=True)
        return ids

    def codec(self, name: str, encode, decode) -> None:
        """How values of a variable become a table, dict or plain value, and back."""
        self.codecs[name] = encode, decode

    def save_many(self, name: str, values: dict[tuple, object], **options) -> list[str]:
        """Save driver-side values by the tuple of their keys, the coarsest first."""
        items = [(v, dict(zip(self.schema.keys, at if isinstance(at, tuple) else (at,)))) for at, v in values.items()]
        return self.save_batch(name, items, **options)

    def save_table(
        self, name: str, df: DataFrame, columns: list[str], branch_params: Column | None = None, version: int = 1, order: list[str] | None = None, extra: dict | None = None,
        hidden: tuple[str, ...] = (), lineage: Column | None = None, sketched: tuple[str, ...] = (),
    ) -> DataFrame:
        """Save every key combination of a table as a record, by column expressions only.

        df: key columns, version-key columns and the data columns named in `columns`. Rows of a
        combination are one record, in the order of `order`. The content hash is a sum over the
        rows' digests with their places, so it combines before the shuffle. extra: version keys
        of all records. hidden: columns that are no version keys but may be named by
        branch_params and lineage, the lineage hash. sketched: data columns of numbers whose
        sketches are kept, see `sketch_summary`. Returns the log rows with the version-key columns.
        """
        keys = [k for k in self.schema.keys if k in df.columns]
        rest = [c for c in df.columns if c not in (*keys, *columns)]
        df = norm_keys(df, keys)
        place = F.row_number().over(Window.partitionBy(*keys, *rest).orderBy(*(order or columns))) - 1
        rows = df.withColumn("row_pos", place)
        digest = F.conv(F.substring(F.sha2(F.to_json(F.struct("row_pos", *columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        grouped = rows.groupBy(*keys, *rest).agg(F.sum(digest).alias("__sum"), F.count(F.lit(1)).alias("__n"))
        content = F.substring(F.sha2(F.concat_ws("|", F.col("__sum").cast("string"), F.col("__n").cast("string")), 256), 1, DIGITS)
        recipe = {"mode": "table" if order else "dict" if columns != ["value"] else "value", "columns": {c: {"kind": "scalar"} for c in columns}}
        stamped, batch = self._stamped(name, grouped, keys, rest, content, json.dumps(recipe), branch_params, version, extra, hidden, lineage), uuid.uuid4().hex
        held = self._batches(name).withColumnRenamed("batch", "__held")
        stamped = checkpointed(stamped.join(held, "record_id", "left").withColumn("batch", F.coalesce("__held", F.lit(batch))).drop("__held"))
        records = stamped.where(F.col("batch") == batch).select("record_id", "batch", *keys, *rest)
        on = [rows[k].eqNullSafe(records[k]) for k in (*keys, *rest)]
        self._add_data(name, rows.join(records, on).select("record_id", "row_pos", "batch", *[rows[c] for c in columns]))
        if sketched:
            self._append("sketches", self._sketches(name, rows.join(records, on), batch, sketched))
        self._register(name, self.schema.level(keys), version, now(), columns=df.select(*columns).schema)
        self._append("record_log", stamped.select(*self.log().columns), "variable_name")
        return stamped

    def save_generated(self, name: str, df: DataFrame, branch_params: Column | None = None, extra: dict | None = None, hidden: tuple[str, ...] = (), lineage: Column | None = None, version: int = 1) -> DataFrame:
        """A record without data for every row of keys and version keys: what a function wrote elsewhere. Returns the log rows."""
        keys = [k for k in self.schema.keys if k in df.columns]
        rest = [c for c in df.columns if c not in keys]
        rows = self._stamped(name, norm_keys(df, keys).distinct(), keys, rest, F.lit("generated"), None, branch_params, version, extra, hidden, lineage)
        stamped = checkpointed(rows.withColumns({"record_id": F.concat(F.lit("generated:"), "record_id"), "content_hash": F.lit(None).cast("string"), "batch": F.lit(None).cast("string")}))
        self._register(name, self.schema.level(keys), version, now())
        self._append("record_log", stamped.select(*self.log().columns), "variable_name")
        return stamped

    def _stamped(self, name, grouped, keys, rest, content, recipe, branch_params, version, extra, hidden, lineage) -> DataFrame:
        """The log rows of a table of addresses: keys and version keys."""
        values = {n: F.lit(str(v)) for n, v in (extra or {}).items()} | {c: F.col(f"`{c}`") for c in rest if c not in hidden}
        version_keys = F.to_json(F.struct(*[values[n].alias(n) for n in sorted(values)]), {"ignoreNullFields": "false"}) if values else F.lit("{}")
        address = F.concat_ws("|", F.lit(name), F.lit(version), content, *[F.coalesce(F.col(k), F.lit("")) for k in keys], version_keys)
        stamped = grouped.withColumns({
            "record_id": F.substring(F.sha2(address, 256), 1, DIGITS), "timestamp": F.lit(now()), "schema_level": F.lit(self.schema.level(keys)).cast("string"),
            "version_keys": version_keys, "content_hash": content, "lineage_hash": F.lit(None).cast("string") if lineage is None else lineage, "schema_version": F.lit(version).cast("int"), "user_id": F.lit(self.user),
            "branch_params": F.lit("{}") if branch_params is None else branch_params, "recipe": F.lit(recipe).cast("string"), "variable_name": F.lit(name),
        })
        return stamped.withColumns({k: F.lit(None).cast("string") for k in self.schema.keys if k not in keys})

    def _batches(self, name: str) -> DataFrame:
        """(record_id, batch): which batch holds the data of each record there is."""
        log = self.log().where((F.col("variable_name") == name) & F.col("batch").isNotNull())
        return log.groupBy("record_id").agg(F.max_by("batch", F.struct("timestamp", "batch")).alias("batch"))

    def _add_data(self, name: str, rows: DataFrame, few: bool = False) -> None:
        """Append rows, in files of one shard each that are sorted by record; Spark splits and joins them to a good size."""
        placed = rows.withColumn("shard", shard(F.col("record_id")))
        placed = placed.coalesce(1) if few else placed.hint("rebalance", "shard")
        writer = placed.sortWithinPartitions("shard", "record_id", "row_pos").write.mode("append").partitionBy("shard")
        writer.option("parquet.bloom.filter.enabled#record_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(self._path(f"data/{name}"))

    def _add_lineage(self, rows: DataFrame) -> None:
        self._append("lineage", rows.join(self.table("lineage").select("output_record_id").distinct(), "output_record_id", "left_anti"))

    def save_lineage_only(self, name: str, lineage: dict, **metadata) -> str:
        """A log row and lineage without data, for functions that write files."""
        own, rest = self.schema.split(metadata)
        own = {k: norm_key_value(v) for k, v in own.items()}
        rid, stamp = f"generated:{lineage['lineage_hash'][:32]}", now()
        self._add_lineage(self.spark.createDataFrame([(rid, lineage["lineage_hash"], name, lineage.get("function_name"), lineage.get("function_hash"), json.dumps(lineage.get("inputs", [])), json.dumps(lineage.get("constants", {})), stamp)], LOGS["lineage"]))
        row = (*[own.get(k) for k in self.schema.keys], rid, stamp, self.schema.level(own), jsonmaps.canonical_json(rest), None, lineage["lineage_hash"], 1, self.user, "{}", None, None, name)
        self._append("record_log", self.spark.createDataFrame([row], self.log().schema), "variable_name", few=True)
        return rid

    # --- reading ---

    def records(self, name: str, version: str = "latest", include_excluded: bool = False, branch: dict | None = None, versions: dict | None = None, **keys) -> DataFrame:
        """Log rows of a variable. version: 'latest' of each variant, 'all' records once, a record id or a list of them.

        A key or version key takes a value or a list of them, of its type: 1 isn't '1'. branch:
        version keys of that name, else parameters by their full name or by the part after the
        last dot; one that fits several parameters is an error.
        """
        log = self.log().where(F.col("variable_name") == name)
        if not include_excluded:
            log = excluded(log, self.table("exclusions"))
        for k, v in keys.items():
            listed = [norm_key_value(x) for x in (v if isinstance(v, (list, tuple)) else [v])]
            log = log.where(F.col(f"`{k}`").isin(listed))
        if version == "all":
            log = latest(log, ["record_id"], "timestamp", "record_id")
        elif version == "latest":
            log = latest(log.withColumn("__variant", variant(F.col("version_keys"))), [*self.schema.keys, "__variant", "branch_params"], "timestamp", "record_id").drop("__variant")
        else:
            log = latest(log.where(F.col("record_id").isin(_listed(version))), ["record_id"], "timestamp", "record_id")
        for k, v in (versions or {}).items():
            texts = [jsonmaps.json_value(x) for x in (v if isinstance(v, (list, tuple)) else [v])]
            log = log.where(F.element_at(jsonmaps.typed(F.col("version_keys")), F.lit(k)).isin(texts))
        for k, v in (branch or {}).items():
            hits = jsonmaps.suffix_matches(jsonmaps.typed(F.col("branch_params")), k)
            if log.where(F.size(hits) > 1).first() is not None:
                raise AmbiguousParameter(f"{k!r} fits several parameters of {name}; give its full name")
            own = F.element_at(jsonmaps.typed(F.col("version_keys")), F.lit(k))
            log = log.where(F.coalesce(own, F.when(F.size(hits) == 1, F.map_values(hits)[0])) == jsonmaps.json_value(v))
        return log

    def scan(self, name: str, where: filters.Filter | None = None, rows: list[int] | None = None, **options) -> DataFrame:
        """Records with their data: keys, record_id, version_keys, branch_params, row_pos and the data columns.

        rows: the places, from 0, of the rows wanted of each record; all by default. Records given
        by id are named to the file scan; else their shards are, when Spark runs the join.
        """
        log = self.records(name, **options).select(*self.schema.keys, "record_id", "timestamp", "version_keys", "branch_params", "recipe", "batch")
        version = options.get("version", "latest")
        return self._with_data(name, log, where, rows, None if version in ("latest", "all") else _listed(version))

    def _with_data(self, name: str, log: DataFrame, where: filters.Filter | None = None, rows: list[int] | None = None, ids: list[str] | None = None) -> DataFrame:
        """Log rows with their data; ids: the records, where they are known."""
        data = self.data(name)
        if ids is not None:
            data = data.where(F.col("shard").isin(sorted({i[:1] for i in ids})) & F.col("record_id").isin(ids))
        if rows is not None:
            data = data.where(F.col("row_pos").isin(rows))
        held = log.where("batch IS NOT NULL").withColumn("shard", shard(F.col("record_id")))
        found = held.join(data, ["shard", "record_id", "batch"]).drop("shard", "batch")
        if rows is None:  # what a function wrote elsewhere has no data
            found = found.unionByName(log.where("batch IS NULL").drop("batch"), allowMissingColumns=True)
        found = found.select(*[F.col(f"`{c}`") for c in (*log.columns, *data.columns[1:]) if c not in ("batch", "shard")])  # data's first is record_id
        return found if where is None else filters.resolve(where, found, self.schema, self._filter_values, level=self.level(log))

    def fetch(self, name: str, ids: list[str]) -> DataFrame:
        """The records of these ids with their data, excluded ones too."""
        return self.scan(name, version=ids, include_excluded=True)

    def _filter_values(self, name: str) -> tuple[DataFrame, list[str]]:
        return self.scan(name), self.level(self.records(name))

    def level(self, rows: DataFrame) -> list[str]:
        """The keys that any row has a value of."""
        given = rows.agg(*[F.count(F.col(f"`{k}`")).alias(k) for k in self.schema.keys]).first()
        return [k for k in self.schema.keys if given[k]]

    def load(self, name: str, where: filters.Filter | None = None, **options):
        """The value at a location; several locations give a list of (keys, value).

        No record is NotFound; several variants at one location are AmbiguousVersion.
        """
        found = self.load_all(name, where, **options)
        if not found:
            raise NotFound(f"no {name} at {options}")
        places = [tuple(sorted(k.items())) for k, _, _ in found]
        if len(set(places)) < len(places):
            raise AmbiguousVersion(f"{name} has several variants at a location; choose by version keys, branch parameters or record id")
        return found[0][2] if len(found) == 1 else [(k, v) for k, _, v in found]

    def load_all(self, name: str, where: filters.Filter | None = None, **options) -> list[tuple[dict, str, object]]:
        """(keys, record id, value) of every record, newest first; for results that the driver can hold. Else use `scan`."""
        places = options.pop("rows", None)
        log = self.records(name, **options).select(*self.schema.keys, "record_id", "timestamp", "version_keys", "branch_params", "recipe", "batch")
        newest = [F.col("timestamp").desc(), F.col("record_id").desc()]
        records = log.orderBy(*newest).limit(NAMED_IDS + 1).collect() if where is None else []
        if 0 < len(records) <= NAMED_IDS:
            held, data = {(r["record_id"], r["batch"]): [] for r in records}, None
            if any(r["batch"] for r in records):
                wanted = [r["record_id"] for r in records]
                data = self.data(name).where(F.col("shard").isin(sorted({i[:1] for i in wanted})) & F.col("record_id").isin(wanted))
                data = data if places is None else data.where(F.col("row_pos").isin(places))
                for r in data.orderBy("record_id", "row_pos").collect():
                    if (r["record_id"], r["batch"]) in held:
                        held[r["record_id"], r["batch"]].append(r.asDict())
            rows = [log_row.asDict() | own for log_row in records for own in held[log_row["record_id"], log_row["batch"]] or [{}]]
        else:
            found = self._with_data(name, log, where, places)
            rows = [r.asDict() for r in found.orderBy(*newest, "row_pos").collect()]
        grouped: dict[str, list] = {}
        for r in rows:
            grouped.setdefault(r["record_id"], []).append(r)
        out = []
        for rid, own in grouped.items():
            keys = {k: typed_key_value(own[0][k]) for k in self.schema.keys if own[0][k] is not None}
            recipe = json.loads(own[0]["recipe"]) if own[0]["recipe"] else None
            value = None if recipe is None else types.decode(own, recipe)
            out.append((keys, rid, self.codecs[recipe["codec"]][1](value) if recipe and recipe.get("codec") in self.codecs else value))
        return out

    def head(self, name: str, n: int = 5, **options) -> pd.DataFrame:
        return self.scan(name, **options).orderBy(F.col("timestamp").desc(), F.col("record_id").desc(), "row_pos").limit(n).drop("recipe").toPandas()

    def list_versions(self, name: str, include_excluded: bool = False, **keys) -> DataFrame:
        log = self.records(name, "all", include_excluded, **keys)
        return log.select(*self.schema.keys, "record_id", "timestamp", "version_keys", "branch_params").orderBy(F.col("timestamp").desc(), F.col("record_id").desc())

    def list_variables(self) -> DataFrame:
        rows = latest(self.table("variables"), ["variable_name"], "timestamp", "variable_name").where("NOT dropped")
        return rows.select("variable_name", "schema_level", "schema_version", "description", "timestamp").orderBy("variable_name")

    def summary(self) -> DataFrame:
        """(variable_name, n_records, n_locations, newest) of all variables."""
        place = F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in self.schema.keys])
        return self.log().groupBy("variable_name").agg(F.countDistinct("record_id").alias("n_records"), F.countDistinct(place).alias("n_locations"), F.max("timestamp").alias("newest"))

    def _sketches(self, name: str, rows: DataFrame, batch: str, columns: tuple[str, ...]) -> DataFrame:
        """A row per column: mergeable sketches of the values that a save adds, combined before the shuffle."""
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])).alias("one")
        values = rows.select(each).select("one.*").where("v IS NOT NULL")
        held = [F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.hll_sketch_agg(F.xxhash64("v"), SKETCH_BITS).alias("distinct_values"), F.kll_sketch_agg_double("v").alias("quantiles")]
        summed = values.groupBy("column_name").agg(*held).where("n > 0")
        return summed.select(F.lit(name).alias("variable_name"), "column_name", F.lit(batch).alias("batch"), "n", "least", "most", "distinct_values", "quantiles")

    def sketch_summary(self, name: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
        """(column_name, n, least, most, distinct_values, quantiles) of all values ever saved with sketches, without reading them.

        Counts and bounds are exact, distinct values within some 1.6 % (one standard error),
        quantiles within some 1.7 % in rank. Nulls don't count; a save that found its records
        there already adds nothing.
        """
        rows = self.table("sketches").where(F.col("variable_name") == name).dropDuplicates(["batch", "column_name"])
        merged = rows.groupBy("column_name").agg(
            F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.hll_union_agg("distinct_values").alias("__d"), F.kll_merge_agg_double("quantiles").alias("__q")
        )
        found = F.array(*[F.kll_sketch_get_quantile_double("__q", F.lit(s)) for s in shares])
        return merged.select("column_name", "n", "least", "most", F.hll_sketch_estimate("__d").alias("distinct_values"), found.alias("quantiles"))

    def columns(self, name: str) -> dict[str, str]:
        """The data columns of a variable and their types."""
        return {n: t for n, t in self.data(name).dtypes if n not in ("record_id", "row_pos", "batch", "shard")}

    def list_variants(self) -> DataFrame:
        """(variable_name, version_keys, n_records): the variants of every variable, whatever records they were made from."""
        keys = F.map_filter(jsonmaps.typed(F.col("version_keys")), lambda k, _: ~k.startswith("__rid_"))
        return self.log().withColumn("version_keys", jsonmaps.json_object(keys)).groupBy("variable_name", "version_keys").agg(F.countDistinct("record_id").alias("n_records"))

    def find_by_lineage(self, lineage_hash: str) -> list[tuple[dict, str, object]]:
        """What the same function made of the same inputs before; empty if nothing."""
        rows = self.table("lineage").where(F.col("lineage_hash") == lineage_hash).select("variable_name", "output_record_id").distinct().collect()
        return [found for r in rows for found in self.load_all(r["variable_name"], version=r["output_record_id"])]

    def distinct_values(self, key: str) -> list:
        return [typed_key_value(r[0]) for r in self.log().select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).collect()]

    def view(self, name: str) -> str:
        """A temporary view of a variable, excluded records too, for SQL; returns its name."""
        marks = latest(self.table("exclusions"), ["record_id"], "timestamp", F.col("excluded").cast("int")).select("record_id", "excluded")
        rows = self.scan(name, version="all", include_excluded=True).join(marks, "record_id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
        rows.drop("recipe").createOrReplaceTempView(name)
        return name

    def sql(self, text: str, **args) -> DataFrame:
        """SQL over the variables' views."""
        for row in self.list_variables().collect():
            self.view(row["variable_name"])
        return self.spark.sql(text, args=args or None)

    # --- about variables and records ---

    def _register(self, name: str, level: str | None, version: int, stamp: str, description: str = "", dropped: bool = False, columns: T.StructType | None = None) -> None:
        kinds = None if columns is None else T.StructType([T.StructField(c.name, c.dataType) for c in columns]).json()
        self._append("variables", self.spark.createDataFrame([(name, level, version, description, dropped, stamp, kinds)], LOGS["variables"]), few=True)

    def describe(self, name: str, description: str) -> None:
        known = self._known(name)
        self._register(name, known[0], known[1], now(), description)

    def _known(self, name: str) -> tuple[str | None, int]:
        row = latest(self.table("variables").where(F.col("variable_name") == name), ["variable_name"], "timestamp", "variable_name").first()
        return (row["schema_level"], row["schema_version"]) if row else (None, 1)

    def drop(self, name: str) -> None:
        """Forget a variable; its files and log rows stay as history."""
        known = self._known(name)
        self._register(name, known[0], known[1], now(), dropped=True)

    def exclude(self, rid: str, excluded: bool = True) -> None:
        self._append("exclusions", self.spark.createDataFrame([(rid, excluded, now())], LOGS["exclusions"]), few=True)

    def exclude_all(self, records: DataFrame, excluded: bool = True) -> None:
        """Exclude or include every record_id of a table."""
        self._append("exclusions", records.select("record_id", F.lit(excluded).alias("excluded"), F.lit(now()).alias("timestamp")))

    def include(self, rid: str) -> None:
        self.exclude(rid, False)

    def group(self, name: str, variables: Iterable[str], present: bool = True) -> None:
        """Add variables to a group, or take them out."""
        self._append("groups", self.spark.createDataFrame([(name, v, present, now()) for v in variables], LOGS["groups"]), few=True)

    def group_members(self, name: str) -> list[str]:
        rows = latest(self.table("groups").where(F.col("group_name") == name), ["variable_name"], "timestamp", F.col("present").cast("int"))
        return [r[0] for r in rows.where("present").select("variable_name").orderBy("variable_name").collect()]

    def groups(self) -> list[str]:
        rows = latest(self.table("groups"), ["group_name", "variable_name"], "timestamp", F.col("present").cast("int"))
        return [r[0] for r in rows.where("present").select("group_name").distinct().orderBy("group_name").collect()]

    def export_csv(self, name: str, path: str, **options) -> int:
        """Write the variable's rows as CSV with `_record_id` and `_meta_` columns; returns the number of records."""
        rows = self.scan(name, **options).drop("recipe", "timestamp")
        flat = [F.to_json(c).alias(c) if isinstance(rows.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{c}`") for c in rows.columns]
        renamed = rows.select(*flat).withColumnsRenamed({"record_id": "_record_id", "version_keys": "_meta_version_keys", "branch_params": "_meta_branch_params"} | {k: f"_meta_{k}" for k in self.schema.keys})
        renamed.write.mode("overwrite").csv(path, header=True)
        return rows.select("record_id").distinct().count()

    def provenance(self, rid: str | None = None, **keys) -> DataFrame:
        """Lineage of a record, or of all records at some keys."""
        log = latest(self.log(), ["record_id"], "timestamp", "record_id")
        for k, v in keys.items():
            log = log.where(F.col(k) == norm_key_value(v))
        rows = self.table("lineage").drop("timestamp", "variable_name", "lineage_hash").join(log, F.col("output_record_id") == F.col("record_id"))
        return rows if rid is None else rows.where(F.col("record_id") == rid)

    def edges(self) -> DataFrame:
        """(child, parent) record ids of all lineage."""
        inputs = F.from_json("inputs", "array<struct<name:string,record_id:string>>")
        used = self.table("lineage").select(F.col("output_record_id").alias("child"), F.explode(inputs).alias("i")).select("child", F.col("i.record_id").alias("parent")).where("parent IS NOT NULL")
        sets = self.table("record_sets").distinct()
        members = used.join(sets, F.col("parent") == F.col("set_id")).select("child", F.col("record_id").alias("parent"))
        return used.where(~F.col("parent").startswith("set:")).unionByName(members)

    def superseded(self, edges: DataFrame | None = None) -> DataFrame:
        """(record_id): records that were used as inputs and aren't the newest of their variant any more, or are excluded."""
        log = excluded(self.log(), self.table("exclusions")).withColumn("__variant", variant(F.col("version_keys")))
        newest = latest(log, ["variable_name", *self.schema.keys, "__variant", "branch_params"], "timestamp", "record_id").select("record_id")
        used = (self.edges() if edges is None else edges).select(F.col("parent").alias("record_id")).distinct()
        return used.join(newest, "record_id", "left_anti")

    def upstream(self, rid: str, hops: int = 20) -> DataFrame:
        """How a record came about, by functions, inputs and parameters: see `lineage.upstream`."""
        from ..plans.lineage import upstream  # which itself needs stores

        log = latest(excluded(self.log(), self.table("exclusions")), ["record_id"], "timestamp", "record_id")
        return upstream(log, self.spark.createDataFrame([(rid,)], "record_id string"), list(self.schema.keys), hops)

    def expected(self, function_name: str) -> DataFrame:
        """The combinations that the function's newest run expected."""
        rows = self.table("expected").where(F.col("function_name") == function_name)
        return rows.join(F.broadcast(rows.agg(F.max("run").alias("run"))), "run")

    def schema_ids(self) -> DataFrame:
        """(schema_id, schema_level, keys): an id of every location that has a record, the same on every call."""
        places = self.log().select("schema_level", *self.schema.keys).distinct()
        address = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`"), F.lit("\x00")) for k in self.schema.keys])
        return places.select(F.xxhash64(address).alias("schema_id"), "schema_level", *self.schema.keys)

    def find_id(self, name: str, **options) -> str | None:
        """The newest record id that fits; None if there is none."""
        row = self.records(name, **options).orderBy(F.col("timestamp").desc(), F.col("record_id").desc()).select("record_id").first()
        return row[0] if row else None
