"""Where values come from: wrapped functions, lineage hashes, walks over the lineage graph."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import update_wrapper

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constant import plain_value
from ..functions import jsonmaps
from ..functions.hashing import canonical_hash, function_hash
from ..sources.store import Store, checkpointed


class LineageFunction:
    """A function whose results know what made them.

    unpack: a tuple is several outputs. generates_file: called for its effect; only lineage
    is kept of it, with the keys as further arguments.
    """

    def __init__(self, function: Callable, unpack: bool = False, generates_file: bool = False, name: str | None = None):
        self.function, self.unpack, self.generates_file = function, unpack, generates_file
        self.hash = canonical_hash(f"{function_hash(function)}-{unpack}")
        update_wrapper(self, function)
        self.__name__ = name or function.__name__

    def __call__(self, *args, **kwargs):
        return self.function(*args, **kwargs)

    def trace(self, *args, **kwargs):
        """Call the function and remember how: a Result, or one of each output with unpack."""
        bound = inspect.signature(self.function).bind(*args, **kwargs).arguments  # TypeError if one is lacking
        call = Invocation(self, dict(bound))
        out = self.function(**{n: v.data if isinstance(v, (Result, Saved)) else plain_value(v) for n, v in bound.items()})
        if not self.unpack:
            return Result(out, call, 0)
        return tuple(Result(v, call, n) for n, v in enumerate(out))


@dataclass(frozen=True)
class Saved:
    """A value that was loaded, with its record id."""

    data: object
    record_id: str
    variable_name: str


@dataclass(frozen=True)
class Invocation:
    """A function and what it was called with."""

    function: LineageFunction
    inputs: dict

    def classified(self) -> list[dict]:
        """Each input as (name, kind, what identifies it): a result, a saved record, raw data or a constant."""
        out = []
        for name, v in sorted(self.inputs.items()):
            if isinstance(v, Result):
                out.append({"name": name, "kind": "result", "hash": v.hash, "record_id": v.record_id})
            elif isinstance(v, Saved):
                out.append({"name": name, "kind": "record", "hash": v.record_id, "record_id": v.record_id})
            else:
                v = plain_value(v)
                out.append({"name": name, "kind": "raw" if isinstance(v, (np.ndarray, pd.DataFrame, pd.Series)) else "constant", "hash": canonical_hash(v), "record_id": None})
        return out

    @property
    def hash(self) -> str:
        return canonical_hash([self.function.hash, [[i["name"], i["kind"], i["hash"]] for i in self.classified()]])


@dataclass
class Result:
    """What a traced call returned; `record_id` once it is saved."""

    data: object
    made_by: Invocation
    number: int
    record_id: str | None = None

    @property
    def hash(self) -> str:
        return canonical_hash(f"{self.made_by.hash}-output-{self.number}")

    def lineage(self) -> dict:
        """The lineage entry of a store."""
        inputs = self.made_by.classified()
        constants = {i["name"]: json.dumps(plain_value(self.made_by.inputs[i["name"]]), default=str) for i in inputs if i["kind"] == "constant"}
        listed = [{"name": i["name"], "record_id": i["record_id"]} for i in inputs if i["kind"] in ("record", "result")]
        return {"lineage_hash": self.hash, "function_name": self.made_by.function.__name__, "function_hash": self.made_by.function.hash, "inputs": listed, "constants": constants}

    def upstream(self) -> list[dict]:
        """The steps that led here, the nearest first, each once."""
        seen, open_, out = set(), [self], []
        while open_:
            at = open_.pop(0)
            if at.hash not in seen:
                seen.add(at.hash)
                out.append(at.lineage())
                open_ += [v for v in at.made_by.inputs.values() if isinstance(v, Result)]
        return out


def save_result(store: Store, name: str, result: Result, **metadata) -> str:
    """Save a result with its lineage, and the function and constants as version keys; returns the record id."""
    entry = result.lineage()
    versions = {"__fn": entry["function_name"], "__fn_hash": entry["function_hash"], "__constants": json.dumps(entry["constants"], sort_keys=True), "__output_num": str(result.number)}
    result.record_id = store.save(name, result.data, {f"{entry['function_name']}.{k}": json.loads(v) for k, v in entry["constants"].items()}, entry, **metadata, **versions)
    return result.record_id


def load_saved(store: Store, name: str, **options) -> Saved:
    """A record's value with its id, as an input of a traced call."""
    found = store.load_all(name, **options)
    if len(found) != 1:
        raise LookupError(f"{len(found)} records of {name} at {options}")
    return Saved(found[0][2], found[0][1], name)


def lineage_function(function: Callable | None = None, **options):
    """Decorator form of LineageFunction."""
    return LineageFunction(function, **options) if function else lambda f: LineageFunction(f, **options)


def manual(data, label: str, reason: str, source: Result | Saved | None = None) -> Result:
    """A value edited by hand, as a step of its own that says why."""
    if not label or not reason:
        raise ValueError("a manual edit needs a label and a reason")
    step = LineageFunction(lambda **_: data, name=f"manual:{label}")
    return Result(data, Invocation(step, {"reason": reason, "data": canonical_hash(data)} | ({"source": source} if source is not None else {})), 0)


def ancestors(edges: DataFrame, hops: int = 20, start: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, hops): all ancestors within `hops` steps, by the shortest way.

    edges: (child, parent). Each step joins the newly reached ancestors only, so cycles end;
    it stops when nothing new is reached. Steps are cut in the shared checkpoint folder, so
    each is computed once.
    """
    edges = checkpointed(edges.select("child", "parent").distinct())
    first = edges if start is None else edges.join(start.select(F.col("node").alias("child")).distinct(), "child", "left_semi")
    reached = front = first.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("hops"))
    for step in range(2, hops + 1):
        onward = front.select("node", F.col("ancestor").alias("child")).join(edges, "child")
        new = onward.select("node", F.col("parent").alias("ancestor"), F.lit(step).alias("hops")).distinct()
        front = checkpointed(new.join(reached, ["node", "ancestor"], "left_anti"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def outdated(edges: DataFrame, stale: DataFrame, hops: int = 50) -> DataFrame:
    """(node): all that have one of the `stale` record ids among their ancestors within `hops` steps.

    Goes down from the stale records, each step from the newly reached ones only, so that the
    work is what is outdated, not all pairs of ancestors, and cycles end.
    """
    edges = checkpointed(edges.select("child", "parent").distinct())
    front = checkpointed(edges.join(stale.select(F.col("record_id").alias("parent")).distinct(), "parent", "left_semi").select(F.col("child").alias("node")).distinct())
    reached = front
    for _ in range(hops - 1):
        onward = edges.join(front.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        front = checkpointed(onward.join(reached, "node", "left_anti"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def superseded(edges: DataFrame, stale: DataFrame, hops: int = 50) -> DataFrame:
    """(node, superseded): whether any ancestor is among the `stale` record ids, of every node that has ancestors."""
    hit = outdated(edges, stale, hops).withColumn("superseded", F.lit(True))
    return edges.select(F.col("child").alias("node")).distinct().join(hit, "node", "left").select("node", F.coalesce("superseded", F.lit(False)).alias("superseded"))


def memo(lineage: DataFrame, log: DataFrame, wanted: str | DataFrame) -> DataFrame:
    """Log rows of what the same functions made of the same inputs before; wanted: a lineage hash, or a table of them."""
    found = lineage.where(F.col("lineage_hash") == wanted) if isinstance(wanted, str) else lineage.join(wanted.select("lineage_hash").distinct(), "lineage_hash", "left_semi")
    return log.join(found.select(F.col("output_record_id").alias("record_id")).distinct(), "record_id", "left_semi")


def best_parents(children: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """(child, param, input, parent): for each input of a child the record whose parameters are the largest part of the child's.

    children: (child, param, input, own as a map of JSON texts, keys), a row per input that a
    child has; records: (record_id, variable_name, params as such a map, keys). Records are
    found by an inverted index of (variable, location, name, value): a record is a part of
    the child if as many of its entries are found among the child's as it has. So only records
    that share an entry meet a child, not all at its location; those without parameters fit
    every child there, and only the greatest id of them, which would win, is kept. Ties go to
    the greatest id. Null keys are values of their own.
    """
    place = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]))  # nulls are left out, so that they differ from any value
    parents = records.select(F.col("record_id").alias("parent"), F.col("variable_name").alias("input"), place.alias("place"), "params", F.size("params").alias("n"))
    wanted = children.select("child", "param", "input", place.alias("place"), "own")
    index = parents.where("n > 0").select("parent", "input", "place", "n", F.explode("params").alias("name", "value"))
    asked = wanted.select("child", "param", "input", "place", F.explode("own").alias("name", "value"))
    met = asked.join(index, ["input", "place", "name", "value"]).groupBy("child", "param", "input", "parent", "n").agg(F.count(F.lit(1)).alias("found")).where("found = n").drop("found")
    plain = parents.where("n = 0").groupBy("input", "place").agg(F.max("parent").alias("parent"), F.max("n").alias("n"))
    bare = wanted.join(plain, ["input", "place"]).select("child", "param", "input", "parent", "n")
    both = met.unionByName(bare)
    return both.groupBy("child", "param", "input").agg(F.max_by("parent", F.struct("n", "parent")).alias("parent"))


def variant_edges(records: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """(child, parent) by branch parameters: at a child's location, of each input variable the record whose
    parameters are the largest part of the child's.

    records: (record_id, variable_name, branch_params as JSON, keys); inputs: (output, input) variables.
    """
    known = records.withColumn("params", jsonmaps.typed(F.col("branch_params")))
    children = known.select(F.col("record_id").alias("child"), F.col("variable_name").alias("output"), F.col("params").alias("own"), *keys)
    wanted = children.join(inputs.select("output", "input").distinct(), "output").withColumn("param", F.col("input"))
    return best_parents(wanted, known, keys).select("child", "parent")


def upstream(records: DataFrame, start: DataFrame, keys: list[str], hops: int = 20) -> DataFrame:
    """(start, record_id, depth, function_name, param, parent): the provenance of records by their version keys and parameters.

    records: log rows, each record once, with version_keys whose __fn and __inputs say how it
    was made; start: (record_id). Depth 0 is the record asked for; a record is visited once
    from a start, at its least depth, so cycles end; a row per input found, or one with null
    param and parent. Each hop joins the newly reached records only.
    """
    version = jsonmaps.as_map(F.col("version_keys"))
    known = checkpointed(
        records.select(
            "record_id", "variable_name", jsonmaps.typed(F.col("branch_params")).alias("params"), *keys,
            F.element_at(version, F.lit("__fn")).alias("function_name"), F.from_json(F.element_at(version, F.lit("__inputs")), "map<string,string>").alias("inputs"),
        )
    )
    front = checkpointed(start.select("record_id").distinct().join(known.select("record_id"), "record_id", "left_semi").select(F.col("record_id").alias("start"), "record_id"))
    reached, steps = front, []
    for depth in range(hops + 1):
        made = front.select(F.col("record_id").alias("child")).distinct().join(known.withColumnRenamed("record_id", "child"), "child")
        wanted = made.select("child", F.col("params").alias("own"), *keys, F.explode("inputs").alias("param", "input"))
        found = best_parents(wanted, known, keys)
        links = made.select("child", "function_name").join(found, "child", "left").select(F.col("child").alias("record_id"), "function_name", "param", "parent")
        step = checkpointed(front.join(links, "record_id").select("start", "record_id", F.lit(depth).alias("depth"), "function_name", "param", "parent"))
        steps.append(step)
        onward = step.where("parent IS NOT NULL").select("start", F.col("parent").alias("record_id")).distinct()
        front = checkpointed(onward.join(reached, ["start", "record_id"], "left_anti"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out
