"""The pipeline as a graph of functions and variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonmaps
from ..operators.combos import first_seen
from ..operators.filters import Compare, Filter
from ..plans.foreach import EachOf
from ..sources.store import checkpointed

RANK = {"red": 0, "grey": 1, "green": 2}


def propagate(own: DataFrame, edges: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """(node, effective): the worst of a node's own state and those of all it depends on.

    own: (node, state); edges: (child, parent), a child depending on its parent. A node in a
    cycle, which depends on itself, is red; nodes that no row of `own` names are green; a
    green node with a pending constant is grey.

    Each round settles the nodes whose parents are all settled, so there are as many as the
    longest chain has nodes, of any length. What no round settles is in a cycle or below one.
    """
    rank = F.when(F.col("state") == "red", 0).when(F.col("state") == "grey", 1).otherwise(2)
    ranked = own.select("node", rank.alias("rank"))
    if pending is not None:
        ranked = ranked.join(pending.select("node").distinct().withColumn("__pending", F.lit(True)), "node", "left")
        ranked = ranked.select("node", F.when(F.col("__pending"), F.least("rank", F.lit(1))).otherwise(F.col("rank")).alias("rank"))
    edges = checkpointed(edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct())
    nodes = ranked.unionByName(edges.select(F.col("child").alias("node"), F.lit(None).cast("int").alias("rank"))).groupBy("node").agg(F.min("rank").alias("rank"))
    worst = checkpointed(nodes.withColumn("settled", F.lit(False)))
    left = worst.count()
    while left:
        parents = worst.select(F.col("node").alias("parent"), F.col("rank").alias("__rank"), F.col("settled").alias("__settled"))
        above = edges.join(parents, "parent", "left").groupBy(F.col("child").alias("node"))
        above = above.agg(F.min("__rank").alias("__rank"), F.bool_and(F.coalesce("__settled", F.lit(True))).alias("__settled"))
        worst = worst.join(above, "node", "left").select("node", F.least("rank", "__rank").alias("rank"), F.coalesce("__settled", F.lit(True)).alias("settled"))
        worst = checkpointed(worst)
        before, left = left, worst.where("NOT settled").count()
        if left == before:
            break
    worst = worst.select("node", F.when(F.col("settled"), F.col("rank")).otherwise(0).alias("rank")).where("rank IS NOT NULL")
    named = F.when(F.col("rank") == 0, "red").when(F.col("rank") == 1, "grey").otherwise("green")
    return worst.select("node", named.alias("effective"))


def nodes_and_edges(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of the runs: variants (function_name, output, inputs map<param,variable>, constants map, record_count)."""
    exploded = variants.select("function_name", "output", F.explode_outer("inputs").alias("param", "variable"))
    nodes = (
        variants.select(F.col("function_name").alias("id"), F.lit("function").alias("kind"))
        .union(variants.select("output", F.lit("variable")))
        .union(exploded.where("variable IS NOT NULL").select("variable", F.lit("variable")))
        .union(variants.select(F.explode(F.map_keys("constants")).alias("id"), F.lit("constant").alias("kind")))
        .distinct()
    )
    edges = (
        exploded.where("variable IS NOT NULL").select(F.col("variable").alias("source"), F.col("function_name").alias("target"))
        .union(variants.select("function_name", "output"))
        .union(variants.select(F.explode(F.map_keys("constants")), "function_name"))
        .distinct()
    )
    return nodes, edges


def constant_values(variants: DataFrame) -> DataFrame:
    """(constant, value, record_count, functions): how many records each value of each constant made."""
    each = variants.select("function_name", "record_count", F.explode("constants").alias("constant", "value"))
    return each.groupBy("constant", "value").agg(F.sum("record_count").alias("record_count"), F.array_sort(F.collect_set("function_name")).alias("functions"))


def hide(nodes: DataFrame, edges: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the hidden nodes and the edges at them."""
    ids = hidden.select("id").distinct()
    kept = nodes.join(ids, "id", "left_anti")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return kept, edges


def pending_constants(pending: DataFrame, variants: DataFrame) -> DataFrame:
    """The (constant, value) pairs that no run has used yet."""
    return pending.join(constant_values(variants).select("constant", "value"), ["constant", "value"], "left_anti")


def merge_edges(found: DataFrame, manual: DataFrame) -> DataFrame:
    """Edges of the runs, then those drawn by hand that are new."""
    return found.select("source", "target").unionByName(manual.select("source", "target")).distinct()


def inferred_variants(constants: dict[str, DataFrame]) -> DataFrame:
    """All combinations of the constants' values: a column for each."""
    sides = [df.select(F.col("value").alias(name)).distinct() for name, df in constants.items()]
    out = sides[0]
    for side in sides[1:]:
        out = out.crossJoin(side)
    return out


def filter_variants(variants: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The variants that have all the wanted constants; all of them if none has."""
    hit = F.lit(True)
    for name, value in wanted.items():
        hit = hit & F.coalesce(F.element_at("constants", F.lit(name)) == str(value), F.lit(False))
    marked = variants.withColumn("__hit", hit)
    some = F.broadcast(marked.agg(F.coalesce(F.bool_or("__hit"), F.lit(False)).alias("__some")))  # one row
    return marked.crossJoin(some).where(F.col("__hit") | ~F.col("__some")).drop("__hit", "__some")


def dedupe_by_constants(variants: DataFrame, position: str) -> DataFrame:
    """Of variants with the same constants the first, in the order of `position`."""
    return first_seen(variants.withColumn("__c", jsonmaps.canonical_map(F.col("constants"))), ["__c"], position).drop("__c")


def merge_pending(variants: DataFrame, pending: DataFrame) -> DataFrame:
    """The variants, and for each pending (constant, value) the variants with that constant changed to it, as not run.

    A pending value of a constant that a variant lacks is added to it; variants that are there already don't come twice.
    """
    changed = variants.crossJoin(pending.select(F.col("constant").alias("__k"), F.col("value").alias("__v")))
    changed = changed.withColumn("constants", jsonmaps.merged(F.col("constants"), F.create_map("__k", "__v"))).withColumn("record_count", F.lit(0).cast("long")).select(*variants.columns)
    keyed = lambda df: df.withColumn("__c", jsonmaps.canonical_map(F.col("constants")))
    rest = [c for c in ("function_name", "output") if c in variants.columns]
    new = keyed(changed).dropDuplicates([*rest, "__c"]).join(keyed(variants).select(*rest, "__c").distinct(), [*rest, "__c"], "left_anti")
    return variants.unionByName(new.drop("__c"))


def merge_nodes(found: DataFrame, manual: DataFrame) -> DataFrame:
    """(id, kind, manual): nodes of the runs, then those placed by hand that no run has made real yet."""
    placed = manual.select("id", "kind").distinct().join(found.select("id").distinct(), "id", "left_anti")
    return found.select("id", "kind").distinct().withColumn("manual", F.lit(False)).unionByName(placed.withColumn("manual", F.lit(True)))


def graduated(found: DataFrame, manual: DataFrame) -> DataFrame:
    """(id): nodes placed by hand that runs have made real."""
    return manual.select("id").distinct().join(found.select("id"), "id", "left_semi")


def resolve_edges(edges: DataFrame, nodes: DataFrame, signatures: DataFrame) -> DataFrame:
    """(function_name, param, source, kind): what each parameter of a function is bound to.

    edges: (source, target, handle); a handle names the parameter, and edges without one take
    the free parameters in order, as the edges are sorted by source. nodes: (id, kind);
    signatures: (function_name, position, param).
    """
    into = edges.join(nodes.select(F.col("id").alias("target"), F.col("kind").alias("__target")), "target").where(F.col("__target") == "function")
    into = into.join(nodes.select(F.col("id").alias("source"), "kind"), "source").select(F.col("target").alias("function_name"), "source", "kind", "handle")
    named = into.join(signatures.select("function_name", F.col("param").alias("handle")), ["function_name", "handle"]).select("function_name", F.col("handle").alias("param"), "source", "kind")
    free = signatures.join(named.select("function_name", "param"), ["function_name", "param"], "left_anti")
    by_place = lambda df, *order: df.withColumn("__n", F.row_number().over(Window.partitionBy("function_name").orderBy(*order)))
    loose = by_place(into.where("handle IS NULL"), "source").join(by_place(free, "position").select("function_name", "param", "__n"), ["function_name", "__n"])
    return named.unionByName(loose.select("function_name", "param", "source", "kind"))


def key_values(log: DataFrame, keys: list[str], level: str | None = None, wanted: dict[str, list] | None = None) -> dict[str, DataFrame]:
    """For each key down to `level`: its values in the log, or those wanted of it; for `for_each`'s combinations."""
    down = keys[: keys.index(level) + 1] if level else keys
    out = {}
    for k in down:
        values = log.select(F.col(k).cast("string").alias(k)).where(F.col(k).isNotNull()).distinct()
        out[k] = values.where(F.col(k).isin([str(v) for v in wanted[k]])) if wanted and wanted.get(k) else values
    return out


def where_of(rows: list[dict]) -> Filter | EachOf | None:
    """Filters written as rows (variable, column, op, value): one is a filter, several are alternatives, each run on its own."""
    built = [Compare(r["variable"], r.get("column") or "value", r["op"].lower(), tuple(r["value"]) if r["op"].lower() == "in" else r["value"]) for r in rows]
    return None if not built else built[0] if len(built) == 1 else EachOf(*built)


def pipeline_structure(log: DataFrame) -> DataFrame:
    """(function_name, function_hash, output, input_types) of all runs in a record log."""
    keys = F.from_json("version_keys", "map<string,string>")
    inputs = F.from_json(F.element_at(keys, F.lit("__inputs")), "map<string,string>")
    return (
        log.where(keys.isNotNull() & F.map_contains_key(keys, "__fn"))
        .select(F.element_at(keys, F.lit("__fn")).alias("function_name"), F.element_at(keys, F.lit("__fn_hash")).alias("function_hash"), F.col("variable_name").alias("output"), F.array_sort(F.map_values(inputs)).alias("input_types"))
        .distinct()
    )
