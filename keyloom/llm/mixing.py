"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source gets a token target. Its documents, in a shuffled order fixed by a digest of
their ids, are queued `passes` times over; a copy's virtual finish time is the source's
cumulative tokens up to and including it, divided by the source's target. The queue of all
copies is sorted by that time and cut where the total budget is used up.

Cumulative sums never gather a source in one task: rows are dealt into buckets by the
leading part of the sort key, summed within each bucket, and shifted by the totals of the
buckets before it (a table with one row per bucket).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot, packed

#: Words are runs of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights given to the sources in turn, by code point order of their names.
WEIGHTS = (3, 1, 2)
#: The budget as a share of all sizes; the most copies of a document.
BUDGET, PASSES = 1.5, 2
#: Rows that a bucket of the running sums is planned for, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 200, 8_192
#: The table of sources is broadcast up to so many rows.
BROADCAST_ROWS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """(source, source_no, source_size, target) for (source, source_size).

    A target is min(passes * size, level * weight) and the targets sum to the budget. The
    level is found by filling: with the sources in order of passes * size / weight, those
    before the level are capped at passes * size and the others share what is left by
    weight. One row per source, whatever the number of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("source_no", F.row_number().over(order))
    ranked = ranked.withColumn("weight", F.element_at(ring, ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(passes)) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source_no"))
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.lit(min(budget, float(passes))) * F.sum("source_size").over(everything)
    filled = ranked.withColumn("level", (total - before) / rest).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    share = F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))
    return filled.select("source", "source_no", "source_size", share.alias("target"))


def running(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Running sum of `value` within keys[:-1], in the order of keys[-1] (a bucket) and then `order`.

    No key may be null. Only the bucket totals, one row each, are ordered across buckets.
    """
    *group, bucket = keys
    by_bucket = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    shift = totals.select(*keys, F.coalesce(F.sum("__sum").over(by_bucket), F.lit(0)).alias("__shift"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("__within", F.sum(value).over(within))
    return summed.join(shift, keys).withColumn(out, F.col("__within") + F.col("__shift")).drop("__within", "__shift")


def _by_source(rows: DataFrame, side: DataFrame, sources: int, n: int) -> DataFrame:
    """rows (n of them) with the columns of their source's row in `side` (source, ...); neither has a column `__source`."""
    if sources <= BROADCAST_ROWS:
        other = F.broadcast(side.withColumnRenamed("source", "__source"))
        return rows.join(other, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return join_hot(rows.withColumn("__source", name), side.withColumn("__source", name).drop("source"), "__source", n).drop("__source")


def _shuffle() -> Column:
    return F.md5(F.concat(F.lit("mix "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _place() -> Column:
    """Where a row stands in its source's queue, as a value that orders as the queue does."""
    return F.struct("shuffle", F.col("doc_id").isNull().alias("null"), "doc_id", "size", "tie")


def _queued(docs: DataFrame, tie: Column | None, weights: tuple[int, ...], budget: float, passes: int) -> tuple[DataFrame, list[Column], int, int]:
    """Every document with its running words, whether each of its copies is taken, and the numbers of sources and rows.

    (doc_id, source, size, source_no, source_size, target, upto), with `tie` also shuffle and tie,
    which orders what is equal in all else, in the checkpoint folder.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _shuffle().alias("shuffle"), *([] if tie is None else [tie.alias("tie")])))
    level = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, passes))
    largest = sized.groupBy("source").agg(F.max("size").alias("most")).agg(F.sum("most")).first()[0] or 0
    open_ = F.sum(F.when(F.col("target") < passes * F.col("source_size"), F.col("target")))
    seen = level.agg(F.count(F.lit(1)).alias("sources"), F.sum("target").alias("total"), open_.alias("open")).first()
    latest = 1.001 + (1.001 * (largest + 1) / seen["open"] if seen["open"] else 0.0)
    rows = sized.count()
    spread = min(MOST_BUCKETS, max(8, rows // BUCKET_ROWS))
    known = _by_source(sized, level, seen["sources"], rows)
    leading = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    known = known.withColumn("bucket", F.floor(leading * spread))
    order = [F.col("shuffle"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    counted = running(known, ["source_no", "bucket"], order if tie is None else [*order, F.col("tie")], "size", "upto")
    counted = cut(packed(counted.drop("bucket", *(("shuffle",) if tie is None else ())), rows))
    laps = [(F.col("upto") + F.lit(lap) * F.col("source_size")) / F.col("target") for lap in range(passes)]
    queue = counted.where((F.col("size") > 0) & (F.col("target") > 0)).select("source_no", "size", "upto", F.explode(F.array(*laps)).alias("finish"))
    # by any finish time x a source has given x * target, all its words or a document less; so the budget is used up by `latest`
    queue = queue.where(F.col("finish") <= F.lit(latest)).withColumn("slice", F.floor(F.col("finish") / F.lit(latest) * spread))
    queue = running(queue, ["slice"], [F.col("finish"), F.col("source_no"), F.col("upto")], "size", "all")
    # half a token of slack: the targets are doubles that sum to the budget up to rounding
    last = queue.where(F.col("all") <= F.lit((seen["total"] or 0.0) + 0.5)).agg(F.max("finish").alias("finish")).first()["finish"]
    taken = [F.coalesce((F.col("size") > 0) & (F.col("target") > 0) & (lap <= F.lit(-1.0 if last is None else last)), F.lit(False)) for lap in laps]
    return counted, taken, seen["sources"], rows


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """How often the mix takes each document: (doc_id, source, size, source_size, target, copies, taken).

    docs needs doc_id, text and source; other columns are ignored. Null text has size 0; a
    null source is a source of its own, the last one; a null doc_id is shuffled like an
    empty one. Documents without words are taken 0 times. Repeated rows are documents of
    their own. An empty table gives an empty table. Where a copy of one source and a copy of
    another finish at the very time at which the budget runs out, both are taken.
    """
    counted, taken, _, _ = _queued(docs, None, weights, budget, passes)
    copies = sum((t.cast("int") for t in taken), F.lit(0))
    return counted.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """docs as the mix takes them: each row once for every copy, with its columns unchanged.

    Every source gives as many words as `mix` says, whatever its ids: null and repeated ids
    are told apart by their whole rows, and of rows that are equal in all columns as many are
    taken as have their turn. Nulls, empty texts and empty tables are as in `mix`. A source's
    queue is cut at one place in each pass, so that rows are taken where they lie, by a
    table of these places; texts aren't shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tie = F.sha2(F.to_json(row), 256)
    counted, taken, sources, rows = _queued(docs, tie, weights, budget, passes)
    counted = counted.withColumn("place", _place())
    last = cut(counted.groupBy("source").agg(*[F.max(F.when(t, F.col("place"))).alias(f"last{k}") for k, t in enumerate(taken)]))  # a row per source
    at = [F.coalesce(F.col("place") == F.col(f"last{k}"), F.lit(False)) for k in range(passes)]
    ends = _by_source(counted, last, sources, rows).groupBy(F.col("source").alias("other"))
    ends = ends.agg(*[F.count(F.when(a & t, 1)).alias(f"some{k}") for k, (a, t) in enumerate(zip(at, taken))], *[F.count(F.when(a, 1)).alias(f"all{k}") for k, a in enumerate(at)])
    cuts = cut(last.join(ends, F.col("source").eqNullSafe(F.col("other"))).drop("other"))
    placed = docs.select("source", "doc_id", _shuffle().alias("shuffle"), word_count(F.col("text")).alias("size"), tie.alias("tie"), row.alias("row")).where("size > 0")
    known = _by_source(placed.select("source", _place().alias("place"), "row"), cuts, sources, rows)
    part = [F.col(f"some{k}") < F.col(f"all{k}") for k in range(passes)]
    before = [F.coalesce(F.col("place") < F.col(f"last{k}"), F.lit(False)) for k in range(passes)]
    times = sum(((b | (a & ~p)).cast("int") for a, b, p in zip(at, before, part)), F.lit(0))
    every = known.select("row", times.alias("times")).where("times > 0")
    if not cuts.where(reduce(or_, part)).isEmpty():
        # equal rows of which only some have their turn in a pass become one row, taken so often
        some = sum((F.when(a & p, F.col(f"some{k}")).otherwise(0) for k, (a, p) in enumerate(zip(at, part))), F.lit(0)).cast("int")
        single = known.select("row", "place.tie", some.alias("times")).where("times > 0").groupBy("tie").agg(F.first("row").alias("row"), F.max("times").alias("times"))
        every = every.unionByName(single.select("row", "times"))
    every = every.withColumn("lap", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return every.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
